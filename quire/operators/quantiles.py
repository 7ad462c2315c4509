"""Exact percentiles of groups of any size, by histogram passes that narrow to the ranks asked for.

A pass cuts the interval that holds a rank into CELLS cells, counts its values by cell (with the least and the greatest of each), and
goes on with the cell that holds the rank, from its least to its greatest value; it ends when these are equal. Each pass is one scan and one
aggregation of at most CELLS rows a rank and task. No group is sorted or held by a task, and no value leaves it but in counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.store import removed, stored

CELLS = 4096


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """keys and a column a wanted name: the percentile of an expression over a group, interpolated between its neighbours. Nulls, NaN and infinities don't count; a group without values has null. keys: columns without nulls."""
    measures = list(wanted)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), wanted[m][0].cast("double").alias("value")) for m in measures])).alias("m")
    values = stored(rows.select(*keys, each).select(*keys, "m.measure", "m.value").where("abs(value) < double('inf')"), "values")
    own = [*keys, "measure"]
    spot = F.create_map(*[F.lit(x) for m in measures for x in (m, float(wanted[m][1]))])
    whole = values.groupBy(*own).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    at = F.try_element_at(spot, F.col("measure")) * (F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank")
    targets = stored(whole.select(*own, "lo", "hi", F.lit(0).cast("bigint").alias("before"), at.alias("at"), ranks), "ranks")
    while not targets.where("lo < hi").isEmpty():
        last, targets = targets, stored(_narrowed(values, targets, own), "ranks")
        removed(last)
    low = F.max(F.when(F.col("rank") == F.floor("at"), F.col("lo")))
    high = F.max(F.when(F.col("rank") == F.ceil("at"), F.col("lo")))
    share = F.max(F.col("at") - F.floor("at"))
    found = targets.groupBy(*own).agg(low.alias("low"), high.alias("high"), share.alias("share"))
    exact = found.withColumn("value", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("share")) * F.col("low") + F.col("share") * F.col("high")))
    wide = exact.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in measures])
    return rows.select(*keys).distinct().join(wide, keys, "left")


def _narrowed(values: DataFrame, targets: DataFrame, own: list[str]) -> DataFrame:
    open_ = targets.where("lo < hi")
    spans = open_.select(*own, "lo", "hi").distinct()
    inside = values.join(spans, own).where("value BETWEEN lo AND hi")
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    share = F.when(hi - lo < F.lit(float("inf")), (value - lo) / (hi - lo)).otherwise((value / 2 - lo / 2) / (hi / 2 - lo / 2))  # monotone in the value
    cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell")
    cells = inside.groupBy(*own, "lo", "hi", cell).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    before = F.sum("n").over(Window.partitionBy(*own, "lo", "hi").orderBy("cell")) - F.col("n")  # CELLS rows at most
    counted = cells.withColumn("below", before)
    found = open_.join(counted, [*own, "lo", "hi"]).where("rank >= before + below AND rank < before + below + n")
    narrow = found.select(*own, F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"), "at", "rank")
    return narrow.unionByName(targets.where("lo = hi"))


def of_array(values: Column, share: float) -> Column:
    """The percentile of an array's numbers, which a row holds; null where there are none."""
    values = F.array_sort(F.array_compact(values))
    at = (F.size(values) - 1) * F.lit(float(share))
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def poisson_steps(most: int = 12) -> list[int]:
    """Of 32-bit numbers: a number is at least so many of these in as many cases as Poisson(1) is above 0, 1, ... `most` - 1."""
    total, term, out = 0.0, math.exp(-1), []
    for i in range(most):
        total += term
        term /= i + 1
        out.append(int(total * (1 << 32)))
    return out
