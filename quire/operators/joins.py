"""Joins of the scoring workload."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.store import stored

MOST_MODELS = 10_000


def each_model(samples: DataFrame, models: DataFrame) -> DataFrame:
    """A row a sample and model. The registry has a row a system, and its ids go into the plan: samples are neither joined nor shuffled. More than MOST_MODELS of them are an error."""
    ids = [r["model_id"] for r in models.select("model_id").distinct().orderBy("model_id").limit(MOST_MODELS + 1).collect()]
    if len(ids) > MOST_MODELS:
        raise ValueError(f"over {MOST_MODELS} models")
    return samples.select("*", F.explode(F.array(*[F.lit(m) for m in ids]).cast("array<string>")).alias("model_id"))


def work_grid(models: DataFrame, samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every model with every sample and its prediction; what is missing or failed is the empty prediction, so failures can't raise a score."""
    joined = each_model(samples, models).join(final_attempts(predictions), ["model_id", "sample_id"], "left")
    return joined.withColumn("prediction", effective(F.col("status"), F.col("raw_prediction")))


def numbered(frame: DataFrame, column: str, name: str = "place") -> DataFrame:
    """frame with each row's place, from 0, in the order of a column without repeated values. Rows are dealt by ranges of the column, so that no task orders them all; the driver gets a count a range."""
    part = F.spark_partition_id().alias("quire_part")
    dealt = stored(frame.repartitionByRange(F.col(column)).select("*", part), "ranges")
    counts = {r["quire_part"]: r["n"] for r in dealt.groupBy("quire_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for k in sorted(counts):
        starts += [F.lit(k), F.lit(before)]
        before += counts[k]
    own = F.row_number().over(Window.partitionBy("quire_part").orderBy(column)) - 1
    start = F.element_at(F.create_map(*starts), F.col("quire_part")) if starts else F.lit(0)
    return dealt.withColumn(name, (own + start).cast("bigint")).drop("quire_part")


def effective(status: Column, prediction: Column) -> Column:
    return F.coalesce(F.when(status == "success", prediction), F.lit(""))


def final_attempts(predictions: DataFrame) -> DataFrame:
    """The last attempt of each (model, sample): the highest retry_count. Pre-aggregated, no window."""
    rest = [c for c in predictions.columns if c not in ("model_id", "sample_id")]
    last = F.max(F.struct("retry_count", *[c for c in rest if c != "retry_count"])).alias("last")
    return predictions.groupBy("model_id", "sample_id").agg(last).select("model_id", "sample_id", "last.*")


def eligible(models: DataFrame, registry: DataFrame, tracks: tuple[str, ...] = ("general_line_recognition", "pipeline")) -> DataFrame:
    """The models of the tracks that are scored; others get no score, not a zero."""
    return models.join(registry.where(F.col("track").isin(*tracks)).select(F.col("id").alias("model_id")), "model_id", "left_semi")


def leaked(samples: DataFrame, column: str = "source_document_id", splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """Values of a column that are in more than one split: one aggregation instead of a self-join."""
    seen = samples.where(F.col("split").isin(*splits) & F.col(column).isNotNull()).groupBy(column)
    return seen.agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_samples")).where("n_splits > 1")


def repeated_checksums(samples: DataFrame, order: str = "sample_id") -> DataFrame:
    """The second and later samples of each checksum, by order. The first of a checksum is an aggregate; no group is sorted."""
    first = samples.groupBy("sha256").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return samples.join(first, "sha256").where(F.col(order) > F.col("first_id")).select(order, "sha256", "first_id")


def inherit(derived: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Derived samples with columns of their parents."""
    return derived.join(samples.select(F.col("sample_id").alias("parent_sample_id"), *columns), "parent_sample_id")


#: Hashes of a key beyond which it is cut finer.
FULL_KEY = 1_024


def _finer(mask: int, distance: int, bits: int) -> list[int]:
    """Masks that each add bits to a mask, such that two hashes that agree on it and differ in at most `distance` bits agree on one of them: its other bits are cut into distance + 3 bands (as many as there are bits, if fewer), and all but `distance` of these are added."""
    free = [i for i in range(bits) if not mask >> i & 1]
    m = min(len(free), distance + 3)
    if m <= distance:
        return [mask]
    bands = [sum(1 << i for i in free[len(free) * k // m : len(free) * (k + 1) // m]) for k in range(m)]
    return [mask | sum(bands[k] for k in choice) for choice in itertools.combinations(range(m), m - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_hashes(hashed: DataFrame, id_column: str, hash_column: str, distance: int, bits: int = 64, full: int = FULL_KEY) -> DataFrame:
    """Pairs of ids whose hashes differ in at most `distance` bits: each hash's least id with the hash's other ids, and the least ids of unequal hashes. So a group of copies gives as many pairs as it has ids, and no link between different hashes is lost.

    Of distance + 3 bands of the bits `distance` at most can differ, so that three are equal: every choice of three is an equi-join key. The hashes of a key
    with more than `full` are cut by the bits that it leaves out, in the same way, and so on while bits are left: a key then has few bits left out, and so few
    hashes. The hashes are stored, so that they are computed once.
    """
    spark = hashed.sparkSession
    hashed = stored(hashed.where(F.col(hash_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(hash_column).cast("bigint").alias("h")), "hashes")
    first = stored(hashed.groupBy("h").agg(F.min("id").alias("first")), "firsts")
    copies = hashed.join(first, "h").where(F.col("id") > F.col("first")).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    masks = _finer(0, distance, bits)
    each = F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask")
    rows = first.select(F.col("first").alias("id"), "h", each).withColumn("value", F.col("h").bitwiseAND(F.col("mask")))
    found = None
    while True:
        rows = stored(rows, "keys")
        deeper = {m: _finer(m, distance, bits) for m in masks}
        deeper = {m: f for m, f in deeper.items() if f != [m]}
        sizes = stored(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        cut = (F.col("n") > full) & F.col("mask").isin([_signed(m) for m in deeper]) if deeper else F.lit(False)
        near = _pairs(rows.join(sizes.where(~cut).select("mask", "value"), ["mask", "value"], "left_semi"), distance)
        found = near if found is None else found.unionByName(near)
        large = sizes.where(cut).select("mask", "value")
        if not deeper or large.isEmpty():
            break
        # keys of large keys' hashes: a table of masks, whose size follows from distance and bits
        used = {r["mask"] for r in large.select("mask").distinct().collect()}
        table = spark.createDataFrame([(_signed(m), _signed(f)) for m, finer in deeper.items() if _signed(m) in used for f in finer], "mask bigint, finer bigint")
        masks = sorted({f for m, finer in deeper.items() if _signed(m) in used for f in finer})
        again = rows.join(large, ["mask", "value"], "left_semi").join(table, "mask")
        rows = again.select("id", "h", F.col("finer").alias("mask"), F.col("h").bitwiseAND(F.col("finer")).alias("value")).distinct()
    return found.distinct().unionByName(copies)


def _pairs(rows: DataFrame, distance: int) -> DataFrame:
    a, b = (rows.select(F.col("id").alias(f"id_{x}"), F.col("h").alias(f"h_{x}"), "mask", "value") for x in "ab")
    diff = F.col("h_a").bitwiseXOR(F.col("h_b"))
    near = a.join(b, ["mask", "value"]).where((F.col("id_a") < F.col("id_b")) & (F.bit_count(diff) <= distance))
    return near.select("id_a", "id_b", F.bit_count(diff).cast("int").alias("distance"))


def model_pairs(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Differences of every two models on equal keys (replicates, conditions)."""
    a = scores.select(*keys, F.col("model_id").alias("model_a"), F.col(value).alias("value_a"))
    b = scores.select(*keys, F.col("model_id").alias("model_b"), F.col(value).alias("value_b"))
    return a.join(b, keys).where("model_a < model_b").withColumn("difference", F.col("value_a") - F.col("value_b"))


def anchors(samples: DataFrame, kind: str, quotas: dict[str, int], seed: str) -> DataFrame:
    """For each type the samples that a seeded hash puts first, up to the type's quota, with their places. Each task keeps the first ones of its rows, by a
    threshold that it lowers as it goes; only these are shuffled, so no type is sorted as a whole."""
    rows = samples.where(F.col(kind).isin(list(quotas))).withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), "sample_id")))
    kept = rows.mapInArrow(lambda batches: _first_of(batches, kind, quotas), rows.schema)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(kind).orderBy("draw", "sample_id"))
    return kept.withColumn("place", place).where(F.col("place") <= F.try_element_at(quota, F.col(kind))).drop("draw")


def _first_of(batches: Iterator[pa.RecordBatch], kind: str, quotas: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows at most the quota of each type: those with the least draws, then ids."""
    most, held = pa.array(list(quotas)), None
    size = np.array(list(quotas.values()))
    for batch in batches:
        both = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        both = both.take(pc.sort_indices(both, [(kind, "ascending"), ("draw", "ascending"), ("sample_id", "ascending")]))
        of = np.asarray(pc.index_in(both.column(kind), most))
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
        held = both.take(np.flatnonzero(place < size[of]))
    if held is not None:
        yield from held.to_batches()


def corruption_grid(parents: DataFrame, families: list[str], severities: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row a parent, family and severity, with the derived id and a seed that follows from it."""
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("corruption"), F.lit(s).alias("severity")) for f in families for s in severities])).alias("c")
    rows = parents.select(F.col("sample_id").alias("parent_sample_id"), both).select("parent_sample_id", "c.*")
    name = F.concat("parent_sample_id", F.lit("__"), "corruption", F.lit("_s"), F.col("severity").cast("string"))
    return rows.withColumn("sample_id", name).withColumn("seed", draw(F.lit("seed"), F.col("sample_id"), 1 << 31))


def draw(seed: Column, key: Column, n: int) -> Column:
    """A number below n that depends on seed and key alone, and not on partitions: 48 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, key)), 1, 12), 16, 10).cast("bigint") % n


def chosen(samples: DataFrame, share: float, seed: str) -> DataFrame:
    """About the share of samples, by a seeded hash."""
    return samples.where(draw(F.lit(seed), F.col("sample_id"), 1_000_000) < int(share * 1_000_000))


def cluster_key(stratum: Column, origin: Column, document: Column, writer: Column, parent: Column | None = None) -> Column:
    """What is resampled as one: the parent of a derived sample, a handwriting's writer, else the document."""
    own = F.when((stratum == "persian_handwriting") & writer.isNotNull(), F.concat(F.lit("writer:"), writer)).otherwise(F.concat(F.lit("document:"), document))
    return own if parent is None else F.coalesce(F.concat(F.lit("parent:"), parent), own)
