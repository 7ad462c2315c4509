"""Filter interaction audit (op11): what each order of some filters keeps, takes and repeats, and what each filter is worth.

Every row is reduced to a mask, a bit a filter that it fails, and rows to cells: counts of a (part, mask). All orders are then
walked by adjacent transpositions, each order one swap of neighbours after the last; a swap changes two steps, which are
read anew from the cells, while the other steps stand. Shapley values gather along the walk.

Nulls: a null text is empty, a null part the empty string, a null condition counts as not failed. Rows without an id fail no
comparison with smaller ids and have no labels; a repeated id is compared with smaller ids only. An id's labels are
the largest of its rows. A text without words has 0 words, all distinct. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GAP

#: The five filters: each name's letter is its place in the mask.
LETTERS = "ABCDE"
SHORTEST = 200  # words (A)
DISTINCT = 50  # percent of words (B)
CAPITALS = 3  # percent of code points (C)
SIGNS = r"[#$%&*|]"  # (D)

COUNTS = ["kept", "removed", "redundant", "unique_fails"]


def swaps(n: int) -> Iterator[int]:
    """Where to swap neighbours, n! - 1 times, so that a row of n visits all its orders (Steinhaus-Johnson-Trotter): the last item sweeps through, and at each end of a sweep the others move once."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # after a downward sweep the last item stands in front of the others
        down = not down


def _outside(cells: np.ndarray, n: int) -> np.ndarray:
    """For each set of filters, the sum of cells that fail none of them. cells: (parts, 2**n)."""
    out = cells.copy()
    for b in range(n):  # sums over subsets
        at = np.arange(1 << n)
        at = at[at >> b & 1 == 1]
        out[:, at] += out[:, at ^ (1 << b)]
    return out[:, ::-1]  # subsets of the complement


def walk(n: int) -> Iterator[tuple[list[int], list[int], tuple[int, ...]]]:
    """(filter of each step, the set of filters before it, steps that differ from the last order's) of all orders. The lists are the walk's own."""
    order, before = list(range(n)), [(1 << i) - 1 for i in range(n)]
    yield order, before, tuple(range(n))
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        yield order, before, (i, i + 1)


def _audited(batch: pa.RecordBatch, letters: str, marks: list[str]) -> pa.RecordBatch:
    n, parts = len(letters), len(batch)
    size = 1 << n
    cells = {k: np.asarray(batch.column(k).flatten(), dtype=np.int64).reshape(parts, size) for k in ("n", *marks)}
    free = {k: _outside(v, n) for k, v in cells.items()}  # rows that fail no filter of a set
    fails = np.stack([free["n"][:, 0] - free["n"][:, 1 << f] for f in range(n)], 1)
    alone = np.stack([cells["n"][:, 1 << f] for f in range(n)], 1)

    steps = {k: np.empty((parts, n), np.int64) for k in ("kept", "removed", *[f"{m}_lost" for m in marks])}
    columns: dict[str, list[np.ndarray]] = {k: [] for k in steps}
    filters, shapley = [], np.zeros((parts, n), np.int64)
    for order, before, changed in walk(n):
        for i in changed:
            here, after = before[i], before[i] | 1 << order[i]
            steps["kept"][:, i] = free["n"][:, after]
            steps["removed"][:, i] = free["n"][:, here] - free["n"][:, after]
            for m in marks:
                steps[f"{m}_lost"][:, i] = free[m][:, here] - free[m][:, after]
        shapley[:, order] += steps["removed"]
        filters.append(list(order))
        for k, v in steps.items():
            columns[k].append(v.copy())
    filters = np.array(filters)  # (orders, steps)
    flat = {k: np.stack(v, 1).reshape(-1) for k, v in columns.items()}  # part, order, step
    of = np.broadcast_to(filters[None], (parts, *filters.shape))
    which = np.arange(parts)[:, None, None]
    flat["redundant"] = fails[which, of].reshape(-1) - flat["removed"]
    flat["unique_fails"] = alone[which, of].reshape(-1)
    flat["shapley"] = shapley[which, of].reshape(-1)
    rows = filters.size
    names = np.array(["".join(letters[i] for i in order) for order in filters], dtype=object)
    out = {
        "part": batch.column("part").take(pa.array(np.repeat(np.arange(parts), rows))),
        "filter_order": pa.array(np.tile(np.repeat(names, n), parts), pa.string()),
        "step": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), parts * len(filters)), pa.int32()),
    }
    for k in (*COUNTS, *[f"{m}_lost" for m in marks], "shapley"):
        out[k] = pa.array(flat[k], pa.int64())
    return pa.RecordBatch.from_pydict(out)


def cells(masked: DataFrame, n: int, marks: list[str]) -> DataFrame:
    """part, n array<bigint> and one array a mark: counts of each mask, from rows of part, mask, n and the marks as counts. Bounded: 2**n cells a part."""
    sums = masked.groupBy("part", "mask").agg(*[F.sum(k).cast("bigint").alias(k) for k in ("n", *marks)])
    listed = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", *marks)))).alias("cells"))
    at = lambda k: F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda i: F.coalesce(F.try_element_at("cells", i)[k], F.lit(0).cast("bigint")))
    return listed.select("part", *[at(k).alias(k) for k in ("n", *marks)])


def audit(masked: DataFrame, letters: str, marks: list[str]) -> DataFrame:
    """A row a part, filter_order and step: kept, removed, redundant, unique_fails, a `_lost` column a mark, shapley (the step's filter's removed over all orders).

    masked: part, mask (bit i: fails letters[i]), n and one count a mark. All len(letters)! orders are listed, so at most eight filters.
    """
    if not 1 <= len(letters) <= 8 or len(set(letters)) < len(letters):
        raise ValueError("one to eight filters with different letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                yield _audited(batch.slice(at, 64), letters, marks)

    fields = [f"{c} bigint" for c in (*COUNTS, *[f"{m}_lost" for m in marks], "shapley")]
    return cells(masked, len(letters), marks).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(fields))


def conditions(text: Column) -> list[Column]:
    """What each of A to D finds wrong with a text. Spaces at the ends make an empty word, which is left out."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    return [
        F.size(words) < SHORTEST,
        100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.char_length(text),
        text.rlike(SIGNS),
    ]


def bits(fails: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents counted by part and by what they fail, E (the text of a smaller id) among it.

    Texts are compared by SHA-256. Rows meet by id first, then by text, in counts: a text that a third of all rows have is a row a
    task, part and label. Only ids, hashes and counts are shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = picked.select("doc_id", "part", bits(conditions(F.col("text"))).alias("fails"), F.unhex(F.sha2("text", 256)).alias("same"))
    zero = F.lit(0).cast("bigint")
    nameless = fails.where("doc_id is null").groupBy("part", F.col("fails").alias("mask")).agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))

    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    ids = fails.where("doc_id is not null").groupBy("doc_id", "part", "fails", "same").agg(F.count(F.lit(1)).alias("rows"))
    labelled = ids.join(known, "doc_id", "left").select("doc_id", "part", "fails", "same", "rows", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("good", "toxic")])
    texts = labelled.groupBy("same", "fails", "part", "good", "toxic").agg(F.sum("rows").alias("n"), F.min(F.struct("doc_id", "rows")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("same"))  # of a text: a row a part and label
    firsts = F.when(F.col("first.doc_id") == least, F.col("first.rows")).otherwise(F.lit(0))
    split = texts.select("part", "fails", "good", "toxic", F.col("n") - firsts, firsts.alias("firsts")).toDF("part", "fails", "good", "toxic", "later", "firsts")
    copy = 1 << LETTERS.index("E")
    rows = F.explode(F.array(F.struct(F.col("fails").alias("mask"), F.col("firsts").alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(copy)).alias("mask"), F.col("later").alias("n")))).alias("r")
    named = split.select("part", rows, "good", "toxic").select("part", "r.mask", "r.n", (F.col("r.n") * F.col("good")).alias("good"), (F.col("r.n") * F.col("toxic")).alias("toxic"))
    return named.unionByName(nameless)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by language: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(masks(docs, labels), LETTERS, ["good", "toxic"])
