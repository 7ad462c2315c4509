"""Approximate nearest neighbours by cosine, by cross-polytope hashing (op12).

A hash rotates a unit vector by three rounds of random signs and a fast Hadamard transform, and takes the signed axis that is
nearest. A bucket of a table is a row of such hashes; their number of bits follows the number of vectors, so that a bucket holds
about BUCKET of them at any size. A query probes every bucket of a table whose cost, the sum of squared distances
between the query's best axes and the bucket's, is within a radius. The radius is measured: it is the one at which RECALL of the true
neighbours of at most SAMPLE queries, found by a scan, are in a probed bucket. All rows are indexed and all queries asked.

Tables are dealt into blocks of buckets; vectors go there as 16-bit integers with their rounding error, so that a block
names every candidate that may be among a query's best, and these are ranked by the exact cosine of the original vectors. A block with
too many rows, as a bucket of near copies makes, is dealt to several tasks by id. Equal vectors are one class with its smallest ids,
in the index and among the queries, so that copies meet once. A query that finds too few classes asks again with a wider radius.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id or with another number of
components than most. Of rows that repeat an id one counts, chosen by a hash of its vector. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import mix64, written

TABLES = 8
BUCKET = 8
BLOCK = 1 << 22  # numbers of a block: 65,536 vectors of 64 components
RECALL = 0.98
SAMPLE = 256
SEED = 12
ROUNDS = 3
SLACK = 2e-6  # single-precision error of a dot product of unit vectors


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of the last axis, whose length is a power of two, in log2 passes."""
    d, shape = x.shape[-1], x.shape
    h = 1
    while h < d:
        pairs = x.reshape(*shape[:-1], d // (2 * h), 2, h)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(shape)
        h *= 2
    return x / np.float32(math.sqrt(d))


class Polytopes:
    """The hashes of all tables for vectors of `dim` components, with `bits` bits a table. Everything follows from the arguments, so all tasks have the same."""

    def __init__(self, dim: int, bits: int, tables: int = TABLES, seed: int = SEED):
        self.dim, self.tables = dim, tables
        self.padded = max(2, 1 << (dim - 1).bit_length())
        full = self.padded.bit_length()  # bits of a whole polytope: an axis and its sign
        self.axes = [1 << (min(full, bits - at) - 1) for at in range(0, bits, full)]  # the last hash may use some axes only
        rng = np.random.default_rng([seed, dim, bits])
        self.signs = rng.choice(np.array([-1, 1], np.float32), (tables, len(self.axes), ROUNDS, self.padded))

    def rotated(self, units: np.ndarray, table: int, hash_: int) -> np.ndarray:
        x = np.zeros((len(units), self.padded), np.float32)
        x[:, : self.dim] = units
        for signs in self.signs[table, hash_]:
            x = hadamard(x * signs)
        return x[:, : self.axes[hash_]]

    def codes(self, units: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector."""
        out = np.zeros((len(units), self.tables), np.int64)
        for t in range(self.tables):
            for j, axes in enumerate(self.axes):
                x = self.rotated(units, t, j)
                best = np.abs(x).argmax(1)
                out[:, t] = out[:, t] * (2 * axes) + 2 * best + (np.take_along_axis(x, best[:, None], 1)[:, 0] < 0)
        return out

    def costs(self, units: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash of a table (rows, 2 axes): squared distance of each signed axis from the best one."""
        out = []
        for j in range(len(self.axes)):
            x = self.rotated(units, table, j)
            both = np.stack([x, -x], 2).reshape(len(x), -1)
            out.append((both.max(1, keepdims=True) - both) ** 2)
        return out

    def cost_of(self, costs: list[np.ndarray], row: int, codes: np.ndarray) -> np.ndarray:
        """What the buckets cost a query."""
        total, rest = np.zeros(len(codes), np.float32), codes.copy()
        for c in reversed(costs):
            total += c[row, rest % c.shape[1]]
            rest //= c.shape[1]
        return total

    @property
    def dearest(self) -> float:
        """No bucket costs more."""
        return 4.0 * len(self.axes) + 1


def probes(costs: list[np.ndarray], row: int, radius: float) -> np.ndarray:
    """Every bucket of a table that costs a query at most the radius; a prefix that costs more has no continuation."""
    code, cost = np.zeros(1, np.int64), np.zeros(1, np.float32)
    for c in costs:
        total = cost[:, None] + c[row][None, :]
        at, axis = np.nonzero(total <= radius)
        code, cost = code[at] * c.shape[1] + axis, total[at, axis]
    return code


def _vectors(batch: pa.RecordBatch | pa.Table, column: str = "embedding") -> np.ndarray:
    """(rows, components) in double precision, each scaled by a power of two so that no square overflows; no cosine changes."""
    own = batch.column(column)
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    x = np.asarray(own.flatten(), dtype=np.float64).reshape(len(batch), -1)
    if not len(x):
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _block_of(codes: np.ndarray, table: int, blocks: int) -> np.ndarray:
    return table * blocks + (mix64(codes.astype(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)


def _distinct(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(classes of equal vectors: rep, ids (the k + 1 smallest); queries: query_id, rep; vectors: rep, embedding; components)."""
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    most = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most["dim"] if most else 1
    keyed = valid.where(F.size("embedding") == dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding")})
    ids = keyed.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    least = ids.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = written(least.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = ids.where(F.col("vec_id") % every == 0).join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep")
    named = classes.select(F.col("rep").alias("vec_id"), "h1", "h2")
    held = keyed.join(named, ["vec_id", "h1", "h2"], "left_semi").groupBy("vec_id", "h1", "h2").agg(F.first("embedding").alias("embedding")).select(F.col("vec_id").alias("rep"), "embedding")
    return classes.select("rep", "ids"), written(asked, "asked"), written(held, "vectors"), dim


def _radius(held: DataFrame, asked: DataFrame, make, k: int) -> float:
    """The radius that reaches RECALL of the true neighbours of a sample of queries, which each task compares with all of its rows; a task gives k rows a query."""
    sample = asked.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().sort_by("rep")
    if not len(sample):
        return 0.0
    ids, own = np.asarray(sample.column("rep")), _units(_vectors(sample)).astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, costs, hashes = np.full((len(ids), k), -2.0, np.float32), np.zeros((len(ids), k), np.float32), make()
        tables = [hashes.costs(own, t) for t in range(hashes.tables)]
        for batch in batches:
            units = _units(_vectors(batch))
            got = own @ units.T.astype(np.float32)
            got[ids[:, None] == np.asarray(batch.column("rep"))[None, :]] = -2
            codes = hashes.codes(units)
            for q in np.flatnonzero(got.max(1) > score.min(1)):
                better = np.flatnonzero(got[q] > score[q].min())
                better = better[np.argsort(-got[q, better])[:k]]
                cost = np.min([hashes.cost_of(c, q, codes[better, t]) for t, c in enumerate(tables)], axis=0)
                scores, paid = np.concatenate([score[q], got[q, better]]), np.concatenate([costs[q], cost])
                best = np.argsort(-scores, kind="stable")[:k]
                score[q], costs[q] = scores[best], paid[best]
        q, i = np.nonzero(score > -2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(score[q, i]), pa.array(costs[q, i])], ["query", "score", "cost"])

    near = held.mapInArrow(scan, "query bigint, score float, cost float")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cost"))).where(F.col("place") <= k)
    paid = np.asarray(best.select("cost").toArrow().column("cost"), dtype=np.float64)
    return float(np.quantile(paid, RECALL, method="higher")) if len(paid) else 0.0


def _candidates(held: DataFrame, asked: DataFrame, radius: float, make, blocks: int, big: DataFrame, k: int) -> DataFrame:
    """query, id, low, high: of each block's candidates those that may be among a query's best k."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = make()
        for batch in batches:
            units = _units(_vectors(batch))
            scale = np.abs(units).max(1) / 32767
            short = np.rint(units / scale[:, None]).astype(np.int16)
            error = np.sqrt(((units - short * scale[:, None]) ** 2).sum(1))
            packed = pa.array([x.tobytes() for x in short], pa.binary())
            codes = hashes.codes(units)
            for t in range(hashes.tables):
                yield pa.RecordBatch.from_pydict({"block": pa.array(_block_of(codes[:, t], t, blocks)), "bucket": pa.array(codes[:, t]), "id": batch.column("rep"), "short": packed, "scale": pa.array(scale), "error": pa.array(error)})

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = make()
        for batch in batches:
            units, rep = _units(_vectors(batch)).astype(np.float32), np.asarray(batch.column("rep"))
            for t in range(hashes.tables):
                costs, out = hashes.costs(units, t), []
                for q in range(len(units)):
                    buckets = probes(costs, q, radius)
                    block = _block_of(buckets, t, blocks)
                    order = np.argsort(block, kind="stable")
                    ends = np.flatnonzero(np.diff(block[order])) + 1
                    out += [(int(block[part[0]]), int(rep[q]), units[q].tobytes(), buckets[part]) for part in np.split(order, ends)]
                cols = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["block", "query", "unit", "buckets"])

    def met(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(index) and len(queries):
            bucket = np.asarray(index.column("bucket"))
            order = np.argsort(bucket, kind="stable")
            bucket, ids, error = bucket[order], np.asarray(index.column("id"))[order], np.asarray(index.column("error"))[order] + SLACK
            short = np.frombuffer(b"".join(index.column("short").to_pylist()), np.int16).reshape(len(index), -1)[order]
            vectors = short.astype(np.float32) * np.asarray(index.column("scale"))[order, None].astype(np.float32)
            for query, unit, wanted in zip(queries.column("query").to_pylist(), queries.column("unit").to_pylist(), queries.column("buckets"), strict=True):
                wanted = np.asarray(wanted.values)
                lo, hi = np.searchsorted(bucket, wanted, "left"), np.searchsorted(bucket, wanted, "right")
                n = hi - lo
                rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows = rows[ids[rows] != query]
                if not len(rows):
                    continue
                score = vectors[rows] @ np.frombuffer(unit, np.float32)
                low, high = score - error[rows], score + error[rows]
                if len(rows) > k:
                    good = high >= np.partition(low, len(low) - k)[len(low) - k]
                    rows, low, high = rows[good], low[good], high[good]
                found.append((np.full(len(rows), query), ids[rows], low, high))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 4
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "low": pa.array(cols[2], pa.float64()), "high": pa.array(cols[3], pa.float64())})

    spread = lambda frame: frame.join(big, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    index = spread(held.mapInArrow(indexed, "block bigint, bucket bigint, id bigint, short binary, scale double, error double"))
    index = index.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    queries = spread(asked.mapInArrow(probed, "block bigint, query bigint, unit binary, buckets array<bigint>"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    rows = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(met, "query bigint, id bigint, low double, high double")
    once = rows.groupBy("query", "id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    floor = F.min(F.when(F.col("place") <= k, F.col("low"))).over(Window.partitionBy("query"))
    return once.withColumn("place", place).withColumn("floor", floor).where("high >= floor").select("query", "id")


def _ranked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """query, id, score: the exact cosine of the original vectors."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _vectors(batch, "a"), _vectors(batch, "b")
            dot, aa, bb = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(dot / (np.sqrt(aa) * np.sqrt(bb)))], ["query", "id", "score"])

    a, b = (held.select(F.col("rep").alias(r), F.col("embedding").alias(v)) for r, v in (("query", "a"), ("id", "b")))
    return pairs.join(b, "id").join(a, "query").select("query", "id", "a", "b").mapInArrow(exact, "query bigint, id bigint, score double")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows that each row whose vec_id `every` divides finds, ties to the smaller id. vectors: vec_id, embedding (numbers)."""
    classes, queries, held, dim = _distinct(vectors, k, every)
    n = held.count()
    bits = max(1, round(math.log2(max(1, n) / BUCKET))) if n > BUCKET else 1
    size = max(1024, BLOCK // dim)  # vectors of a block
    make, blocks = functools.partial(Polytopes, dim, bits), -(-max(1, n) // size)
    asked = written(held.join(queries.select("rep").distinct(), "rep", "left_semi"), "queries")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held_by = make(), {}
        for batch in batches:
            for t, codes in enumerate(hashes.codes(_units(_vectors(batch))).T):
                for block, rows in zip(*np.unique(_block_of(codes, t, blocks), return_counts=True), strict=True):
                    held_by[block] = held_by.get(block, 0) + int(rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(held_by), pa.int64()), pa.array(list(held_by.values()), pa.int64())], ["block", "rows"])

    sizes = held.mapInArrow(counted, "block bigint, rows bigint").groupBy("block").agg(F.sum("rows").alias("rows"))
    big = written(sizes.where(F.col("rows") > 2 * size).select("block", F.ceil(F.col("rows") / size).cast("bigint").alias("parts")), "blocks")
    radius, most = _radius(held, asked, make, k), make().dearest
    found, left = [], asked
    while True:
        pairs = written(_candidates(held, left, radius, make, blocks, big, k), "pairs")
        found.append(pairs)
        if radius >= most:
            break
        counts = pairs.groupBy(F.col("query").alias("rep")).agg(F.count(F.lit(1)).alias("got"))
        left = written(left.join(counts, "rep", "left").where(F.coalesce("got", F.lit(0)) < min(k, n - 1)).select("rep", "embedding"), "short")
        if left.isEmpty():
            break
        radius = min(most, max(radius * 4, 0.01))
    pairs = functools.reduce(DataFrame.unionByName, found).distinct()
    own = asked.select(F.col("rep").alias("query"), F.col("rep").alias("id"))
    scored = _ranked(pairs.unionByName(own), held)
    first = Window.partitionBy("query").orderBy((F.col("query") == F.col("id")).desc(), F.desc("score"), "id")
    best = scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")  # a query's own class, for its copies, and the k best others
    rows = best.join(classes, best["id"] == classes["rep"]).select(F.col("query").alias("rep"), "score", F.explode("ids").alias("vec_id"))
    of = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    # k + 1 of a class's rows do for each of its queries, as a query leaves out one at most
    near = rows.withColumn("place", F.row_number().over(of)).where(F.col("place") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    each = queries.join(near, "rep").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def nearest_of(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", "embedding"))
