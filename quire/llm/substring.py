"""Substring deduplication with a count-min prefilter.

Documents are dealt into buckets by a hash of their id. A bucket's windows (runs of `width` words of one
document) are hashed to 128 bits; a hash gives a cell of the sketch in each of `depth` rows, and a cell
counts the documents that have a window there. A bucket's part of the sketch is sparse, so it is sent as
sorted cells by shards of the cell range; each shard merges the parts, and tells each bucket which of its
cells have a count over 1. No estimate is below the true count, so every window of two documents is among
the windows whose cells are all so marked. Only these are grouped exactly, by all 128 bits: each bucket
sends a distinct window once with the least id that has it, each shard answers with one bit a window, and
the bucket then knows which windows start in an earlier document.

What goes to a task is one bucket's texts or one shard's cells; both have a set size, and there are more of
them for larger inputs. A window that a third of all rows have is one entry a bucket. Nothing is broadcast.

Cases: a null or empty text has no words and nothing is removed; a null doc_id is later than all others and
two of them are one document to each other; rows with equal ids are one document too, so they don't remove
each other's words; a text shorter than a window has none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import flat, fresh, give_back, mix64, text_bytes, texts, words_of
from quire.llm.hashing import BASES, word_hashes

WIDTH = 13
BUCKET_BYTES = 4 << 20  # of text in a bucket, about
LEAST_BUCKETS = 256
CELLS_PER_WINDOW = 4  # at least; the cells of a row are a power of two
DEPTH = 2
SHARD_WINDOWS = 1 << 20  # of all windows in a shard, about
LEAST_SHARDS = 64
LAST = np.iinfo(np.int64).max

def windows(rows: np.ndarray, words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, hash, second hash) of each window."""
    n = len(rows) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    out = []
    for h, base in zip(word_hashes(words), BASES, strict=True):
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total *= base
            total += h[i : i + n]
        out.append(mix64(total[first]))
    return first, out[0], out[1]


def _ids(ids: pa.ChunkedArray) -> np.ndarray:
    """The ids, a null one as the last."""
    return np.asarray(pc.fill_null(flat(ids), LAST), dtype=np.int64)


class Plan:
    """The sizes that follow from the input's bytes. rows: the sketch's rows; bits: log2 of a row's cells; a shard is a range of cells."""

    def __init__(self, n_bytes: int, width: int = WIDTH, depth: int = DEPTH):
        n = max(1, n_bytes // 6)  # words, about
        self.width, self.depth = width, depth
        self.buckets = max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)
        self.bits = max(20, int(CELLS_PER_WINDOW * n - 1).bit_length())
        self.shard_bits = max(int(LEAST_SHARDS - 1).bit_length(), int(n // SHARD_WINDOWS).bit_length())

    def cells(self, h: np.ndarray, g: np.ndarray, row: int) -> np.ndarray:
        return (mix64(h + np.uint64(row) * g) >> np.uint64(64 - self.bits)).astype(np.int64)

    def shards(self, cells: np.ndarray) -> np.ndarray:
        """Ends of the shards in sorted cells."""
        return np.searchsorted(cells, (np.arange(1, (1 << self.shard_bits) + 1)) << (self.bits - self.shard_bits))


def _coded(cells: np.ndarray, base: int) -> bytes:
    """Sorted distinct cells as gaps, compressed: small gaps make short codes."""
    gaps = np.diff(cells, prepend=base)
    top = int(gaps.max()) if len(gaps) else 0
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes()


def _decoded(data: bytes, base: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)) + base


_LINK = "row int, shard int, bucket int, cells binary, counts binary"
_KEYS = "shard int, bucket int, hashes binary, firsts binary"


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema.items(), columns, strict=True)})


def deduplicated(docs: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> tuple[DataFrame, str, str, str]:
    """(docs' columns, then three more of every document; the names of these: number of words, number removed, the words left joined by a space)."""
    id_, text_, bucket_, n_words_, n_removed_, kept_ = fresh(docs, "id", "text", "bucket", "words", "removed", "kept")
    base = docs.withColumns({id_: F.col("doc_id").cast("long"), text_: F.coalesce(F.col("text").cast("string"), F.lit(""))})
    plan = Plan(text_bytes(base.select(F.col(text_).alias("text"))), width, depth)
    # rows without an id would all be one bucket: these are dealt by their texts
    bucketed = base.withColumn(bucket_, F.pmod(F.coalesce(F.when(F.col(id_).isNotNull(), F.xxhash64(id_)), F.xxhash64(text_)), F.lit(plan.buckets)).cast("int"))
    link = {"row": pa.int32(), "shard": pa.int32(), "bucket": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
    columns = docs.columns
    keyed = {"shard": pa.int32(), "bucket": pa.int32(), "hashes": pa.binary(), "firsts": pa.binary()}

    def seen(table):
        """(words' rows, words, window starts, hashes, ids of the windows' documents) of a bucket."""
        rows, words = words_of(table[text_])
        first, h, g = windows(rows, words, plan.width)
        return rows, words, first, h, g, _ids(table[id_])[rows[first]]

    def counted(table):
        """The bucket's part of the sketch."""
        give_back()  # what the last bucket took
        if not table.num_rows:
            return _table(link, [])
        bucket = table[bucket_][0].as_py()
        *_, h, g, ids = seen(table)
        out = []
        for row in range(plan.depth):
            cells = plan.cells(h, g, row)
            order = np.lexsort((ids, cells))
            cells, own = cells[order], ids[order]
            once = np.ones(len(cells), bool)
            once[1:] = (cells[1:] != cells[:-1]) | (own[1:] != own[:-1])
            cells, counts = np.unique(cells[once], return_counts=True)
            at = 0
            for shard, end in enumerate(plan.shards(cells).tolist()):
                if end > at:
                    out.append((row, shard, bucket, _coded(cells[at:end], shard << (plan.bits - plan.shard_bits)), np.packbits(counts[at:end] > 1).tobytes()))
                at = end
        return _table(link, out)

    def merged(table):
        """For each bucket, a bit for each of its cells: whether the merged count is over 1."""
        give_back()  # what the last bucket took
        parts, size = table.to_pylist(), 1 << (plan.bits - plan.shard_bits)
        if not parts:
            return _table(link, [])
        start = parts[0]["shard"] << (plan.bits - plan.shard_bits)
        total = np.zeros(size, np.uint8)  # saturates at 2: more isn't asked for
        for p in parts:
            p["at"] = _decoded(p["cells"], start) - start
            own = total[p["at"]] + 1 + np.unpackbits(np.frombuffer(p["counts"], np.uint8), count=len(p["at"]))
            total[p["at"]] = np.minimum(own, 2)
        return _table(link, [(p["row"], p["shard"], p["bucket"], None, np.packbits(total[p["at"]] > 1).tobytes()) for p in parts])

    def repeated(texts_, marks):
        """The bucket's distinct windows whose cells are all marked, with the least document of each."""
        give_back()  # what the last bucket took
        if not texts_.num_rows or not marks.num_rows:
            return _table(keyed, [])
        bucket = texts_[bucket_][0].as_py()
        *_, h, g, ids = seen(texts_)
        keep = _marked(plan, h, g, {(m["row"], m["shard"]): m["counts"] for m in marks.to_pylist()})
        h, g, ids = (x[keep] for x in (h, g, ids))
        _, h, g, ids = _distinct(h, g, ids)
        ends, at, out = np.searchsorted(h >> np.uint64(64 - plan.shard_bits), np.arange(1, (1 << plan.shard_bits) + 1)), 0, []
        for shard, end in enumerate(ends.tolist()):
            if end > at:
                out.append((shard, bucket, np.stack([h[at:end], g[at:end]]).tobytes(), ids[at:end].tobytes()))
            at = end
        return _table(keyed, out)

    def settled(table):
        """For each bucket, a bit for each of its windows: whether an earlier document outside the bucket starts it."""
        give_back()  # what the last bucket took
        parts = table.to_pylist()
        if not parts:
            return _table(keyed, [])
        sizes = [len(p["firsts"]) // 8 for p in parts]
        h, g = (np.concatenate([np.frombuffer(p["hashes"], np.uint64)[i * n : (i + 1) * n] for p, n in zip(parts, sizes, strict=True)]) for i in (0, 1))
        ids = np.concatenate([np.frombuffer(p["firsts"], np.int64) for p in parts])
        groups, _, _, least = _distinct(h, g, ids)
        later, at, out = least[groups] < ids, 0, []
        for p, n in zip(parts, sizes, strict=True):
            out.append((p["shard"], p["bucket"], None, np.packbits(later[at : at + n]).tobytes()))
            at += n
        return _table(keyed, out)

    def removed(texts_, both):
        """The rows of the result. both: what `merged` (row >= 0) and `settled` (row < 0) answered."""
        give_back()  # what the last bucket took
        own = texts_.select(columns)
        if not texts_.num_rows:
            return own.append_column(n_words_, pa.array([], pa.int64())).append_column(n_removed_, pa.array([], pa.int64())).append_column(kept_, pa.array([], pa.string()))
        rows, words, first, h, g, ids = seen(texts_)
        gone = np.zeros(len(words) + 1, np.int32)
        if both.num_rows:
            answers = both.to_pylist()
            bits = {(m["row"], m["shard"]): m["counts"] for m in answers if m["row"] >= 0}
            later = {m["shard"]: m["counts"] for m in answers if m["row"] < 0}
            keep = _marked(plan, h, g, bits)
            where, kh, kg, kid = np.flatnonzero(keep), h[keep], g[keep], ids[keep]
            groups, uh, _, uid = _distinct(kh, kg, kid)
            early = np.zeros(len(uh), bool)
            ends, at = np.searchsorted(uh >> np.uint64(64 - plan.shard_bits), np.arange(1, (1 << plan.shard_bits) + 1)), 0
            for shard, end in enumerate(ends.tolist()):
                if end > at:
                    early[at:end] = np.unpackbits(np.frombuffer(later[shard], np.uint8), count=end - at)
                at = end
            bad = first[where[early[groups] | (uid[groups] < kid)]]
            np.add.at(gone, bad, 1)
            np.add.at(gone, bad + plan.width, -1)
        drop = np.cumsum(gone)[:-1] > 0
        n = texts_.num_rows
        n_words, n_removed = np.bincount(rows, minlength=n), np.bincount(rows[drop], minlength=n)
        left = words.filter(pa.array(~drop))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_words - n_removed)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, left), " ")
        return own.append_column(n_words_, pa.array(n_words)).append_column(n_removed_, pa.array(n_removed)).append_column(kept_, joined)

    # one exchange of the documents serves all three uses
    by_bucket = lambda frame: bucketed.groupBy(bucket_).cogroup(frame.groupBy("bucket"))
    marks = bucketed.groupBy(bucket_).applyInArrow(counted, _LINK).groupBy("row", "shard").applyInArrow(merged, _LINK)
    answers = by_bucket(marks).applyInArrow(repeated, _KEYS).groupBy("shard").applyInArrow(settled, _KEYS)
    both = marks.unionByName(answers.select(F.lit(-1).alias("row"), "shard", "bucket", F.lit(None).cast("binary").alias("cells"), F.col("firsts").alias("counts")))
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_bucket(both).applyInArrow(removed, f"{whole}, {n_words_} long, {n_removed_} long, {kept_} string"), n_words_, n_removed_, kept_


def _marked(plan: Plan, h: np.ndarray, g: np.ndarray, bits: dict) -> np.ndarray:
    """Which windows have all their cells marked."""
    keep = np.ones(len(h), bool)
    for row in range(plan.depth):
        distinct, place = np.unique(plan.cells(h, g, row), return_inverse=True)
        mark, at = np.zeros(len(distinct), bool), 0
        for shard, end in enumerate(plan.shards(distinct).tolist()):
            if end > at:
                mark[at:end] = np.unpackbits(np.frombuffer(bits[row, shard], np.uint8), count=end - at)
            at = end
        keep &= mark[place]
    return keep


def _distinct(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the group of each window, hash, second hash, least id of each group), groups in order of their hashes."""
    order = np.lexsort((ids, g, h))
    sh, sg = h[order], g[order]
    new = np.ones(len(order), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sg[1:] != sg[:-1])
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(new) - 1
    return groups, sh[new], sg[new], ids[order][new]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out, n_words, n_removed, kept = deduplicated(texts(docs))
    return out.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_removed).alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows taken out of the texts; a text that loses none stays as it is. n_chars, where there is one, follows the text."""
    out, _, n_removed, kept = deduplicated(docs)
    cut = F.col(n_removed) > 0
    text = F.when(cut, F.col(kept)).otherwise(F.col("text"))
    counted = F.when(cut, F.char_length(kept).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[text.alias(c) if c == "text" else counted.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
