"""Phrase collocation mining by pivot partitioning, as in MG-FSM (op13).

Words are put in one total order of a language, rarest first. Every n-gram belongs to its rarest word, the pivot (the first of several
equal ones). So each word of a piece sends its pivot the fragment around it, rewritten: it ends before the first word that is rarer
(to the left: or equal), as no n-gram of this pivot goes beyond it. Equal fragments of a task's slice are one row with a count.
A pivot's n-grams are then counted where its fragments are; what a fragment gives are n-grams that hold its pivot, so each
occurrence is counted once and no other task has it. Rare pivots have few fragments, and common ones few different ones; pivots above
HEAVY words are dealt to several tasks by fragment, and their counts are added up.

The order comes from a count-min sketch of the exact word counts (CELLS cells in two rows, whatever the input; it never
underestimates), with ties by bytes. Words that the sketch says are below the least count are no part of any phrase that has it,
and end fragments. The sketch decides only who counts an n-gram and what is left out early: all counts are exact.

Nulls: a null text has no words, a null language is "und". Rows repeated count each time; ids and other columns aren't used. An empty table
gives no rows. Texts of any length are read in stretches of STRETCH words that overlap by the longest phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import mix64, pieces_of, written
from quire.llm.hashing import word_hashes

LEAST = 10
LONGEST = 3
TOP = 2_000
CELLS = 1 << 20
HEAVY = 1 << 20
STRETCH = 500_000
UNKNOWN = "und"

# The characters between words and between pieces, all of one byte.
BETWEEN_WORDS = b"\x20\x09"
BETWEEN_PIECES = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BETWEEN_WORDS)] = 1
_KIND[list(BETWEEN_PIECES)] = 2


class Words:
    """The words of some texts in order: bytes, places, and the piece and text of each."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(pc.ascii_lower(texts.cast(pa.large_string())), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        ends = offsets - offsets[0]
        kind = _KIND[data]
        word = kind == 0
        edge = np.zeros(len(data) + 1, bool)  # a text begins
        edge[ends] = True
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        self.data = data
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.row = np.searchsorted(ends, self.starts, "right") - 1
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.starts) + self.row

    def __len__(self) -> int:
        return len(self.starts)

    def strings(self, lo: int, hi: int) -> pa.Array:
        """Words lo to hi as one array."""
        starts, sizes = self.starts[lo:hi], self.ends[lo:hi] - self.starts[lo:hi]
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(self.data[at]))


def _coded(words: Words, langs: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(number of each word's (language, word) pair, languages and words of the pairs)."""
    lang, text = langs.dictionary_encode(), words.strings(lo, hi).dictionary_encode()
    both = np.asarray(lang.indices, dtype=np.int64)[words.row[lo:hi]] * max(1, len(text.dictionary)) + np.asarray(text.indices, dtype=np.int64)
    pairs, code = np.unique(both, return_inverse=True)
    return code, lang.dictionary.take(pa.array(pairs // max(1, len(text.dictionary)))), text.dictionary.take(pa.array(pairs % max(1, len(text.dictionary))))


def _spoken(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: all occurrences, repeats included. docs: lang, text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                words = Words(part.column("text"))
                for lo in range(0, len(words), STRETCH):
                    code, lang, word = _coded(words, part.column("lang"), lo, min(len(words), lo + STRETCH))
                    yield pa.RecordBatch.from_arrays([lang, word.cast(pa.string()), pa.array(np.bincount(code).astype(np.int64))], ["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """64 bits of each pair; a word holds no tab, so joined pairs are as different as the pairs."""
    return word_hashes(pc.binary_join_element_wise(langs.cast(pa.string()), words.cast(pa.string()), "\t"))[0]


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(20 * row) & np.uint64(CELLS - 1)).astype(np.int64) for row in range(2)]


def sketched(counts: DataFrame) -> np.ndarray:
    """(2, CELLS): the count-min sketch of lang, word, n. At most 2 CELLS rows come to the driver, whatever the table."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"), dtype=np.int64)
            for row, at in enumerate(_cells(_hashes(batch.column("lang"), batch.column("word")))):
                used, which = np.unique(at, return_inverse=True)
                sums = np.zeros(len(used), np.int64)
                np.add.at(sums, which, n)
                yield pa.RecordBatch.from_arrays([pa.array(used + row * CELLS), pa.array(sums)], ["cell", "n"])

    rows = counts.mapInArrow(cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    out = np.zeros(2 * CELLS, np.float32)
    out[np.asarray(rows.column("cell"))] = np.asarray(rows.column("n"))
    return out.reshape(2, CELLS)


def _fragments(words: Words, langs: pa.Array, lo: int, hi: int, sketch: np.ndarray, least: int, longest: int) -> pa.RecordBatch:
    """The fragments of the words lo to hi: key (pivot and deal), shape (words on its left, times 64, and on its right, negative and one less where the pivot is dealt), lang, left, pivot, right, n."""
    reach = longest - 1
    a, b = max(0, lo - reach), min(len(words), hi + reach)
    code, lang, word = _coded(words, langs, a, b)
    hashes = _hashes(lang, word)
    counts = np.min([sketch[row, at] for row, at in enumerate(_cells(hashes))], axis=0)
    order = np.asarray(pc.sort_indices(pa.table({"n": counts, "word": word}), [("n", "ascending"), ("word", "ascending")]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank[counts < least] = -1
    rank, piece = rank[code], words.piece[a:b]

    core = np.arange(lo - a, hi - a)
    core = core[rank[core] >= 0]
    columns = [np.zeros(len(core), np.int64) for _ in range(2 * reach + 1)]  # numbers of pairs from 1, 0: no word
    columns[reach] = code[core] + 1
    for side in (-1, 1):
        going = np.ones(len(core), bool)
        for step in range(1, reach + 1):
            at = core + side * step
            inside = (at >= 0) & (at < len(code))
            at = np.where(inside, at, 0)
            going &= inside & (piece[at] == piece[core]) & ((rank[at] > rank[core]) if side < 0 else (rank[at] >= rank[core]))
            columns[reach + side * step] = np.where(going, code[at] + 1, 0)
    more = (columns[reach - 1] > 0) | (columns[reach + 1] > 0)
    columns = [c[more] for c in columns]

    bits = max(1, int(len(hashes)).bit_length())
    keys, width = [], 63 // bits
    for i in range(0, len(columns), width):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[i : i + width]:
            key = key << bits | c
        keys.append(key)
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(by)))
    columns = [c[by[first]] for c in columns]
    pivot = columns[reach] - 1

    parts = np.int64(1) + (counts[pivot] / HEAVY).astype(np.int64)
    mixed = np.zeros(len(pivot), np.uint64)
    for c in columns:
        mixed = mix64(mixed + np.where(c > 0, hashes[c - 1], np.uint64(0)))
    deal = mixed % parts.astype(np.uint64)
    held = [(c > 0).astype(np.int64) for c in columns]
    shape = 64 * sum(held[:reach], np.zeros(len(pivot), np.int64)) + sum(held[reach + 1 :])
    strings = [word.take(pa.array(c - 1, mask=c == 0)).cast(pa.string()) for c in columns]
    for near in (reach - 1, reach + 1):  # a row of nulls only would be left out below
        strings[near] = pc.fill_null(strings[near], "")
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(mix64(hashes[pivot] + deal).view(np.int64)),
            "shape": pa.array(np.where(parts == 1, shape, -1 - shape).astype(np.int32)),
            "lang": lang.take(pa.array(pivot)),
            "left": pc.binary_join_element_wise(*strings[:reach], " ", null_handling="skip"),
            "pivot": strings[reach],
            "right": pc.binary_join_element_wise(*strings[reach + 1 :], " ", null_handling="skip"),
            "n": pa.array(n.astype(np.int64)),
        }
    )


def phrase_counts(docs: DataFrame, counts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a: the phrases of 2 to `longest` (64 at most) words that occur `least` times or more in pieces of docs (lang, text without nulls)."""
    sketch = docs.sparkSession.sparkContext.broadcast(sketched(counts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                words = Words(part.column("text"))
                for lo in range(0, len(words), STRETCH):
                    yield _fragments(words, part.column("lang"), lo, min(len(words), lo + STRETCH), sketch.value, least, longest)

    reach = longest - 1
    sent = docs.mapInArrow(route, "key bigint, shape int, lang string, left string, pivot string, right string, n bigint").repartition("key")
    shape = F.when(F.col("shape") < 0, -1 - F.col("shape")).otherwise(F.col("shape"))
    # the n-grams of a fragment that hold its pivot: null where one goes beyond it
    sizes = [(x, y) for x in range(reach + 1) for y in range(reach + 1) if 2 <= x + y + 1 <= longest]
    own = [F.when((shape >= 64 * x) & (shape % 64 >= y), _around(x, y)) for x, y in sizes]
    grams = sent.select("key", (F.col("shape") >= 0).alias("whole"), "lang", F.explode(F.array(*own)).alias("phrase"), "n").where("phrase IS NOT NULL")
    mined = grams.groupBy("key", "whole", "lang", "phrase").agg(F.sum("n").alias("n")).where(~F.col("whole") | (F.col("n") >= least))
    return mined.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _around(x: int, y: int) -> Column:
    """The pivot with the x words before it and the y words after it."""
    left = [F.substring_index("left", " ", -x), F.lit(" ")] if x else []
    right = [F.lit(" "), F.substring_index("right", " ", y)] if y else []
    return F.concat(*left, F.col("pivot"), *right)


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: each phrase with its lowest-scoring cut, floor(10**6 a a / (l r)), ties to the first. Exact for counts below 10**16.

    phrases: lang, phrase, a, with all phrases that theirs begin or end with; counts: lang, word, n.
    """
    known = counts.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.withColumns({"first": _joined(words, 1, F.col("k")), "rest": _joined(words, F.col("k") + 1, F.size(words) - F.col("k"))})
    left, right = (known.select("lang", F.col("part").alias(p), F.col("f").alias(f)) for p, f in (("first", "l"), ("rest", "r")))
    whole = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * 1000000) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return whole.groupBy("lang", "phrase").agg(F.max("a").alias("a"), cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: of phrases inside longer ones, the count of the most frequent longer one."""
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.size(words) - 1)
    inside = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size(words) - s + 1), lambda i: _joined(words, i, s))))
    return phrases.where(F.size(words) > 2).select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then a, then their bytes. Phrases that a longer one has at least half the time are left out."""
    spoken = _spoken(docs)
    counts = written(word_counts(spoken), "words")
    phrases = written(phrase_counts(spoken, counts, least, longest), "phrases")
    often = counts.where(F.col("n") >= least)
    kept = scored(phrases, often).join(covered(phrases), ["lang", "phrase"], "left").where("most is null or 100 * most < 50 * a")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
