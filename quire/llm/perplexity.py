"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order five, so that its words are a closed set and invented or misspelt words
are judged by their spelling. It is trained on all documents labelled good outside the held-out fold. A document passes if its perplexity is at most the given
quantile of its language's held-out good documents, times a margin. Both are taken from the perplexity less an allowance for short texts.

Neither ids nor counts are broadcast. A bucket of documents sends its distinct 5-grams to shards by their third and
fourth byte; a shard has all counts whose contexts hold these two bytes there, which are those of orders
five, four and three, and answers with a probability for each 5-gram asked. Orders two and one have at most
65,792 entries and go along with the discounts.

Cases: a null or empty text is its end alone; a null language is a language of its own; a language without
held-out good documents gets the quantile of all, and without any everything is kept; without good documents
to learn from the model is uniform; repeated rows get equal scores; an empty table gives an empty result;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, flat, pieces_of, text_bytes, texts, written
from quire.llm.hashing import joined_bytes
from quire.llm.simhash import sieve

ORDER = 5
FOLDS = 5
QUANTILE, MARGIN = 0.99, 1.05
SLACK = 2.0  # bits a byte, over the root of the length: a short text's perplexity strays more
BUCKET_BYTES = 12 << 20
LEAST_BUCKETS = 64
SHARDS = 64  # at least
SHARD_GRAMS = 1 << 20  # 5-grams of a shard, about
HELD_GRAMS = 1 << 22  # 5-grams that a task counts before it gives them on
MOST_LANGUAGES = 4096  # whose thresholds are broadcast; more are joined
SLICE = 2 << 20


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 5-gram) of each byte of the texts and of their ends: the byte and the four before it, zeros outside the text. Bytes are ordered third, fourth, first, second, fifth."""
    text = flat(text)
    sizes = np.asarray(pc.binary_length(text), dtype=np.int64)
    data = np.zeros(int((sizes + 5).sum()), np.uint8)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    raw = np.frombuffer(joined_bytes(text), np.uint8)
    data[np.arange(len(raw)) + 5 * rows + 4] = raw
    ends = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(ends)) + 4 * ends + 4
    out = np.zeros(len(at), np.int64)
    for back in (2, 1, 4, 3, 0):
        out = out << 8 | data[at - back]
    return ends, out


def _slices(text: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    batch = pa.RecordBatch.from_arrays([flat(text)], ["text"])
    at = 0
    for part in pieces_of(batch, limit=SLICE):
        yield at, part.column(0)
        at += part.num_rows


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes that come first in a code, mixed."""
    return ((codes >> 24) * 40503 >> 4 & 0xFFFF) % shards


@dataclass
class Discounts:
    """Of each order: for counts 1, 2 and more."""

    of: dict[int, tuple[float, float, float]]
    two: np.ndarray  # P(e | d) of the lower orders, 256 x 256, by fourth and fifth byte


def _discount(n: list[int]) -> tuple[float, float, float]:
    """From the numbers of n-grams with counts 1 to 4; where one is missing, a half, one and one and a half."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(k - 0.05, max(0.05, d)) for k, d in zip((1, 2, 3), raw, strict=True))


def _minus(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _grouped(keys: np.ndarray, counts: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, total count, mass that the discounts set free) of sorted keys."""
    contexts, first = np.unique(keys, return_index=True)
    if not len(contexts):
        return contexts, np.zeros(0), np.zeros(0)
    return contexts, np.add.reduceat(counts, first).astype(float), np.add.reduceat(_minus(counts, d), first)


def _lookup(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)."""
    place = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
    return place, (known[place] == asked) if len(known) else np.zeros(len(asked), bool)


def _level(asked: np.ndarray, context: np.ndarray, keys: np.ndarray, counts: np.ndarray, key_context: np.ndarray, lower: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Interpolated probability of one order. asked, context: of the 5-grams asked; keys (sorted), counts, key_context: of the n-grams counted; lower: the next order's probability."""
    order = np.argsort(key_context, kind="stable")
    contexts, total, free = _grouped(key_context[order], counts[order], d)
    place, seen = _lookup(contexts, context)
    if not len(contexts):
        return lower
    at, there = _lookup(keys, asked)
    own = np.where(there, counts[at], 0)
    return np.where(seen, (own - _minus(own, d) + free[place] * lower) / np.where(seen, total[place], 1), lower)


def probabilities(asked: np.ndarray, known: np.ndarray, counts: np.ndarray, fit: Discounts) -> np.ndarray:
    """log2 P(last byte | four before) of sorted 5-gram codes, from the shard's counted 5-grams (sorted by code)."""
    # code: c d a b e
    b, e = (lambda x: x >> 8 & 255), (lambda x: x & 255)
    low = fit.two[asked >> 24 & 255, e(asked)]
    cde = lambda x: (x >> 24) << 8 | e(x)
    bcde = lambda x: (x >> 24) << 16 | b(x) << 8 | e(x)
    cd, bcd, abcd = (lambda x: x >> 24), (lambda x: (x >> 24) << 8 | b(x)), (lambda x: x >> 8)
    four, n4 = np.unique(bcde(known), return_counts=True)  # different first bytes
    three, n3 = np.unique((four >> 16) << 8 | four & 255, return_counts=True)  # different second bytes
    p = _level(cde(asked), cd(asked), three, n3, three >> 8, low, fit.of[3])
    p = _level(bcde(asked), bcd(asked), four, n4, four >> 8, p, fit.of[4])
    p = _level(asked, abcd(asked), known, counts, known >> 8, p, fit.of[5])
    return np.log2(p)


def trusted(labels: DataFrame) -> DataFrame:
    """The ids of all good documents outside the held-out fold."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1")
    return good.where(crc_mod(F.col("doc_id"), FOLDS) != 0).select("doc_id")


def trained(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Discounts]:
    """(the counted 5-grams: code, n; the discounts and low orders) of the documents with these ids. Texts of other ids are left out before the shuffle, but for a few; an id's rows count as one, with the least text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            for part in pieces_of(batch, limit=SLICE):
                held.append(np.unique(grams(part.column("text"))[1], return_counts=True))
                if sum(len(c) for c, _ in held) > HELD_GRAMS:
                    held = [merged()]
                    if len(held[0][0]) > HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["code", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["code", "n"])

    ids = written(ids.select("doc_id"), "trusted")
    some = sieve(texts(docs), "doc_id", ids)
    own = some.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = own.select("text").mapInArrow(count, "code long, n long")
    five = written(rows.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    four = five.groupBy(F.expr("((code >> 24) << 16) | (((code >> 8) & 255) << 8) | (code & 255)").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    three = four.groupBy(F.expr("((code >> 16) << 8) | (code & 255)").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    two = three.groupBy(F.expr("code & 65535").alias("code")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65,536 rows
    few = lambda t: [int(x) for x in t.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()]
    of = {5: _discount(few(five)), 4: _discount(few(four)), 3: _discount(few(three))}
    n2 = np.zeros((256, 256), np.int64)
    for r in two:
        n2[r["code"] >> 8, r["code"] & 255] = r["n"]
    n1 = (n2 > 0).sum(0)
    d2, d1 = (_discount([int((x == k).sum()) for k in (1, 2, 3, 4)]) for x in (n2, n1))
    uniform = np.full(256, 1 / 256)
    one = (n1 - _minus(n1, d1) + _minus(n1, d1).sum() * uniform) / n1.sum() if n1.sum() else uniform
    total = n2.sum(1, keepdims=True)
    lower = np.where(total > 0, (n2 - _minus(n2, d2) + _minus(n2, d2).sum(1, keepdims=True) * one) / np.maximum(total, 1), one)
    return five, Discounts(of, lower)


_LINK = "shard int, bucket int, codes binary, logs binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary()), ("logs", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _bucket_codes(text: pa.Array, shards: int) -> list[np.ndarray]:
    """The distinct codes of a bucket by shard, sorted."""
    parts = [np.asarray(pc.unique(pa.array(grams(t)[1]))) for _, t in _slices(text)]
    codes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    shard = shard_of(codes, shards)
    order = np.argsort(shard, kind="stable")
    return np.split(codes[order], np.searchsorted(shard[order], np.arange(1, shards)))


def document_bits(docs: DataFrame, five: DataFrame, fit: Discounts) -> DataFrame:
    """doc_id, lang, n (bytes and the end), bits (-log2 of the text's probability) of every document."""
    base = texts(docs, F.col("lang").cast("string").alias("lang"))
    buckets = max(LEAST_BUCKETS, text_bytes(base) // BUCKET_BYTES)
    shards = max(SHARDS, five.count() // SHARD_GRAMS)
    bucketed = base.withColumn("bucket", F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(buckets)).cast("int"))
    counted = five.withColumn("shard", F.expr(f"cast((((code >> 24) * 40503 >> 4) & 65535) % {shards} as int)"))

    def asked(table):
        if not table.num_rows:
            return _rows([])
        out = []
        for shard, codes in enumerate(_bucket_codes(table["text"], shards)):
            if len(codes):
                gaps = np.diff(codes, prepend=0)
                out.append((shard, table["bucket"][0].as_py(), gaps.astype("<u4" if gaps.max() < 1 << 32 else "<u8").tobytes() + bytes([4 if gaps.max() < 1 << 32 else 8]), None))
        return _rows(out)

    def answered(links, counts):
        if not links.num_rows:
            return _rows([])
        parts = links.to_pylist()
        codes = [np.cumsum(np.frombuffer(p["codes"][:-1], f"<u{p['codes'][-1]}").astype(np.int64)) for p in parts]
        every = np.unique(np.concatenate(codes))
        known, n = np.asarray(counts["code"], dtype=np.int64), np.asarray(counts["n"], dtype=np.int64)
        order = np.argsort(known)
        logs = probabilities(every, known[order], n[order], fit).astype("<f4")
        return _rows([(p["shard"], p["bucket"], None, logs[np.searchsorted(every, c)].tobytes()) for p, c in zip(parts, codes, strict=True)])

    def summed(texts_, answers):
        names = ["doc_id", "lang", "n", "bits"]
        if not texts_.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.float64())], names=names)
        got = {x["shard"]: np.frombuffer(x["logs"], "<f4") for x in answers.to_pylist()}
        by_shard = _bucket_codes(texts_["text"], shards)
        codes = np.concatenate(by_shard)
        logs = np.concatenate([got[s] for s, c in enumerate(by_shard) if len(c)])
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order].astype(float)
        n, bits = np.zeros(texts_.num_rows, np.int64), np.zeros(texts_.num_rows)
        for at, part in _slices(texts_["text"]):
            rows, own = grams(part)
            coded = pa.array(own).dictionary_encode()
            value = logs[np.searchsorted(codes, np.asarray(coded.dictionary))][np.asarray(coded.indices)]
            n[at : at + len(part)] = np.bincount(rows, minlength=len(part))
            bits[at : at + len(part)] = -np.bincount(rows, value, len(part))
        return pa.table([flat(texts_["doc_id"]), flat(texts_["lang"]), pa.array(n), pa.array(bits)], names=names)

    links = bucketed.groupBy("bucket").applyInArrow(asked, _LINK)
    answers = links.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(answered, _LINK)
    return bucketed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(summed, "doc_id long, lang string, n long, bits double")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (per byte), adjusted (less the allowance for short texts), threshold, keep of every document."""
    scores = written(document_bits(docs, *trained(docs, trusted(labels))).withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits") / F.col("n"))).withColumn("adjusted", F.pow(F.lit(2.0), F.col("bits") / F.col("n") - SLACK / F.sqrt("n"))), "bits")
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    held = scores.where(crc_mod(F.col("doc_id"), FOLDS) == 0).join(good, "doc_id", "left_semi")
    cut = F.percentile_approx("adjusted", quantile, 10_000)
    # a row a language, "n" a null one and "s" + name another; broadcast only where there are few
    own = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    by_lang = written(held.groupBy(own(F.col("lang")).alias("own")).agg(cut.alias("own_cut")), "cuts")
    by_lang = F.broadcast(by_lang) if by_lang.count() <= MOST_LANGUAGES else by_lang
    overall = held.agg(cut.alias("all_cut")).first()["all_cut"]
    joined = scores.withColumn("own", own(F.col("lang"))).join(by_lang, "own", "left")
    limit = F.coalesce("own_cut", F.lit(overall).cast("double"), F.lit(float("inf"))) * margin
    return joined.select("doc_id", "lang", (F.col("n") - 1).alias("n_bytes"), "perplexity", "adjusted", limit.alias("threshold"), (F.col("adjusted") <= limit).alias("keep"))
