"""Language-model scores from a subword lattice.

The pieces come from an existing vocabulary; they aren't chosen here. Their scores weight all the ways in
which a word can be cut into pieces, and a forward recursion in log space sums over them, so that a word
has its marginal probability and not that of one segmentation. The vocabulary's own scores (by rank) are
the start; two rounds of expectation-maximisation over the training words' lattices, one count a distinct
word, fit them to the corpus.

There is such a model for each of the classes (the languages with most training texts, and one class for
the rest), and a text's probability is the sum over the classes of the class's share of training texts times
the product over the text's words and its end. The class of the text that is scored isn't looked at. A word
has the class's training counts, discounted by D, plus what the lattice makes of the mass set free:

    P(w) = (max(c - D, 0) + (D V + 1) Q(w)) / (N + 1),   D = n1 / (n1 + 2 n2)

with Q(end) a constant and Q(word) the lattice. Each class sums to one over all words, so that an unknown
word costs what its spelling costs.

Counts cover all training texts and aren't broadcast: a bucket of documents sends its distinct words, with
their counts, to the shards of the words; a shard adds them up and answers with the totals in the order
asked. The piece scores, as many as the vocabulary has, are all that goes to every task.

Cases: a null or empty text is its end alone; with no training texts N and V are 0 and the lattice decides;
repeated rows get equal scores, a null doc_id counts as the empty text's crc (held out); an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, flat, text_bytes, texts, words_of, written
from quire.llm.hashing import Substrings, joined_bytes, word_hashes

FOLDS = 10
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
SHARD_BYTES = 8 << 20  # of text for each shard of the words
LEAST_SHARDS = 64
ROUNDS = 2
CLASSES = 6
Q_END = 1e-3
_NONE = -np.inf
_GAPS = b" \t\n\x0b\f\r"


class Pieces:
    """The vocabulary: bytes of the pieces that lower-case words can have, and a table to find them by hash."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        upper = set(range(65, 91))
        usable = [(p, r) for p, r in ranks.items() if not upper & set(p) and not any(c in _GAPS for c in p[1:]) and (p[0] == 32 or p[0] not in _GAPS)]
        self.pieces = [p for p, _ in usable]
        self.initial = np.array([p[0] == 32 for p in self.pieces])
        prior = np.array([1 / (r + 100) for _, r in usable])
        self.prior = self.normed(prior)
        sizes = np.array([len(p) for p in self.pieces])
        self.lengths = sorted(set(sizes.tolist()))
        self.by_length = {}
        for n in self.lengths:
            own = np.flatnonzero(sizes == n)
            h = Substrings(b"".join(self.pieces[i] for i in own)).hashes(np.arange(len(own)) * n, n)
            bits = int(4 * len(own)).bit_length() + 3
            table = np.full(1 << bits, -1, np.int32)
            slots, rest = (h >> np.uint64(64 - bits)).astype(np.int64), []
            for i, s in zip(range(len(own)), slots.tolist(), strict=True):
                if table[s] < 0:
                    table[s] = i
                else:
                    rest.append(i)
            rest_h = np.array([h[i] for i in rest], np.uint64)
            order = np.argsort(rest_h)
            self.by_length[n] = (own, h, bits, table, rest_h[order], np.array(rest, np.int64)[order])

    def normed(self, p: np.ndarray) -> np.ndarray:
        """Initial pieces sum to one, and so do the others."""
        return p / np.where(self.initial, p[self.initial].sum(), p[~self.initial].sum())

    def find(self, h: np.ndarray, n: int) -> np.ndarray:
        """The piece of each hash of n bytes, or -1."""
        own, known, bits, table, rest, rest_i = self.by_length[n]
        at = table[(h >> np.uint64(64 - bits)).astype(np.int64)]
        out = np.where((at >= 0) & (known[at] == h), own[at], -1)
        if len(rest):
            miss = np.flatnonzero((at >= 0) & (out < 0))
            place = np.minimum(np.searchsorted(rest, h[miss]), len(rest) - 1)
            hit = rest[place] == h[miss]
            out[miss[hit]] = own[rest_i[place[hit]]]
        return out


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """The lattices of words: every piece that a word has somewhere is an arc from its start to its end."""

    def __init__(self, words: pa.Array, vocabulary: Pieces):
        self.v = vocabulary
        spaced = pc.binary_join_element_wise("", flat(words), " ")  # each with its space in front
        self.sizes = np.asarray(pc.binary_length(spaced), dtype=np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        data = joined_bytes(spaced)
        parts, word_of = Substrings(data), np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(data)) - starts[word_of]
        left = self.sizes[word_of] - place
        word, begin, length, piece = [], [], [], []
        for n in self.v.lengths:
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            found = self.v.find(parts.hashes(at, n), n)
            ok = (found >= 0) & (self.v.initial[found] == (place[at] == 0))
            at = at[ok]
            word.append(word_of[at])
            begin.append(place[at])
            length.append(np.full(len(at), n))
            piece.append(found[ok])
        none = [np.zeros(0, np.int64)]
        self.word, self.begin, length, self.piece = (np.concatenate(x or none) for x in (word, begin, length, piece))
        self.end = self.begin + length
        self.orders: dict[bool, tuple] = {}
        self.base = starts + np.arange(len(self.sizes))  # word w's boundaries 0 ... size are at base[w] + ...

    def _sums(self, scores: np.ndarray, back: bool) -> np.ndarray:
        """Forward (or backward) log sums at each boundary, in one step for all words a place. scores: of the arcs."""
        order, to, source, groups, firsts, sizes = self._order(back)
        scores = scores[order]
        out = np.full(int(self.sizes.sum()) + len(self.sizes), _NONE)
        out[self.base + (self.sizes if back else 0)] = 0.0
        for lo, hi, g, h in zip(firsts[:-1], firsts[1:], sizes[:-1], sizes[1:], strict=True):
            terms, own = out[source[lo:hi]] + scores[lo:hi], groups[g:h] - lo
            most = np.maximum.reduceat(terms, own)
            total = np.add.reduceat(np.exp(terms - np.repeat(most, np.diff(own, append=hi - lo))), own)
            out[to[groups[g:h]]] = most + np.log(total)
        return out

    def _order(self, back: bool) -> tuple:
        """The arcs by the place where they end (start), then by word: (order, boundary of each, other boundary, first arc of each word and place, first arc of each place, first of its groups)."""
        if back not in self.orders:
            here, other = (self.begin, self.end) if back else (self.end, self.begin)
            step = (int(self.sizes.max(initial=0)) - here if back else here) * max(1, len(self.sizes))
            order = np.argsort(step + self.word)
            key = (step + self.word)[order]
            groups = np.flatnonzero(np.diff(key, prepend=-1))
            place = key[groups] // max(1, len(self.sizes))
            sizes = np.flatnonzero(np.diff(place, prepend=-1))
            word = self.word[order]
            self.orders[back] = (order, self.base[word] + here[order], self.base[word] + other[order], groups, [*groups[sizes].tolist(), len(order)], [*sizes.tolist(), len(groups)])
        return self.orders[back]

    def scores(self, p: np.ndarray, stop: float) -> np.ndarray:
        return np.log(np.where(self.v.initial, p, p * (1 - stop)))[self.piece]

    def log_probs(self, p: np.ndarray, stop: float) -> np.ndarray:
        """ln of each word's marginal probability."""
        return self._sums(self.scores(p, stop), False)[self.base + self.sizes] + math.log(stop)

    def expected(self, p: np.ndarray, stop: float) -> np.ndarray:
        """The expected number of each piece, one word one count."""
        scores = self.scores(p, stop)
        forth, back = self._sums(scores, False), self._sums(scores, True)
        start = self.base[self.word]
        share = np.exp(forth[start + self.begin] + scores + back[start + self.end] - forth[(self.base + self.sizes)[self.word]])
        return np.bincount(self.piece, share, len(p))


CACHED = 300_000  # words whose spelling a worker keeps
CHUNK = 20_000  # words whose lattices are in memory at once


class Spellings:
    """ln of words' lattice probabilities by class; the first CACHED words that a worker meets are kept, since most words of a bucket are in others too."""

    def __init__(self, models: list, vocabulary: Pieces):
        self.models, self.v, self.slots = models, vocabulary, {}
        self.values = np.zeros((len(models), 0))

    def of(self, words: pa.Array) -> np.ndarray:
        names = _blob(words).decode().split("\n") if len(words) else []
        slot = np.fromiter((self.slots.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        made = np.empty((len(self.models), len(new)))
        for at in range(0, len(new), CHUNK):
            lattices = Lattices(words.take(pa.array(new[at : at + CHUNK])), self.v)
            for row, m in zip(made, self.models, strict=True):
                row[at : at + CHUNK] = lattices.log_probs(m.p, m.stop)
        out = np.empty((len(self.models), len(names)))
        known = slot >= 0
        out[:, known], out[:, new] = self.values[:, slot[known]], made
        if room := max(0, CACHED - len(self.slots)):
            self.slots.update(zip([names[i] for i in new[:room].tolist()], range(len(self.slots), CACHED), strict=False))
            self.values = np.concatenate([self.values, made[:, :room]], axis=1)
        return out


_spellings: dict[str, Spellings] = {}


def spellings(fit: Fit, vocabulary: str) -> Spellings:
    if fit.name not in _spellings:
        _spellings.clear()  # of an earlier fit
        _spellings[fit.name] = Spellings(fit.models, pieces(vocabulary))
    return _spellings[fit.name]


def _blob(words: pa.Array) -> bytes:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), "\n")[0].as_buffer().to_pybytes()


def _unblob(blobs: list[bytes]) -> pa.Array:
    return pc.split_pattern(pa.array([b"\n".join(blobs)], pa.large_binary()).cast(pa.large_string()), "\n").flatten().cast(pa.string())


_LINK = "shard int, bucket int, words binary, counts binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _packed(counts: np.ndarray) -> bytes:
    """A row of counts for each class, each in the least width that holds it."""
    kinds = [np.dtype(k) for k in ("<u1", "<u2", "<u4", "<u8")]
    own = [next(k for k in kinds if k.itemsize == 8 or row.max(initial=0) < 1 << 8 * k.itemsize) for row in counts]
    return bytes(k.itemsize for k in own) + b"".join(row.astype(k).tobytes() for row, k in zip(counts, own, strict=True))


def _unpacked(data: bytes, n_classes: int) -> np.ndarray:
    n = (len(data) - n_classes) // sum(data[:n_classes])
    out, at = np.empty((n_classes, n), np.int64), n_classes
    for row, size in zip(out, data[:n_classes], strict=True):
        row[:] = np.frombuffer(data, f"<u{size}", n, at)
        at += size * n
    return out


def _sharded(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order of distinct words by hash, ends of the shards in it)."""
    h = word_hashes(words)[0]
    order = np.argsort(h, kind="stable")
    return order, np.searchsorted(h[order] >> np.uint64(64 - bits), np.arange(1, (1 << bits) + 1))


def _class_sizes(docs: DataFrame, column: str | None, held: Column) -> tuple[Column, list[int]]:
    """(the class of a row, the number of training texts of each class): the values with most training texts, the rest together last."""
    if column is None or column not in docs.columns:
        return F.lit(0), [docs.where(~held).count()]
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    sizes = docs.where(~held).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "value").limit(CLASSES - 1).collect()
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    place = F.lit(len(top))
    for i, t in enumerate(top):
        place = F.when(value == t["value"], i).otherwise(place)
    return place, [t["n"] for t in top] + [total - sum(t["n"] for t in top)]


def scored(docs: DataFrame, vocabulary: str, folds: int = FOLDS, rounds: int = ROUNDS, class_column: str | None = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score (of the words by their segmentations alone, without counts of words) of every document. vocabulary: a file of base64 pieces and ranks, with all single bytes. The CLASSES - 1 commonest values of class_column have a class each, all others one together."""
    held = crc_mod(F.col("doc_id"), folds) == 0
    place, class_texts = _class_sizes(docs, class_column, held)
    n_classes = len(class_texts)
    base = texts(docs, place.cast("int").alias("class"), held.alias("held_out"))
    n_bytes = text_bytes(base)
    buckets = max(LEAST_BUCKETS, n_bytes // BUCKET_BYTES)
    bits = max(int(LEAST_SHARDS - 1).bit_length(), int(n_bytes // SHARD_BYTES).bit_length())
    bucketed = base.withColumn("bucket", F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(buckets)).cast("int"))

    def distinct(table):
        rows, words = words_of(pc.ascii_lower(flat(table["text"])))
        coded = words.dictionary_encode()
        return rows, np.asarray(coded.indices, dtype=np.int64), coded.dictionary

    def counted(table):
        """The bucket's distinct words by shard, with their counts in the training texts of each class."""
        if not table.num_rows:
            return _rows([])
        rows, which, words = distinct(table)
        train, own = ~np.asarray(table["held_out"])[rows], np.asarray(table["class"], dtype=np.int64)[rows]
        counts = np.bincount((own * len(words) + which)[train], minlength=n_classes * len(words)).reshape(n_classes, len(words))
        order, ends = _sharded(words, bits)
        words, counts, at, out = words.take(pa.array(order)), counts[:, order], 0, []
        for shard, end in enumerate(ends.tolist()):
            if end > at:
                out.append((shard, table["bucket"][0].as_py(), _blob(words.slice(at, end - at)), _packed(counts[:, at:end])))
            at = end
        return _rows(out)

    def summed(table):
        """For each bucket the totals of its words; and, as bucket -1, the shard's training words with theirs."""
        parts = table.to_pylist()
        if not parts:
            return _rows([])
        coded = _unblob([p["words"] for p in parts]).dictionary_encode()
        which, n = np.asarray(coded.indices, dtype=np.int64), len(coded.dictionary)
        counts = [_unpacked(p["counts"], n_classes) for p in parts]
        totals = np.stack([np.rint(np.bincount(which, np.concatenate([c[k] for c in counts]), n)).astype(np.int64) for k in range(n_classes)])
        at, out = 0, []
        for p, c in zip(parts, counts, strict=True):
            out.append((p["shard"], p["bucket"], None, _packed(totals[:, which[at : at + c.shape[1]]])))
            at += c.shape[1]
        known = totals.sum(0) > 0
        if known.any():
            out.append((parts[0]["shard"], -1, _blob(coded.dictionary.filter(pa.array(known))), _packed(totals[:, known])))
        return _rows(out)

    links = written(bucketed.groupBy("bucket").applyInArrow(counted, _LINK).groupBy("shard").applyInArrow(summed, _LINK), "words")
    fit = _fitted(links.where("bucket = -1"), class_texts, vocabulary, rounds)
    answers = links.where("bucket >= 0").select("shard", "bucket", "counts")

    def score(texts_, totals):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        n = texts_.num_rows
        if not n:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        rows, which, words = distinct(texts_)
        order, ends = _sharded(words, bits)
        counts, at = np.zeros((n_classes, len(words)), np.int64), 0
        got = {t["shard"]: t["counts"] for t in totals.to_pylist()}
        for shard, end in enumerate(ends.tolist()):
            if end > at:
                counts[:, order[at:end]] = _unpacked(got[shard], n_classes)
            at = end
        spelled, total = spellings(fit, vocabulary).of(words), counts.sum(0)
        base_sum = np.bincount(rows, fit.base(total)[which], n) + fit.base(np.array([fit.n_ends]))[0]
        by_class = np.stack([np.bincount(rows, m.logs(c, q)[which], n) + m.end for m, c, q in zip(fit.models, counts, spelled, strict=True)])
        by_lattice = np.stack([np.bincount(rows, q[which], n) / math.log(10) + math.log10(m.share) for m, q in zip(fit.models, spelled, strict=True)])
        known = np.bincount(rows, total[which] > 0, n).astype(np.int64) + (fit.n_ends > 0)
        columns = [texts_["doc_id"], texts_["held_out"], np.bincount(rows, minlength=n) + 1, known, np.full(n, fit.n_train), base_sum, _summed(by_class), _summed(by_lattice)]
        return pa.table([flat(c).cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return bucketed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, out)


def _summed(logs: np.ndarray) -> np.ndarray:
    """log10 of the sum over the first axis of what the logs are of."""
    most = logs.max(0)
    return most + np.log10((10.0 ** (logs - most)).sum(0))


class ClassModel:
    """Totals, discount, piece probabilities, the chance that a word ends after a piece; end: log10 of the class's share and of a text's end."""

    def __init__(self, n_words: int, n_types: int, n_ends: int, ones: int, twos: int, share: float, p: np.ndarray, stop: float):
        self.share = share
        self.n, self.n_types = n_words + n_ends, n_types + (n_ends > 0)
        self.discount = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        self.p, self.stop, self.free = p, stop, self.discount * self.n_types + 1
        self.end = float(np.log10(share) + np.log10((max(n_ends - self.discount, 0) + self.free * Q_END) / (self.n + 1)))

    def logs(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of each word; spelled: ln of the lattice's probability."""
        out = np.log10((np.maximum(counts - self.discount, 0) + self.free * (1 - Q_END) * np.exp(np.maximum(spelled, -600))) / (self.n + 1))
        rare = (counts == 0) & (spelled < -600)  # below what a double holds: in logs
        out[rare] = (spelled[rare] + math.log(self.free * (1 - Q_END) / (self.n + 1))) / math.log(10)
        return out


class Fit:
    def __init__(self, models: list[ClassModel], n_types: int, n_ends: int):
        self.models, self.n_ends, self.name = models, n_ends, uuid.uuid4().hex
        self.n_train, self.n_types = sum(m.n for m in models), n_types + (n_ends > 0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n_train + 0.1 * (self.n_types + 1)))


def _fitted(types: DataFrame, class_texts: list[int], vocabulary: str, rounds: int) -> Fit:
    """Sums over the training words: a row of totals a class from each task, and at most a row a piece and class."""
    v, n_classes = pieces(vocabulary), len(class_texts)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((n_classes + 1, 4), np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                c = _unpacked(data, n_classes)
                got[:n_classes] += np.stack([c.sum(1), (c > 0).sum(1), (c == 1).sum(1), (c == 2).sum(1)], 1)
                got[n_classes, 1] += c.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes + 1, dtype=np.int32)), *(pa.array(x) for x in got.T)], ["class", "n", "v", "n1", "n2"])

    sums = types.mapInArrow(totals, "class int, n long, v long, n1 long, n2 long").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).collect()
    known = {r["class"]: (r["n"], r["v"], r["n1"], r["n2"]) for r in sums}
    none = (0, 0, 0, 0)
    p, stop = [v.prior] * n_classes, [0.3] * n_classes
    for _ in range(rounds if known.get(n_classes, none)[1] else 0):

        def expect(batches: Iterator[pa.RecordBatch], p=p, stop=stop) -> Iterator[pa.RecordBatch]:
            own = pieces(vocabulary)
            out = np.zeros((n_classes, len(own.pieces)))
            for batch in batches:
                for words, data in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    words, counts = _unblob([words]), _unpacked(data, n_classes)
                    for k in range(n_classes):
                        here = words.filter(pa.array(counts[k] > 0))
                        for at in range(0, len(here), CHUNK):
                            out[k] += Lattices(here.slice(at, CHUNK), own).expected(p[k], stop[k])
            k, full = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(full.astype(np.int32)), pa.array(out[k, full])], ["class", "piece", "n"])

        rows = types.select("words", "counts").mapInArrow(expect, "class int, piece int, n double").groupBy("class", "piece").agg(F.sum("n").alias("n")).toArrow()
        got = np.zeros((n_classes, len(v.pieces)))
        got[np.asarray(rows["class"]), np.asarray(rows["piece"])] = np.asarray(rows["n"])
        p = [v.normed(g + v.prior * (0.01 * g.sum() + 1) / 2) for g in got]
        stop = [min(0.99, max(0.01, known.get(k, none)[1] / max(1.0, got[k].sum()))) for k in range(n_classes)]
    shares = [(n + 0.5) / (sum(class_texts) + 0.5 * n_classes) for n in class_texts]
    stats = [known.get(k, none) for k in range(n_classes)]
    models = [ClassModel(s[0], s[1], class_texts[k], s[2], s[3], shares[k], p[k], stop[k]) for k, s in enumerate(stats)]
    return Fit(models, known.get(n_classes, none)[1], sum(class_texts))
