"""A toxicity classifier that is regularised by counterfactuals.

A sparse logistic model over hashed words. For each labelled text that names an identity, counterfactual
texts have one term swapped for another of its list; the squared change of the score between the two is part
of the loss, so that a group's name alone moves no score, and neutral mentions stay neutral. The lists are
a parameter, one a language, and one more is mined from the labelled texts: the words that at least `NEUTRAL`
of the texts labelled 0 have. These mark a language, a dialect or a topic, so a whole group, and aren't what makes a text
toxic; without them a corpus in which no listed term occurs would be fitted without a counterfactual.

It is fitted on the driver on a bounded sample of labelled rows (`most_rows`, the least by a hash of the id) and the
`MOST_FEATURES` features that most of them have; scoring is a map over documents with the nonzero weights.

Cases: a null text is empty and gets the score of the intercept alone; a label that is null is no label;
several labels of one document count as their maximum, several rows of one id as the least text; with no labelled rows, or labels of one kind only,
the model is the intercept of the smoothed rate, a quarter without any; extra columns are left out by `scored` and kept by `without_toxic`.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc_mod, fresh, give_back, mix64, pieces_of, removed, texts, words_of, written

BITS = 20
FEATURES = 1 << BITS
MOST_ROWS = 20_000
FOLDS = 5

NEUTRAL = 0.02  # of the rows labelled 0
MOST_FEATURES = 1 << 17

#: Terms that name a group, by language; those of a list are swapped for one another.
IDENTITY_TERMS = {
    "en": (
        "women men woman man girls boys gay lesbian straight bisexual transgender queer muslim muslims christian christians "
        "jewish jews hindu buddhist atheist catholic black white asian african european american mexican latino arab indian "
        "chinese russian german french spanish immigrant immigrants refugee refugees disabled deaf blind old young elderly"
    ).split(),
    "de": "frauen männer frau mann schwul lesbisch muslim muslime christ christen jude juden deutsche türken araber flüchtling flüchtlinge ausländer behinderte alte junge".split(),
    "fr": "femmes hommes femme homme gay lesbienne musulman musulmans chrétien chrétiens juif juifs français arabe arabes immigré immigrés réfugié réfugiés handicapé vieux jeunes".split(),
    "es": "mujeres hombres mujer hombre gay lesbiana musulmán musulmanes cristiano cristianos judío judíos español árabe árabes inmigrante inmigrantes refugiado refugiados discapacitado viejos jóvenes".split(),
}

_EDGES = ".,;:!?\"'()[]{}<>*#%$&~`-_/\\|"


def _features(words: pa.Array) -> np.ndarray:
    """The feature of each word: lower case, without punctuation at its ends, hashed."""
    coded = words.dictionary_encode()
    plain = pc.ascii_lower(pc.ascii_trim(coded.dictionary, characters=_EDGES))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), "\n")[0].as_py() if len(plain) else ""
    mask = FEATURES - 1
    hashed = np.fromiter((zlib.crc32(w) & mask for w in joined.encode().split(b"\n")), np.int64, max(1, len(plain)))
    return hashed[np.asarray(coded.indices, dtype=np.int64)]


def _feature(word: str) -> int:
    return zlib.crc32(word.encode()) & FEATURES - 1


@dataclass
class Model:
    intercept: float
    features: np.ndarray  # sorted
    weights: np.ndarray
    pairs: int = 0  # counterfactuals that the fit compared

    def scores(self, text: pa.Array) -> np.ndarray:
        """The score of each text: each feature counts once, however often it occurs."""
        rows, words = words_of(text)
        z = np.full(len(text), self.intercept)
        if len(words) and len(self.features):
            f = _features(words)
            place = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            hit = self.features[place] == f
            once = np.unique(rows[hit] * len(self.features) + place[hit])
            z += np.bincount(once // len(self.features), self.weights[once % len(self.features)], len(text))
        return 1 / (1 + np.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, folds: int = FOLDS) -> DataFrame:
    """(doc_id, toxic, features) of at most `most_rows` labelled rows outside the held-out fold: a row an id, with the least of its texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.where(crc_mod(F.col("doc_id"), folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                rows, words = words_of(part.column("text"))
                code = np.unique(rows * FEATURES + _features(words)) if len(words) else np.zeros(0, np.int64)
                ends = np.searchsorted(code, (np.arange(part.num_rows + 1)) * FEATURES).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((code % FEATURES).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), lists], ["doc_id", "toxic", "features"])

    # at most `most_rows` ids and labels are broadcast
    own = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return own.mapInArrow(features, "doc_id long, toxic int, features array<int>")


PARTNERS = 8
BLOCK = 2000  # rows of the fit that are worked on at a time


class Rows:
    """The rows' features as places in `kept`, row after row. Products go block by block, so that what is made on the way is small beside the rows."""

    def __init__(self, lists: pa.ListArray, kept: np.ndarray):
        flat, sizes = np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists), dtype=np.int64)
        ends, parts, counts = np.concatenate([[0], np.cumsum(sizes)]), [], []
        for lo in range(0, len(sizes), BLOCK):
            hi = min(len(sizes), lo + BLOCK)
            own = flat[ends[lo] : ends[hi]]
            place = np.minimum(np.searchsorted(kept, own), len(kept) - 1)
            hit = kept[place] == own
            parts.append(place[hit].astype(np.int32))
            counts.append(np.bincount(np.repeat(np.arange(hi - lo), sizes[lo:hi])[hit], minlength=hi - lo))
        self.n, self.n_kept = len(sizes), len(kept)
        self.blocks = [(lo, lo + len(c), x, c) for lo, x, c in zip(range(0, max(1, self.n), BLOCK), parts, counts, strict=False)]

    def times(self, v: np.ndarray) -> np.ndarray:
        """The sum over each row's features."""
        return np.concatenate([np.bincount(np.repeat(np.arange(hi - lo), c), v[x], hi - lo) for lo, hi, x, c in self.blocks])

    def back(self, z: np.ndarray) -> np.ndarray:
        """The sum over each feature's rows."""
        out = np.zeros(self.n_kept)
        for lo, hi, x, c in self.blocks:
            out += np.bincount(x, np.repeat(z[lo:hi], c), self.n_kept)
        return out


def swaps(rows: Rows, y: np.ndarray, kept: np.ndarray, terms: dict[str, list[str]], neutral: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n): so many of the rows have feature a (a place in `kept`) swapped for b. Each term of a row gives one counterfactual, with one of the PARTNERS terms after it in its list (in the order of their hashed features), which a hash of row and term picks. The last list is mined; a term is of the first list that has it."""
    own = np.full(len(kept), -1)
    lists = [[_feature(w) for w in ws] for ws in terms.values()]
    lists.append(kept[rows.back(1.0 - y) >= max(2, neutral * (y == 0).sum())].tolist())
    members = []
    for k, features in enumerate(lists):
        place = np.searchsorted(kept, features)
        found = np.unique([p for p, f in zip(place.tolist(), features, strict=True) if p < len(kept) and kept[p] == f and own[p] < 0]).astype(np.int64)
        if len(found) > 1:
            own[found] = k
        members.append(found)
    codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi, x, c in rows.blocks:
        row, out = np.repeat(np.arange(lo, hi), c), [codes]
        for k, found in enumerate(members):
            at = np.flatnonzero(own[x] == k) if len(found) > 1 else np.zeros(0, np.int64)
            term = x[at].astype(np.int64)
            step = mix64((row[at] * len(kept) + term).astype(np.uint64)) % np.uint64(max(1, min(PARTNERS, len(found) - 1)))
            out.append(term * len(kept) + found[(np.searchsorted(found, term) + 1 + step.astype(np.int64)) % max(1, len(found))] if len(at) else at)
        both, which = np.unique(np.concatenate(out), return_inverse=True)
        added = np.ones(len(which), np.int64)
        added[: len(times)] = times
        codes, times = both, np.bincount(which, added, len(both)).astype(np.int64)
    return codes // len(kept), codes % len(kept), times


def fitted(rows: pa.Table, least: int = 5, l1: float = 1.0, l2: float = 0.005, fair: float = 2.0, rounds: int = 400, terms: dict[str, list[str]] = IDENTITY_TERMS, neutral: float = NEUTRAL) -> Model:
    """Proximal gradient descent with momentum on logistic loss + l1 + l2 + fair * (score change under swaps)².

    least: a feature counts if so many rows have it; neutral: the share of rows labelled 0 that makes a word a mined term (above 1: none).
    The order of the rows has no effect beyond rounding: they are sorted by id. It ends early when a round moves no weight by 1e-5.
    """
    rows = rows.sort_by("doc_id")
    y = (np.asarray(rows["toxic"], dtype=float) > 0).astype(float)
    n, rate = len(y), (y.sum() + 0.5) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    lists = rows["features"].combine_chunks()
    flat = np.asarray(lists.flatten())
    kept = np.flatnonzero(np.bincount(flat, minlength=1) >= least) if len(flat) else np.zeros(0, np.int64)
    if not len(kept) or y.min() == y.max():
        return Model(base, np.zeros(0, np.int64), np.zeros(0))
    x = Rows(lists, kept)
    del rows, lists, flat  # the driver's memory is small
    # a swap of term a for term b changes the score by w[b] - w[a]
    a, b, times = swaps(x, y, kept, terms, neutral)
    w, b0 = np.zeros(len(kept)), base
    v, v0, t = w.copy(), b0, 1.0
    spectral, direction = 1.0, np.ones(len(kept))  # the step follows from a power iteration
    for _ in range(15):
        direction = x.back(x.times(direction))
        spectral = np.linalg.norm(direction)
        direction /= spectral
    step = 1 / (0.25 * (spectral + n) + l2 * n + 2 * fair * (np.bincount(a, times, len(kept)) + np.bincount(b, times, len(kept))).max())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(v0 + x.times(v))))
        g = x.back(p - y) + l2 * v
        if len(a):
            change = fair * times * (v[b] - v[a])
            g += np.bincount(b, change, len(kept)) - np.bincount(a, change, len(kept))
        moved = v - step * g
        new, new0 = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), v0 - step * (p - y).sum()
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v0, t = new + (t - 1) / faster * (new - w), new0 + (t - 1) / faster * (new0 - b0), faster
        still = max(np.abs(new - w).max(), abs(new0 - b0)) < 1e-5
        w, b0 = new, new0
        if still:
            break
    full = np.flatnonzero(w)
    return Model(float(b0), kept[full], w[full], int(times.sum()))


def model(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, least: int = 5, **how) -> Model:
    """The driver gets at most `most_rows` rows, each with those of at most MOST_FEATURES features that it has."""
    rows = written(labelled(docs, labels, most_rows), "labelled")
    counted = rows.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = np.sort(np.asarray(counted.orderBy(F.desc("n"), "f").limit(MOST_FEATURES).select("f").toArrow()["f"], dtype=np.int32))

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat_, sizes = np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists), dtype=np.int64)
            place = np.minimum(np.searchsorted(kept, flat_), max(0, len(kept) - 1))
            hit = kept[place] == flat_ if len(kept) else np.zeros(len(flat_), bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat_[hit]))], ["doc_id", "toxic", "features"])

    fit = fitted(rows.mapInArrow(slim, "doc_id long, toxic int, features array<int>").toArrow(), least, **how)
    removed(rows)
    gc.collect()
    give_back()  # the fit's arrays
    return fit


def _scores(docs: DataFrame, fit: Model, text: str, score: str) -> DataFrame:
    """docs with the column `score`; `text` names a column without nulls."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fit.scores(part.column(text)))], [*part.schema.names, score])

    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rate, f"{whole}, `{score}` double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, counterfactual_pairs (that the fit compared) of every document."""
    fit = model(docs, labels)
    out = _scores(texts(docs), fit, "text", "score")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(fit.pairs).cast("long").alias("counterfactual_pairs"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't take for toxic, with all their columns."""
    text, score = fresh(docs, "text", "score")
    own = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    return _scores(own, model(docs, labels), text, score).where(F.col(score) < 0.5).select(*docs.columns)
