"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

Every 23-bit word is within 3 bits of just one of the code's 4096 words. The keys of a segment of a
fingerprint are the codewords nearest to it and to each word one bit away (six of them or one, in the full
23 bits): two segments that differ in at most two bits share a word one bit away from both, or none, and so
a key. A family joins keys of segments: for each segment it takes the segment's bits as they are, or one of
its fuzzy keys. Pigeonholes give families that can't miss: with up to 3 differing bits over four segments of
16, some segment is equal and the next one differs in at most two (EXACT_FAMILIES); with up to 5 over segments
of 23, 23 and 18, two of the three differ in at most two bits each (WIDE_FAMILIES).

Fingerprints, not documents, are joined, each distinct one once. Rows of one key are brought together in
sorted order and walked through as they come; within a key a breadth-first walk compares each fingerprint
with those not reached yet and gives a spanning forest, so a key with n fingerprints gives fewer than n
links and copies are never paired. Links between other fingerprints aren't lost: the forest has the same
components, because a link's two ends share a key.

`without_near_copies`, the pipeline's stage, takes the same keys as its first source of pairs and compares sets of five-word
shingles; what fingerprints miss is found by shingle prefixes, which can't miss (see `near_groups`).

Cases: an empty or null text has fingerprint zero and is linked like any other; equal texts have equal
fingerprints; a text with fewer words than a shingle is one shingle; repeated rows and null ids are rows
like any other; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mix64, pieces_of, removed, texts, tidied, words_of, written
from quire.llm.components import components
from quire.llm.hashing import word_hashes

SEED = 42
SHINGLE = 3
DISTANCE = 3

#: The code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainders(n_bits: int) -> np.ndarray:
    """The remainder of every word of so many bits divided by the generator."""
    x = np.arange(1 << n_bits, dtype=np.int64)
    for i in range(n_bits - 1, 10, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


class Golay:
    """Decoding by syndrome: the remainder of a 23-bit word names the at most three bits in which it is off."""

    def __init__(self):
        self.low = _remainders(12)
        x = np.arange(1 << 11, dtype=np.int64) << 12
        for i in range(22, 10, -1):
            x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
        self.high = x
        self.errors = np.zeros(1 << 11, np.int64)
        bits = [1 << i for i in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = bits[a] | bits[b] | bits[c]
                    self.errors[self.syndrome(np.array([e]))] = e

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.high[x >> 12] ^ self.low[x & 4095]

    def index(self, x: np.ndarray) -> np.ndarray:
        """The index (12 message bits) of the nearest codeword."""
        return (x ^ self.errors[self.syndrome(x)]) >> 11


EXACT_SEGMENTS = (16, 16, 16, 16)
EXACT_FAMILIES = tuple(((i, False), ((i + 1) % 4, True)) for i in range(4))
WIDE_SEGMENTS = (23, 23, 18)
WIDE_FAMILIES = tuple(((i, True), (j, True)) for i, j in ((0, 1), (0, 2), (1, 2)))


def fuzzy_keys(fps: np.ndarray, segments: tuple[int, ...], families: tuple, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) of every distinct key of each; families: (segment, fuzzy) pairs."""
    shifts = np.cumsum((0, *segments))[:-1]
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shifts, segments, strict=True)]
    fuzzy = {}
    for i in {i for family in families for i, soft in family if soft}:
        keys = np.stack([golay.index(parts[i]), *(golay.index(parts[i] ^ (1 << b)) for b in range(segments[i]))], 1)
        keys.sort(axis=1)
        fuzzy[i] = [(np.flatnonzero(new), keys[:, b][new]) for b in range(keys.shape[1]) for new in [np.ones(len(keys), bool) if not b else keys[:, b] != keys[:, b - 1]]]
    rows, out = [], []
    for f, family in enumerate(families):
        which, key = np.arange(len(fps)), np.full(len(fps), f, np.int64)
        for i, soft in family:
            if not soft:
                key = key << segments[i] | parts[i][which]
                continue
            at = np.concatenate([w for w, _ in fuzzy[i]])
            order = np.argsort(at, kind="stable")
            at, values = at[order], np.concatenate([k for _, k in fuzzy[i]])[order]
            begin, end = np.searchsorted(at, which), np.searchsorted(at, which, side="right")
            n = end - begin
            spots = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            which, key = np.repeat(which, n), np.repeat(key, n) << 12 | values[spots]
        rows.append(which)
        out.append(key)
    return np.concatenate(rows), np.concatenate(out)


def fingerprints_of(text: pa.Array, n: int = SHINGLE, weigh: str = "each", seed: int = SEED) -> np.ndarray:
    """A bit is 1 if set in over half of the shingles' XXH64. weigh: "each" counts repeats, "log" weighs a distinct shingle by 1 + log2 of its count."""
    rows, words = words_of(pc.ascii_lower(text))
    if not len(words):
        return np.zeros(len(text), np.uint64)
    counts = np.bincount(rows, minlength=len(text))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), " ")[0].as_buffer().to_pybytes()
    sizes = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = np.cumsum(counts)
    # shingles of a text: runs of n words, or all of a shorter text
    n_shingles = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    row = np.repeat(np.arange(len(text)), n_shingles)
    first = np.arange(n_shingles.sum()) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + np.repeat(last - counts, n_shingles)
    stop = np.minimum(first + n, last[row]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[stop].tolist(), strict=True)), np.uint64, len(first))
    return majority(row, hashes, len(text), weigh)


def majority(row: np.ndarray, hashes: np.ndarray, n_rows: int, weigh: str = "each") -> np.ndarray:
    """The fingerprint of each row's hashes (rows in order); one without hashes is zero."""
    out, weights = np.zeros(n_rows, np.uint64), None
    if not len(row):
        return out
    if weigh == "log":
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        weights = 1 + np.log2(np.diff(np.append(at, len(row))))
        row, hashes = row[at], hashes[at]
    n = np.bincount(row, minlength=n_rows)
    full = np.flatnonzero(n)
    begins = np.searchsorted(row, full)
    total = np.add.reduceat(weights, begins) if weights is not None else n[full].astype(np.float64)
    # bits of 8 bytes at a time: each byte column is unpacked and summed within texts
    data = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        bits = np.unpackbits(data[:, k : k + 1], axis=1, bitorder="little")
        sums = np.add.reduceat(bits * weights[:, None] if weights is not None else bits, begins, axis=0, dtype=np.float64 if weights is not None else np.int64)
        out[full] |= np.packbits(2 * sums > total[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprinted(docs: DataFrame, n: int = SHINGLE, weigh: str = "each", seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every document."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, limit=4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text"), n, weigh, seed).view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(prints, "doc_id long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of at most so many bits that have the same components as all such links."""
    links, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            for other in rest[near].tolist():
                links.append((int(at), other))
            todo.extend(rest[near])
            rest = rest[~near]
    return links


SPLIT = 4096  # fingerprints of one key beyond which its rows are dealt to finer keys


def finer(keys: np.ndarray, fps: np.ndarray, segments: tuple[int, ...], families: tuple, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(index of the row, finer key) for rows of keys that are too full. A link that a key of EXACT_FAMILIES has brought about has an equal segment, so its other bits differ in at most three, and of the two segments that the key leaves out one differs in at most one bit: rows keep the key and add a fuzzy key of either."""
    rows, out = [], []
    family = (keys >> np.int64(12 + segments[0])).astype(np.int64) if len(set(segments)) == 1 else np.zeros(len(keys), np.int64)
    for f, fixed in enumerate(families):
        own = np.flatnonzero(family == f)
        for i in sorted(set(range(len(segments))) - {i for i, _ in fixed}):
            which, extra = fuzzy_keys(fps[own], segments, (((i, True),),), golay)
            rows.append(own[which])
            out.append(mix64(mix64(keys[own[which]].view(np.uint64)) ^ (extra + (i << 20)).view(np.uint64)).view(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def links(prints: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = EXACT_SEGMENTS, families: tuple = EXACT_FAMILIES, split: int = SPLIT) -> DataFrame:
    """a, b: links between distinct fingerprints of prints (fp) that differ in at most `distance` bits, a forest within each key. Rows of a key with more than `split` fingerprints are dealt to finer keys, which bring the same pairs of at most three bits together (EXACT_FAMILIES only)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 16_384):
                fps = np.asarray(batch.column("fp").slice(at, 16_384)).view(np.uint64)
                rows, keys = fuzzy_keys(fps, segments, families, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            rows, keys = finer(np.asarray(batch.column("key")), fps, segments, families, golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; the last key of a batch waits for the next one."""
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(keys)))
            out = []
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            out.extend(zip(fps[near].tolist(), fps[near + 1].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out.extend(forest(fps[s : s + n], distance))
            pairs = np.unique(np.array(out, np.uint64).reshape(-1, 2), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_keys, np.asarray(batch.column("key"))])
            fps = np.concatenate([held_fps, np.asarray(batch.column("fp")).view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            yield found(keys[:cut], fps[:cut])
            held_keys, held_fps = keys[cut:], fps[cut:]
        yield found(held_keys, held_fps)

    rows = prints.select("fp").distinct().mapInArrow(keyed, "key long, fp long")
    if families == EXACT_FAMILIES:
        full = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("key"), "full")
        if not full.isEmpty():  # the keys of one full key's rows are many, so neither side of the joins is brought to one task
            rows = rows.join(full, "key", "left_anti").unionByName(rows.join(full, "key", "left_semi").mapInArrow(dealt, "key long, fp long"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(walked, "a long, b long")


def grouped(docs: DataFrame, n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: the least id that links of at most `distance` bits reach."""
    prints = written(fingerprinted(docs, n), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(prints, distance)).withColumnRenamed("node", "fp")
    classes = least.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    # the least id of each component, by fingerprint
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = written(classes.join(smallest, "component").select("fp", "component_id"), "components")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILAR = 0.8  # of the sets of five-word shingles
WORDS = 5  # of a shingle
NEAR = 8  # bits in which fingerprints of one key may differ to be compared by their shingles
CELLS_BITS = 18  # log2 of the cells in which shingles of all documents are counted
SIEVE_BITS = 20
PIVOTS, MORE = 4, 8  # pivots a key in the first round; how many times as many in each next one


def shingle_sets(text: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; two hashes of each text's sequence of words; its fingerprint by words, a repeated one weighed by 1 + log2 of its count. A shorter text is one shingle, an empty one has none."""
    rows, words = words_of(pc.ascii_lower(text))
    first, second = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), first, second, first.copy()
    h, g = word_hashes(words)
    counts = np.bincount(rows, minlength=len(text))
    before = np.cumsum(counts) - counts
    place = (np.arange(len(rows)) - before[rows]).astype(np.uint64)
    full = np.flatnonzero(counts)
    for own, sums in ((h, first), (g, second)):
        sums[full] = np.add.reduceat(mix64(own ^ mix64(place + np.uint64(1))), before[full])
    n_shingles = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    row = np.repeat(np.arange(len(text)), n_shingles)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + before[row]
    stop, acc = (before + counts)[row], np.zeros(len(row), np.uint64)
    for i in range(n):
        inside = start + i < stop
        acc = np.where(inside, mix64((acc + np.uint64(i + 1)) ^ h[np.minimum(start + i, len(h) - 1)]), acc)
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])
    return row[new], acc[new], first, second, majority(rows, h, len(text), "log")


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - CELLS_BITS)).astype(np.int64)


def common_cells(own: DataFrame) -> np.ndarray:
    """For each cell of shingle hashes how many shingles of all documents fall in it, zero where they are no more than by chance. It only orders shingles: any order keeps prefixes complete, and common ones last keeps their groups small. A row a cell and task is shuffled, and the driver gets one a cell."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS_BITS, np.int64)
        for batch in batches:
            for part in pieces_of(batch, limit=2 << 20):
                total += np.bincount(_cell(shingle_sets(part.column("text"))[1]), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["cell", "n"])

    rows = own.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELLS_BITS, np.int64)
    out[np.asarray(rows["cell"], dtype=np.int64)] = np.asarray(rows["n"], dtype=np.int64)
    mean = out.mean()
    return np.where(out <= mean + 6 * np.sqrt(mean) + 6, 0, out)


def prefixes(own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, h, g (hashes of the sequence of words), fp, n (distinct shingles), keys: the first n - ceil(similar n) + 1 shingles in an order common to all texts. Two sets with a Jaccard similarity of `similar` share one of them: without it the rest of the one set is too small to hold what they must share."""
    common = common_cells(own)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, limit=2 << 20):
                row, key, h, g, fp = shingle_sets(part.column("text"))
                order = np.lexsort((key, common[_cell(key)], row))
                key = key[order]
                n = np.bincount(row, minlength=part.num_rows)
                size = np.where(n > 0, n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1, 0)
                at = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                kept = key[at < np.repeat(size, n)].view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.view(np.int64)) for x in (h, g, fp)), pa.array(n.astype(np.int64)), keys], ["doc_id", "h", "g", "fp", "n", "keys"])

    return own.mapInArrow(of, "doc_id long, h long, g long, fp long, n long, keys array<long>")


def whole_sets(own: DataFrame) -> DataFrame:
    """doc_id, s: all distinct shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, limit=2 << 20):
                row, key, *_ = shingle_sets(part.column("text"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key.view(np.int64)))], ["doc_id", "s"])

    return own.mapInArrow(of, "doc_id long, s array<long>")


def sieve(frame: DataFrame, column: str, ids: DataFrame, kind: str = "left_semi") -> DataFrame:
    """The rows of frame whose id may be one of `ids` (one column): all that are, and few others. left_anti: the other rows, null ids too.

    Ids are dealt to 2 ** SIEVE_BITS places and the places that have one are broadcast, at most so many rows of one integer, so that
    rows are left out before a shuffle without a broadcast that grows with the ids.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << SIEVE_BITS)).cast("int")
    places = ids.select(place(F.col(ids.columns[0])).alias("quire_place")).distinct()
    key = F.when(frame[column].isNotNull(), place(frame[column]))
    return frame.join(F.broadcast(places), key == places["quire_place"], kind)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def verified(pairs: DataFrame, nodes: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `similar`. Prefixes decide most of them: what two sets share is at most what their prefixes share and all that is left of the one whose prefix ends first. Only for the others the texts are read and compared in whole."""
    least = similar / (1 + similar) * (F.col("na") + F.col("nb")) - 1e-9  # of shared shingles
    side = lambda frame, x, *cols: frame.select(F.col("doc_id").alias(x), *[F.col(c).alias(c[0] + x) for c in cols])
    some = sieve(nodes, "doc_id", _ends(pairs))
    near = pairs.join(side(some, "a", "n", "keys"), "a").join(side(some, "b", "n", "keys"), "b")
    near = near.where(F.least("na", "nb") >= similar * F.greatest("na", "nb") - 1e-9)
    most = F.size(F.array_intersect("ka", "kb")) + F.greatest(F.col("na") - F.size("ka"), F.col("nb") - F.size("kb"))
    near = written(near.where(most >= least).select("a", "b", "na", "nb"), "near")
    tidied(own.sparkSession)
    if near.isEmpty():
        return near.select("a", "b")
    ends = _ends(near)
    texts_ = sieve(own, "doc_id", ends).join(ends.distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = written(whole_sets(texts_), "sets")
    both = near.join(side(sets, "a", "s"), "a").join(side(sets, "b", "s"), "b")
    links = written(both.where(F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b"), "links")
    removed(sets, near)
    return links


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (doc_id, n, fp) with one fingerprint, as stars, and the links of a spanning forest under each Golay key."""
    full = nodes.where("n > 0").select("fp", "doc_id")
    first = full.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = full.join(first, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    side = lambda f, x: first.select(F.col("fp").alias(f), F.col("first").alias(x))
    met = links(full, NEAR).toDF("fa", "fb").join(side("fa", "x"), "fa").join(side("fb", "y"), "fb")
    return stars.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def heads_of(members: DataFrame, pivots: int) -> DataFrame:
    """key, ahead (its pivots) of the keys whose rows are of several components; members: key, doc_id, n, pos, weight, component, degree.

    A key's rows are dealt to `pivots` parts by a hash, and the row of each part with the most links, then with the most
    keys that others have, is a pivot; so no key is brought together in one task.
    """
    part = F.pmod(F.xxhash64(F.lit(pivots), "doc_id"), F.lit(pivots))
    best = F.max(F.struct("degree", "weight", (-F.col("doc_id")).alias("back"), "n", "pos", "component")).alias("p")
    heads = members.groupBy("key", part.alias("part")).agg(best, F.min("component").alias("lo"), F.max("component").alias("hi"))
    return heads.groupBy("key").agg(F.collect_list("p").alias("ahead"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key", "ahead")


def met(members: DataFrame, heads: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of a key's pivots with its other rows, rows left: key, doc_id, n, pos, weight).

    A pair isn't made within a component, nor where too little is left of a set after the key: at the first key that two
    similar sets share enough is left.
    """
    both = members.join(heads.hint("merge"), "key")
    able = F.filter("ahead", lambda p: (p["component"] != F.col("component")) & (F.least(p["n"] - p["pos"], F.col("n") - F.col("pos")) >= similar / (1 + similar) * (p["n"] + F.col("n")) - 1e-9))
    pairs = both.select("doc_id", F.explode(able).alias("p")).select("doc_id", (-F.col("p.back")).alias("other"))
    pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    return pairs, both.where(~F.exists("ahead", lambda p: p["back"] == -F.col("doc_id"))).select("key", "doc_id", "n", "pos", "weight")


def near_groups(nodes: DataFrame, own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, component of nodes (doc_id, n, fp, keys) that links of a Jaccard similarity of `similar` or more reach.

    Candidates come from Golay keys of fingerprints, whose forests hold a row a fingerprint and key at most, and are
    verified. Fingerprints bound no Jaccard similarity, so what they miss is found exactly: two such sets share a
    shingle of their prefixes. Under each such shingle, the pivots meet the rows of other components, and leave, in
    rounds, until its rows are of one component or all were pivots. No row is passed over; a pivot round which all others lie ends a key at
    once, and rows that share a key, aren't similar and have no such pivot cost a pair each two.

    Rows carry what is known of their document from round to round, and a round without pivots, pairs or links does no more: what the
    driver keeps follows the number of jobs.
    """
    exploded = nodes.select(F.posexplode("keys").alias("pos", "key"), "doc_id", "n").select("key", "doc_id", "n", "pos")
    several = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("several")).where("several > 1").select("key")
    first = written(exploded.join(several.hint("merge"), "key"), "members")
    candidates = written(by_fingerprint(nodes), "candidates")
    tidied(own.sparkSession)

    def grouped_by(edges: DataFrame, links: DataFrame) -> DataFrame:
        degrees = _ends(links).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
        return written(components(edges).toDF("doc_id", "component").join(degrees.hint("merge"), "doc_id"), "groups")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(groups.hint("merge"), "doc_id", "left")
        return written(rows.select("key", "doc_id", "n", "pos", "weight", F.coalesce("component", "doc_id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")), "members")

    links = verified(candidates, nodes, own, similar)
    tidied(own.sparkSession)
    groups, seen, pivots = grouped_by(links, links), candidates, PIVOTS
    left = placed(first.join(first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("weight")).hint("merge"), "doc_id"))
    removed(first)
    while not (heads := written(heads_of(left, pivots), "pivots")).isEmpty():
        pairs, rest = met(left, heads, similar)
        fresh = written(pairs.join(seen.hint("merge"), ["a", "b"], "left_anti"), "candidates")
        tidied(own.sparkSession)
        if not fresh.isEmpty():
            seen, found = seen.unionByName(fresh), verified(fresh, nodes, own, similar)
            if not found.isEmpty():
                links = links.unionByName(found)
                groups = grouped_by(groups.select(F.col("component").alias("a"), F.col("doc_id").alias("b")).unionByName(found), links)
        before, left = left, placed(rest)
        removed(before, heads)
        pivots *= MORE
        tidied(own.sparkSession)
    removed(left, heads)
    return groups.select("doc_id", "component")


def without_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without the documents that have an earlier one in their group; all columns stay. A group is linked by equal word sequences and by pairs of texts whose sets of five-word shingles have a Jaccard similarity of `similar` or more; its least id stays.

    Rows of one id stay or go together; rows without an id stay. An id that stands for unequal texts is matched by equal word sequences alone.
    """
    own = texts(docs).where("doc_id is not null")
    keyed = written(prefixes(own, similar), "words")
    classes = written(keyed.groupBy("h", "g").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "classes")
    printed = written(keyed.select("doc_id", "h", "g"), "texts")
    removed(keyed)
    unequal = written(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "unequal")
    later = near_groups(classes.join(unequal, "doc_id", "left_anti"), own, similar).where("doc_id <> component").select(F.col("doc_id").alias("quire_gone"))
    copies = printed.join(classes.select("h", "g", F.col("doc_id").alias("first")), ["h", "g"]).where("doc_id <> first").select(F.col("doc_id").alias("quire_gone"))
    gone = written(later.unionByName(copies).distinct(), "gone")
    # most of the documents that stay are known to stay without a shuffle
    rest = sieve(docs, "doc_id", gone).join(gone.hint("merge"), F.col("doc_id").cast("long") == gone["quire_gone"], "left_anti")
    return sieve(docs, "doc_id", gone, "left_anti").unionByName(rest)
