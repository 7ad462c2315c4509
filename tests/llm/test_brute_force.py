"""What the queries without SQL return, worked out again in plain Python on small tables."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import lattice, mixing, perplexity
from quire.llm.queries import vocabulary


def test_scores_of_the_lattice_model(spark):
    """op2: classes, two rounds of expectation over all segmentations, discounts and the sum over classes."""
    rng = random.Random(4)
    words = [("".join(rng.choices("abcdetn", k=rng.randint(1, 5)))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words[: 25 if i % 2 else 40], k=rng.randint(0, 12))), "en" if i % 2 else "de" if i % 6 else None) for i in range(60)]
    got = {r.doc_id: (r.score, r.lattice_score) for r in lattice.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), vocabulary("byte_bpe_50k.tiktoken")).collect()}

    v = lattice.pieces(vocabulary("byte_bpe_50k.tiktoken"))
    at = {p: i for i, p in enumerate(v.pieces)}
    cuts = {}

    def segmentations(word):
        """Lists of pieces that make up the word with its space: the first is an initial piece, the others aren't."""
        if word not in cuts:
            b, out = b" " + word.encode(), []

            def walk(i, own):
                if i == len(b):
                    out.append(own)
                for j in range(i + 1, len(b) + 1):
                    k = at.get(b[i:j])
                    if k is not None and v.initial[k] == (i == 0):
                        walk(j, [*own, k])

            walk(0, [])
            cuts[word] = out
        return cuts[word]

    def ways(word, p, stop):
        return [math.prod(p[k] * (1.0 if n == 0 else 1 - stop) for n, k in enumerate(s)) for s in segmentations(word)]

    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    by_lang = collections.Counter(r[2] or "" for r in train)
    langs = sorted(by_lang, key=lambda x: (-by_lang[x], x))[: lattice.CLASSES - 1]
    counts = [collections.Counter(w for r in train if (r[2] or "") == x for w in r[1].split()) for x in langs] + [collections.Counter()]
    texts = [by_lang[x] for x in langs] + [0]
    models = []
    for c, n in zip(counts, texts):
        p, stop = v.prior, 0.3
        for _ in range(lattice.ROUNDS):
            expected = np.zeros(len(v.pieces))
            for w in c:
                shares = np.array(ways(w, p, stop))
                for s, share in zip(segmentations(w), shares / shares.sum()):
                    for k in s:
                        expected[k] += share
            p = v.normed(expected + v.prior * (0.01 * expected.sum() + 1) / 2)
            stop = min(0.99, max(0.01, len(c) / max(1.0, expected.sum())))
        ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
        d = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        total, free = sum(c.values()) + n, d * (len(c) + (n > 0)) + 1
        models.append((c, p, stop, d, total, free, n, (n + 0.5) / (sum(texts) + 0.5 * len(texts))))

    def score(text):
        out, alone = [], []
        for c, p, stop, d, total, free, n, share in models:
            own = math.log10(share) + math.log10((max(n - d, 0) + free * lattice.Q_END) / (total + 1))
            own += sum(math.log10((max(c[w] - d, 0) + free * (1 - lattice.Q_END) * sum(ways(w, p, stop)) * stop) / (total + 1)) for w in text.split())
            out.append(own)
            alone.append(math.log10(share) + sum(math.log10(sum(ways(w, p, stop)) * stop) for w in text.split()))
        return tuple(pytest.approx(max(x) + math.log10(sum(10 ** (y - max(x)) for y in x)), rel=1e-9, abs=1e-9) for x in (out, alone))

    assert got == {i: score(t) for i, t, _ in rows}


def spark_hash(*values):
    """The engine's xxhash64 of 32-bit and 64-bit integers and strings."""
    h = 42
    for x in values:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x[0].to_bytes(x[1], "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def highest_quotients(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        out[max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_words_taken_by_the_mix(spark):
    """op8: targets, seats of sources and shards, blocks by a seeded hash, and each document's words in them."""
    rng = random.Random(12)
    rows = [(i * 7, " ".join(["w"] * rng.choice((0, 1, 5, 17, 60, 300))), f"s{i % 5}" if i % 11 else "big") for i in range(120)]
    rows += [(2000 + i, " ".join(["w"] * 400), "big") for i in range(20)] + [(5000, "w w w", "tiny")]
    block, shard = 16, 500
    got = {r.doc_id: r.taken for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), block=block, shard=shard).collect()}

    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    sources = sorted(size)
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, set()
    while True:
        rest, total = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), sum(weight[s] for s in sources if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / total for s in sources}
        over = {s for s in sources if s not in full and target[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    seats = dict(zip(sources, highest_quotients([target[s] for s in sources], round(sum(target.values()) / block))))
    seats = {s: max(n, min(1, size[s])) for s, n in seats.items()}  # a source with words has a seat
    want = {}
    for s in sources:
        shards, n = collections.defaultdict(list), max(1, size[s] // shard)
        for i, t, own in rows:
            if own == s:
                shards[spark_hash((17, 4), (i, 8)) % n].append((spark_hash((18, 4), (i, 8)), i, len(t.split())))
        names = sorted(shards)
        words = [sum(x[2] for x in shards[k]) for k in names]
        for k, w, quota in zip(names, words, highest_quotients(words, seats[s])):
            n_blocks = -(-w // block)
            quota = 2 * n_blocks if target[s] >= 2 * size[s] - 1e-6 else min(quota, 2 * n_blocks)
            first = sorted(range(n_blocks), key=lambda b: (spark_hash((19, 4), f"s{s}", (k, 8), (b, 8)), b))[: quota % n_blocks if n_blocks else 0]
            times = [quota // n_blocks + (b in first) for b in range(n_blocks)]
            place = 0
            for _, i, length in sorted(shards[k]):
                want[i] = sum(times[p // block] for p in range(place, place + length))
                place += length
    assert got == want and len({got[i] for i, _, s in rows if s == "big"}) > 2 and got[5000] == 6
    for s in sources:
        assert abs(sum(want[i] for i, _, own in rows if own == s) - target[s]) <= (max(1, size[s] // shard) + 1) * block  # a part-block a shard


def test_bits_of_the_quality_model(spark):
    """op10: what is counted, the discounts, and every document's bits, over all orders of the model."""
    texts = ["abracadabra abra", "cadabra", "a b c", "abba", "", None, "ünïcode cab", "zzz"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    sample = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    five, fit = perplexity.trained(docs, sample)

    def grams(t):
        data = b"\0" * 4 + (t or "").encode() + b"\0"
        return [data[k : k + 5] for k in range(len(data) - 4)]

    levels = {5: collections.Counter(g for t in texts[:5] for g in grams(t))}
    for o in (4, 3, 2, 1):
        levels[o] = collections.Counter(g[1:] for g in levels[o + 1])
    back = lambda c: bytes([c >> 16 & 255, c >> 8 & 255, c >> 32 & 255, c >> 24 & 255, c & 255])
    assert {back(r.code): r.n for r in five.collect()} == dict(levels[5])
    of = {o: perplexity._discount([sum(x == k for x in levels[o].values()) for k in (1, 2, 3, 4)]) for o in levels}
    assert {o: fit.of[o] for o in (5, 4, 3)} == {o: of[o] for o in (5, 4, 3)}

    def p(gram):
        if not gram:
            return 1 / 256
        o = len(gram)
        around = [x for g, x in levels[o].items() if g[:-1] == gram[:-1]]
        if not around:
            return p(gram[1:])
        d = lambda x: (0, *of[o])[min(x, 3)]
        own = levels[o].get(gram, 0)
        return (own - d(own) + sum(map(d, around)) * p(gram[1:])) / sum(around)

    got = {r.doc_id: (r.n, r.bits) for r in perplexity.document_bits(docs, five, fit).collect()}
    assert got == {i: (len((t or "").encode()) + 1, pytest.approx(-sum(math.log2(p(g)) for g in grams(t)), rel=1e-5)) for i, t in enumerate(texts)}
    assert pa.array(texts).null_count == 1


def test_kneser_ney_learns_from_all_good_documents(spark, monkeypatch):
    """Not from some of them, however many there are; a task that counts in several turns counts the same."""
    rows = [(i, f"word{i % 97} and more") for i in range(26_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    fit = [i for i, _ in rows if zlib.crc32(str(i).encode()) % perplexity.FOLDS]
    assert len(fit) > 20_000
    ids = perplexity.trusted(labels)
    assert sorted(r.doc_id for r in ids.collect()) == fit
    five, _ = perplexity.trained(docs, ids)
    want = sum(len(rows[i][1]) + 1 for i in fit)  # a 5-gram a byte and end
    assert five.agg(F.sum("n")).first()[0] == want
    monkeypatch.setattr(perplexity, "HELD_GRAMS", 8)
    turns, _ = perplexity.trained(docs, ids)
    assert turns.exceptAll(five).isEmpty() and five.exceptAll(turns).isEmpty()
