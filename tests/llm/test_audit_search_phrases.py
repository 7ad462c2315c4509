"""Filter interaction audit, nearest neighbours and collocations against brute force, and their odd cases."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, collocations, interaction

DOCS = "doc_id bigint, text string, lang string"


# op11


def audit_by_hand(docs, labels):
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    rows = [(d, text or "", lang or "") for d, text, lang in docs]
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text] = min(d, first.get(text, d))
    fails = []
    for d, text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and first[text] < d}
        fails.append((lang, {k for k, v in own.items() if v}, d in good, d in toxic))
    out = []
    for part in {r[2] for r in rows}:
        own, worth = [f for f in fails if f[0] == part], Counter()
        got = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone, left = [f for f in left if k in f[1]], [f for f in left if k not in f[1]]
                worth[k] += len(gone)
                got["".join(order), step] = (k, len(left), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
        out += [(part, order, step, *v[1:], worth[v[0]]) for (order, step), v in got.items()]
    return sorted(out)


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (4, "", "en"), (5, None, "de"), (None, long, "en"), (None, "x # y", None), (6, "A B C", "de"),
        (7, "same " * 300, "de"), (8, "same " * 300, "en"), (9, f"  {long} | ", "fr"), (10, "\xc9t\xe9 " * 10, "fr"), (11, "", ""), (-4, "x", "en"), (12, "a\x0bb\x0cc", "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (99, 1, 1), (None, 1, 1), (7, None, 1)]
    frame = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("own")).withColumn("mask", F.lit(7))
    got = interaction.audited(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(1)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(docs, labels)


def test_audit_of_nothing(spark):
    assert interaction.audited(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("n", range(1, 8))
def test_swaps_visit_all_orders(n):
    seen = [tuple(order) for order, _, _ in interaction.walk(n)]
    assert len(seen) == len(set(seen)) == math.factorial(n)
    for a, b in itertools.pairwise(seen):
        assert sum(x != y for x, y in zip(a, b, strict=True)) == 2


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("x", 3, 5, 1), ("x", 0, 2, 2), ("x", 3, 1, 0), ("y", 2, 4, 4)], "part string, mask int, n bigint, marked bigint")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in interaction.audit(rows, "PQ", ["marked"]).collect()}
    assert len(got) == 8
    first = got["x", "PQ", 1]
    assert (first["kept"], first["removed"], first["marked_lost"], first["shapley"]) == (2, 6, 1, 6)
    assert (got["x", "QP", 2]["redundant"], got["y", "QP", 1]["unique_fails"], got["y", "PQ", 1]["removed"]) == (6, 4, 0)
    with pytest.raises(ValueError):
        interaction.audit(rows, "PP", [])


# op12


def nearest_by_hand(rows, every=50, k=5):
    ok = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids]).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for at, i in enumerate(ids):
        if i % every == 0:
            score = (x @ x[at]) / (norms * norms[at])
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in np.lexsort([ids, -np.round(score, 12)]) if j != at][:k]
    return out


def found(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=24)
    rows = [(i, (rng.normal(size=24) if i % 3 else centre + 0.02 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))), nearest_by_hand(rows)
    assert got.keys() == want.keys()
    assert all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    by_id = {i: np.asarray(v, float) for i, v in rows}
    for q in list(got)[:40]:
        for i, score in got[q]:
            a, b = by_id[q], by_id[i]
            assert score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-14)


def test_nearest_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    same = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, same) for i in range(900, 0, -1)] + [(i, rng.normal(size=4).tolist()) for i in range(1000, 1012)]
    odd = [(None, same), (2000, None), (2050, [0.0] * 4), (2100, [1.0, float("nan"), 0.0, 0.0]), (2150, [1.0, None, 0.0, 0.0]), (2200, [float("inf"), 1.0, 0.0, 0.0]), (2250, [1.0, 2.0]), (2300, []), (3000, [1e-200, 0.0, 0.0, 0.0]), (3050, [1e200, 1e200, 0.0, 0.0])]
    frame = spark.createDataFrame(rows + rows[:50] + odd, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = found(ann.nearest_of(frame))
    assert set(got) == {*range(50, 901, 50), 1000, 3000, 3050}
    assert [i for i, _ in got[50]] == [1, 2, 3, 4, 5] and all(s == pytest.approx(1) for _, s in got[50])
    want = nearest_by_hand([r for r in rows + odd if r[0] is not None and (r[1] is None or len(r[1]) == 4) and r[0] != 2250 and r[0] < 3000])
    assert [i for i, _ in got[1000]][:1] == [want[1000][0][0]] or got[1000][0][1] == pytest.approx(want[1000][0][1])
    assert all(len(v) == 5 for v in got.values())


def test_blocks_with_too_many_rows_are_dealt(spark, monkeypatch):
    """A bucket of near copies is more than a block: the parts together find what one block would."""
    monkeypatch.setattr(ann, "BLOCK", 1024 * 8)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.001 * rng.normal(size=8) if i % 2 else rng.normal(size=8)).tolist()) for i in range(5000)]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), every=500)), nearest_by_hand(rows, every=500)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7])
def test_nearest_of_few(spark, n):
    rng = np.random.default_rng(n)
    rows = [(50 * i, rng.normal(size=3).tolist()) for i in range(n)]
    got, want = found(ann.nearest_of(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))), nearest_by_hand(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}


def test_probes_are_all_buckets_within_the_radius():
    hashes = ann.Polytopes(6, 6, tables=2)
    rng = np.random.default_rng(5)
    units = ann._units(rng.normal(size=(5, 6))).astype(np.float32)
    for t in range(2):
        costs = hashes.costs(units, t)
        n = math.prod(c.shape[1] for c in costs)
        assert n == 64
        for q in range(5):
            every = hashes.cost_of(costs, q, np.arange(n))
            assert set(ann.probes(costs, q, 0.7)) == set(np.flatnonzero(every <= 0.7))
            assert every[hashes.codes(units)[q, t]] == 0


def test_hadamard_rotates():
    x = np.random.default_rng(6).normal(size=(3, 8))
    y = ann.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1), rtol=1e-5) and np.allclose(ann.hadamard(y), x, rtol=1e-5)


# op13


def phrases_by_hand(docs, least, longest, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + s] for p, a in held.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= 50 * held[p[i : i + s]]}
        rows = []
        for p, a in held.items():
            if p not in gone:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (4, 5), (2, 2000)])
def test_collocations(spark, monkeypatch, longest, top):
    monkeypatch.setattr(collocations, "STRETCH", 7)  # stretches overlap
    monkeypatch.setattr(collocations, "HEAVY", 20)  # common pivots are dealt
    rng = np.random.default_rng(7)
    words = ["the", "of", "and", "a", "New", "York", "\xc9t\xe9", "€", "x-y", "#", "don't", "zz"]
    odds = np.array([30, 20, 15, 10, 6, 6, 4, 3, 2, 2, 1, 1]) / 100
    texts = [("".join(w + s for w, s in zip(rng.choice(words, n, p=odds), rng.choice([" ", "\t", "  ", ", ", ".\n", "\x0b"], n, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]), strict=True)), str(lang)) for n, lang in zip(rng.integers(0, 60, 60), rng.choice(["en", "fr"], 60), strict=True)]
    texts += [("new york new york " * 15, "en")] * 8 + [("a a a a a a a", None), ("", "de"), (None, "de"), ("solo", "es"), ("...", "es"), ("the " * 300, None), ("tab\tin\tlang", "a\tb")]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], DOCS).withColumns({"phrase": F.lit("x"), "n": F.lit(3)})
    got = sorted(tuple(r) for r in collocations.mined(frame, longest=longest, top=top).collect())
    assert got == phrases_by_hand(texts, 10, longest, top)


def test_collocations_of_nothing(spark):
    assert collocations.mined(spark.createDataFrame([], DOCS)).count() == 0


def test_scores_beyond_64_bits(spark):
    a, b = 9_007_199_254_740_993, 9_007_199_254_740_997  # not doubles
    phrases = spark.createDataFrame([("x", "p q", a), ("x", "p r", 10)], "lang string, phrase string, a bigint")
    counts = spark.createDataFrame([("x", "p", b), ("x", "q", a + 2), ("x", "r", 10)], "lang string, word string, n bigint")
    got = {r["phrase"]: r["score"] for r in collocations.scored(phrases, counts).collect()}
    assert got == {"p q": 10**6 * a * a // (b * (a + 2)), "p r": 10**6 * 100 // (b * 10)}


def test_words_of_odd_texts():
    import pyarrow as pa

    words = collocations.Words(pa.array(["A,b  \t c", None, "", "d\x0be", "\xe9中 f"]).slice(1))
    assert words.strings(0, len(words)).to_pylist() == ["d", "e", "\xe9中", "f"]
    assert len(set(words.piece[:2])) == 2 and words.piece[2] == words.piece[3] and list(words.row) == [2, 2, 3, 3]
