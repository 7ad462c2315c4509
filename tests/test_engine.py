"""Sources, sinks, checks, and the whole plan."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import adapters, bootstrap, checks, gates, images, joins, manifest, metrics, quantiles
from quire.operators.statistics import line_statistics, summed
from quire.sources import readers, writers

SF = "/root/testdata/sf0.001"


def sample(i, **more):
    base = dict(sample_id=f"smoke_{i:03d}", split="smoke", image_path=f"img/{i}.png", sha256="", source_document_id=f"d{i}", writer_id=None, reference_raw="متن", description=None, primary_stratum="clean_modern_printed",
                attributes=[], origin="real", generation_method=None, numeric_spans=[], is_blank=False, annotator_status="approved", adjudicated=False)
    return base | more


def test_manifest_round_trip(spark, tmp_path):
    rows = [sample(1), sample(2, reference_raw="", is_blank=True), sample(3, numeric_spans=[dict(start=0, end=1, type="integer", raw="5", canonical_value="5", preserve_leading_zero=False)])]
    path = tmp_path / "m.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    df = readers.manifest(spark, str(path))
    assert df.count() == 3 and df.where("writer_id is null").count() == 3
    writers.json_lines(df, str(tmp_path / "out"), order="sample_id")
    assert '"writer_id":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert readers.manifest(spark, str(tmp_path / "out")).exceptAll(df.withColumn("numeric_spans", F.col("numeric_spans"))).count() == 0
    with pytest.raises(Exception, match="already exists"):
        writers.json_lines(df, str(tmp_path / "out"))
    path.write_text("{broken")
    with pytest.raises(Exception):
        readers.manifest(spark, str(path)).collect()


def test_csv_with_mark_and_nested(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("﻿rank,id,name,category,parameter_count_b,persian_accuracy_estimation,notes\n1,a.b,N,line,,90.5,\n".encode())
    row = readers.candidates(spark, str(path)).first()
    assert (row["rank"], row["id"], row["parameter_count_b"], row["persian_accuracy_estimation"]) == (1, "a.b", None, 90.5)
    writers.csv(spark.createDataFrame([("x", [1, 2])], "a string, b array<int>"), str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "n"), header=True).first()["b"] == "[1,2]"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)


def test_file_checks(spark, tmp_path):
    (tmp_path / "img").mkdir()
    contents = {1: png(300, 40), 2: png(100, 40), 3: b"no image", 5: png(300, 50)}
    for i, c in contents.items():
        (tmp_path / f"img/{i}.png").write_bytes(c)
    rows = [sample(i, sha256=hashlib.sha256(contents.get(i, b"")).hexdigest() if i != 5 else "0") for i in (1, 2, 3, 4, 5)]
    from quire.sources.schemas import SAMPLES

    df = spark.read.schema(SAMPLES).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    found = checks.files(readers.with_images(df, readers.images(spark, str(tmp_path / "img")), str(tmp_path)))
    assert sorted((v["check"], v["sample_id"][-1]) for v in found.collect()) == [("V2", "4"), ("V3", "5"), ("V5", "3"), ("V6", "2")]
    with pytest.raises(ValueError, match="V2"):
        checks.require(found)
    ids = df.withColumn("line", F.monotonically_increasing_id())
    assert checks.expected_ids(ids, "smoke_", 5).isEmpty() and not checks.expected_ids(ids, "smoke_", 6).isEmpty()


def test_label_checks(spark):
    from quire.sources.schemas import SAMPLES

    span = dict(start=11, end=16, type="time", raw="۱۲:۳۰", canonical_value="12:30", preserve_leading_zero=False)
    rows = [sample(1, reference_raw="می‌روم ساعت ۱۲:۳۰", numeric_spans=[span]), sample(2, reference_raw="می‌روم ساعت ۱۲:۳۰", numeric_spans=[span | dict(start=12, end=17)]), sample(3, attributes=["zwnj"]), sample(4, is_blank=True), sample(5, reference_raw="a\x01")]
    df = spark.read.schema(SAMPLES).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    assert sorted((v["check"], v["sample_id"][-1]) for v in checks.labels(df).collect()) == [("V10", "1"), ("V11", "3"), ("V18", "5"), ("V9", "4")]


def test_identity_scores_100(spark):
    rows = [("m", f"s{i}", t, t, False, [(0, 2, "integer", "12", "12", False)] if t.startswith("12") else []) for i, t in enumerate(["12 می‌روم خانه", "سلام دنیا.", "a b"])] + [("m", "sb", "", "", True, [])]
    df = spark.createDataFrame(rows, "model_id string, sample_id string, reference_raw string, prediction string, is_blank boolean, numeric_spans array<struct<start:int,end:int,type:string,raw:string,canonical_value:string,preserve_leading_zero:boolean>>")
    r = metrics.composite(metrics.scored(summed(line_statistics(df), "model_id")).withColumn("robustness", F.lit(100.0))).first()
    for m in ("canonical_cer", "strict_cer", "canonical_wer", "chrfpp", "exact_line", "spacing_f1", "numeric_span", "omission", "hallucination", "persian_ocr_score"):
        assert abs(r[m] - 100) < 1e-9, m


def test_failures_lower_scores(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    samples = spark.createDataFrame([("s1", "متن"), ("s2", "متن")], "sample_id string, reference_raw string")
    preds = spark.createDataFrame([("a", "s1", "متن", "success", 0), ("a", "s2", "متن", "crash", 1), ("a", "s2", "متن", "success", 0)], "model_id string, sample_id string, raw_prediction string, status string, retry_count int")
    got = {(r.model_id, r.sample_id): r.prediction for r in joins.work_grid(models, samples, preds).collect()}
    assert got == {("a", "s1"): "متن", ("a", "s2"): "", ("b", "s1"): "", ("b", "s2"): ""}


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([("m", "1"), ("m", "2")], "model_id string, sample_id string")
    ran = []

    def run(w):
        ran.append(w.count())
        return w.withColumn("status", F.when(F.col("sample_id") == "1", "success").otherwise("crash"))

    path = str(tmp_path / "cache")
    writers.resume(work, spark, path, ["model_id", "sample_id"], run)
    writers.resume(work, spark, path, ["model_id", "sample_id"], run)
    assert ran == [2, 1]


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_no_work_is_lost_or_done_twice(spark, monkeypatch, most):
    """Whatever the filter lets through; with 64 bits it lets all through."""
    monkeypatch.setattr(writers, "MOST_BITS", most)
    work = spark.range(3000).select((F.col("id") % 7).cast("string").alias("model_id"), F.col("id").alias("sample_id"), F.lit("x").alias("quire_seen"))
    done = work.where("sample_id % 3 = 0").select("model_id", "sample_id", F.when(F.col("sample_id") % 2 == 0, "success").otherwise("crash").alias("status"))
    rows = writers.pending(work, done.unionByName(done), ["model_id", "sample_id"]).collect()
    assert sorted(r.sample_id for r in rows) == [i for i in range(3000) if i % 6] and set(rows[0].asDict()) == {"model_id", "sample_id", "quire_seen"}
    assert writers.pending(work, done.limit(0), ["model_id", "sample_id"]).count() == 3000


def test_images_are_found_by_their_whole_path(spark, tmp_path):
    for folder in ("dev", "olddev", "dev/dev"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "a.png").write_bytes(folder.encode())
    samples = spark.createDataFrame([("1", "dev/a.png"), ("2", "a.png"), ("3", "dev/dev/a.png"), ("4", "ev/a.png")], "sample_id string, image_path string")
    got = {r.sample_id: r.content for r in readers.with_images(samples, readers.images(spark, str(tmp_path)), f"file://{tmp_path}/").collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {"1": b"dev", "2": None, "3": b"dev/dev", "4": None}


def test_files_of_a_failed_job_are_gone(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", bytearray([i])) for i in range(20)] + [("s99", None)], "sample_id string, content binary").repartition(4)
    with pytest.raises(Exception, match="no file can be made"):
        writers.images(rows, f"{tmp_path}/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    writers.images(rows.where("content is not null"), f"{tmp_path}/out", force=True)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*")} == {f"s{i}.png": bytes([i]) for i in range(20)}
    with pytest.raises(Exception, match="Unrecognized|unknown|nothing"):
        writers.images(rows, "nothing://host/out")
    assert not os.path.exists("nothing:")


def test_csv_by_another_writer(spark, tmp_path):
    import csv

    texts = ['plain', 'a "quoted" one', 'two\nlines, and a comma', '"', '""', ' spaces ', '', 'ends with \\', '\nreturn']
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(["k", "v"])
        w.writerows([[i, t] for i, t in enumerate(texts)] + [["x", "no number"], [3]])
    good, rejected = readers.csv_rows(spark, str(tmp_path / "a.csv"), "k int, v string")
    assert {r.k: r.v or "" for r in good.collect()} == dict(enumerate(texts))
    assert sorted(r.reasons for r in rejected.collect()) == [["another number of fields"], ["k: not int"]]
    writers.csv(good, str(tmp_path / "b"))
    again, none = readers.csv_rows(spark, str(tmp_path / "b"), "k int, v string")
    assert {r.k: r.v or "" for r in again.collect()} == dict(enumerate(texts)) and none.isEmpty()


def test_json_rows_set_aside(spark, tmp_path):
    lines = ['{"k": 1, "v": {"x": 1}}', "", '{"k": "one", "v": null}', "{", "[1]", "3", '{"k": 2, "v": {"x": "y"}}', '{"more": 1}', "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    good, rejected = readers.json_rows(spark, str(tmp_path / "a.jsonl"), "k int, v struct<x: int>")
    assert sorted((r.k or 0, r.v and r.v.x) for r in good.collect()) == [(0, None), (1, 1)]
    assert {r.row: r.reasons for r in rejected.collect()} == {lines[2]: ["k: not int"], "{": ["no JSON"], "[1]": ["no object"], "3": ["no object"], lines[6]: ["a field inside isn't of its type"]}


def test_tiers_and_gate(spark):
    board = spark.createDataFrame([("a", 90.0), ("b", 89.0), ("c", 80.0), ("d", 79.0)], "model_id string, persian_ocr_score double")
    diffs = spark.createDataFrame([("a", "b", -1.0, 2.0), ("a", "c", 5.0, 12.0), ("a", "d", 5.0, 12.0), ("b", "c", -1.0, 9.0), ("b", "d", 1.0, 9.0), ("c", "d", -1.0, 3.0)], "model_a string, model_b string, ci_low double, ci_high double")
    assert {r.model_id: r.statistical_tier for r in gates.tiers(board, diffs).collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    row = spark.range(1).select(gates.catastrophic(F.lit("سلام"), F.lit("اااااا")).alias("x"), gates.catastrophic(F.lit("ااااا"), F.lit("ااااا")).alias("y"), gates.persian_share(F.lit("سلام ab")).alias("p")).first()
    assert row.x and not row.y and abs(row.p - 4 / 6) < 1e-9


def test_weights_are_poisson_and_depend_on_the_cluster_alone(spark):
    clusters = spark.createDataFrame([(f"c{i}",) for i in range(40)], "cluster_id string")
    a = sorted(map(tuple, bootstrap.weights(clusters, 500).collect()))
    assert a == sorted(map(tuple, bootstrap.weights(clusters.repartition(3), 500).collect()))
    own = bootstrap.weights(clusters.where("cluster_id = 'c7'"), 500)
    assert [x for x in a if x[1] == "c7"] == sorted(map(tuple, own.collect()))
    all_ = np.concatenate([bootstrap.draws("s", f"c{i}", 2000) for i in range(100)])
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert (all_ == k).mean() == pytest.approx(share, abs=0.004)
    assert len({bootstrap.draws("s", "x", 11).tobytes(), bootstrap.draws("t", "x", 11).tobytes(), bootstrap.draws("s", "y", 11).tobytes()}) == 3
    assert bootstrap.draws("s", "x", 11).tolist() == bootstrap.draws("s", "x", 2000)[:11].tolist()


def test_replicate_sums_are_those_of_a_join(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "KEPT_GROUPS", 3)
    rows = [(f"m{i % 5}", None if i % 7 == 0 else f"k{i % 3}", f"c{i % 11}", i * 1_000_003, -i) for i in range(200)]
    frame = spark.createDataFrame(rows, "model_id string, kind string, cluster_id string, x bigint, y bigint").repartition(5)
    got = bootstrap.replicate_sums(frame, ["model_id", "kind"], ["x", "y"], 24, "s").where("x <> 0 OR y <> 0")
    drawn = bootstrap.weights(frame, 24, "s")
    want = drawn.join(frame, "cluster_id").groupBy("replicate", "model_id", "kind").agg(F.sum(F.col("x") * F.col("weight")), F.sum(F.col("y") * F.col("weight")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert bootstrap.replicate_sums(frame.limit(0), ["model_id"], ["x"], 24).count() == 0


def test_intervals_of_differences(spark):
    rows = [(r, m, (r * 37 % 101) * k / 10.0 if (r, m) != (5, "b") else None) for r in range(600) for k, m in enumerate("abc")]
    scores = spark.createDataFrame(rows, "replicate int, model_id string, score double")
    got = {(r.model_a, r.model_b): (r.ci_low, r.ci_high) for r in bootstrap.difference_intervals(scores).collect()}
    want = {(r.model_a, r.model_b): r.ci for r in joins.model_pairs(scores, ["replicate"]).groupBy("model_a", "model_b").agg(F.percentile("difference", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    both = {r.model_id: (r.ci_low, r.ci_high) for r in bootstrap.intervals(scores, "model_id").collect()}
    assert both == {r.model_id: pytest.approx(tuple(r.ci)) for r in scores.groupBy("model_id").agg(F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).collect()}


@pytest.mark.parametrize("cells", [2, 4096])
def test_quantiles_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y)) for x, y in zip(rng.normal(size=301), rng.integers(0, 3, 301), strict=True)] + [("one", 5.0, None), ("none", None, None), ("b", float("nan"), 1.7e308), ("b", -0.0, -1.7e308), ("b", 1e-320, 0.0), ("b", float("inf"), None)]
    frame = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    wanted = {"x5": (F.col("x"), 0.05), "x50": (F.col("x"), 0.5), "x100": (F.col("x"), 1.0), "y95": (F.col("y"), 0.95), "y0": (F.col("y"), 0.0)}
    got = {r.k: r for r in quantiles.quantiles(frame, ["k"], wanted).collect()}
    for k in ("a", "one", "none", "b"):
        for name, column, p in (("x5", 1, 5), ("x50", 1, 50), ("x100", 1, 100), ("y95", 2, 95), ("y0", 2, 0)):
            values = [r[column] for r in rows if r[0] == k and r[column] is not None and abs(r[column]) < float("inf")]
            assert got[k][name] == (pytest.approx(np.percentile(values, p), rel=1e-12) if values else None), (k, name)
    assert quantiles.quantiles(frame.limit(0), ["k"], wanted).count() == 0


@pytest.fixture(scope="module")
def sums(spark):
    from quire.plans.leaderboard import Sums

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return Sums.of(spark, SF)


def test_replicates_have_the_score_of_the_board(sums):
    """A replicate that draws each cluster once has the score of the board, all ten metrics in it; a writer is one cluster, and only test lines count."""
    lines = sums.lines
    assert lines.where("cluster_id like 'writer:%'").count() == lines.where("primary_stratum = 'persian_handwriting' and writer_id is not null").count() > 0
    assert lines.where("split <> 'test'").isEmpty()
    scores = bootstrap.replicate_scores(sums.clusters, sums.degraded, 1, drawn=lambda seed, cluster, replicates: np.ones(replicates, np.uint8))
    want = {r.model_id: r for r in sums.scores().collect()}
    assert {r.model_id: r.score for r in scores.collect()} == {m: pytest.approx(r.persian_ocr_score) for m, r in want.items()}
    assert all(r.robustness is not None for r in want.values()) and want["exact"].robustness < 100 > want["repeating"].persian_ocr_score


def test_interval_of_equal_clusters_is_the_score(spark, sums):
    """Where all clusters have the same sums a replicate can't differ, so the interval is the score."""
    same = lambda frame, keys, columns: frame.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns]).select("*", F.explode(F.array(*[F.lit(f"c{i}") for i in range(5)])).alias("cluster_id"))
    clusters = same(sums.clusters, ["model_id", "primary_stratum"], bootstrap.SUMMED)
    degraded = same(sums.degraded, ["model_id", "corruption", "severity"], bootstrap.CELLS)
    got = bootstrap.intervals(bootstrap.replicate_scores(clusters, degraded, 20), "model_id").collect()
    want = {r.model_id: r.persian_ocr_score for r in sums.scores().collect()}
    assert {r.model_id: (r.ci_low, r.ci_high) for r in got} == {m: (pytest.approx(s), pytest.approx(s)) for m, s in want.items()}


def test_equal_scores_share_a_rank(spark):
    board = spark.createDataFrame([("a", 9.0, True), ("b", 9.0, True), ("c", 8.0, True), ("d", 9.5, False)], "model_id string, persian_ocr_score double, ok boolean")
    assert {r.model_id: r["rank"] for r in gates.ranked(board, F.col("ok")).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_composite_needs_all_ten(spark):
    nine = spark.createDataFrame([(1.0,)], "canonical_cer double")
    with pytest.raises(Exception, match="strict_cer"):
        metrics.composite(nine).collect()


def test_numbered_rows(spark):
    df = spark.createDataFrame([(f"k{i * 7 % 100:03d}",) for i in range(100)], "k string").repartition(7)
    assert sorted((r.k, r.place) for r in joins.numbered(df, "k").collect()) == [(f"k{i:03d}", i) for i in range(100)]
    assert joins.numbered(df.where("false"), "k").isEmpty()


def test_all_violations_are_counted(spark):
    found = spark.range(2500).select(F.lit("V9").alias("check"), F.col("id").cast("string").alias("sample_id"), F.lit("x").alias("detail"))
    with pytest.raises(ValueError, match="2500 violations(.|\n)*and 1500 more"):
        checks.require(found)
    checks.require(found.where("false"))


def test_images(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    picture = rng.integers(0, 256, (37, 53)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(picture)) == picture).all() and images.decode_png(b"no image") is None and images.decode_png(images.encode_png(picture)[:-30]) is None
    line = images.drawn("سلام ab\u200c🙂")
    assert images.read_back(line) == "سلام ab\u200c🙂" and images.read_back(images.drawn("")) == ""
    for name in images.FAMILIES:
        out = [images.degrade(line, name, s, 7) for s in (1, 2, 3)]
        assert all(o.dtype == np.uint8 for o in out) and (images.degrade(line, name, 3, 7) == out[2]).all()
        if name != "rotation_skew":
            change = [np.abs(o.astype(int) - line).mean() for o in out]
            assert 0 <= change[0] <= change[1] <= change[2] > 0, name  # half the size loses nothing of cells of two pixels
    assert images.read_back(images.degrade(line, "noise", 2, 7)) == "سلام ab\u200c🙂" and images.specks().min() < 236
    with pytest.raises(FileExistsError):
        frame = spark.createDataFrame([("a", bytearray(images.encode_png(picture)))], "sample_id string, content binary")
        writers.images(frame, f"file://{tmp_path}/new")
        writers.images(frame, f"file://{tmp_path}/new")
    writers.images(frame, f"file://{tmp_path}/new", force=True)
    assert os.listdir(f"{tmp_path}/new") == ["a.png"]


def filtered_png(picture, kind):
    """Each row by one of the filters of the format, channels side by side."""
    import zlib

    import numpy as np

    h, w, c = picture.shape
    rows, above = [], np.zeros(w * c, int)
    for row in picture.reshape(h, -1).astype(int):
        left, corner = (np.concatenate([np.zeros(c, int), x[:-c]]) for x in (row, above))
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0, left, above, (left + above) // 2, paeth)[kind]
        rows.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    return images.SIGNATURE + images._chunk(b"IHDR", head) + images._chunk(b"IDAT", zlib.compress(b"".join(rows))) + images._chunk(b"IEND", b"")


def test_png_filters():
    import numpy as np

    rng = np.random.default_rng(3)
    for c in (1, 3):
        picture = rng.integers(0, 256, (9, 11, c)).astype(np.uint8)
        want = picture[..., 0] if c == 1 else np.rint(picture @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
        for kind in range(5):
            assert (images.decode_png(filtered_png(picture, kind)) == want).all(), (c, kind)


def test_adapter_contract(spark):
    class Odd:
        tries = 0

        def read(self, content):
            Odd.tries += 1
            if content == b"slow" and Odd.tries == 1:
                raise TimeoutError
            if content == b"long":
                raise adapters.Truncated
            if content == b"bad":
                raise ValueError
            return content.decode()

    rows = [("a", b"slow"), ("b", b"long"), ("c", b"bad"), ("d", None), ("e", b"ok")]
    files = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "sample_id string, content binary").coalesce(1)
    got = [(r.sample_id, r.status, r.retry_count, r.raw_prediction, r.model_id) for r in adapters.recognise(files, Odd, {"model_id": "m"}).collect()]
    assert got == [("a", "timeout", 0, "", "m"), ("a", "success", 1, "slow", "m"), ("b", "truncated", 0, "", "m"), ("c", "crash", 0, "", "m"), ("c", "crash", 1, "", "m"), ("d", "missing", 0, "", "m"), ("e", "success", 0, "ok", "m")]


def test_configs_and_metadata(spark, tmp_path):
    assert readers.registry(spark, '[{"id": "a.b", "track": "pipeline", "requires_api_key": true}]').first().id == "a.b"
    p = readers.prompts(spark, '{"p1": "read"}').first()
    assert (p.prompt_id, p.prompt_hash) == ("p1", hashlib.sha256(b"read").hexdigest())
    assert readers.benchmark_config('{"replicates": 3000}')["replicates"] == 3000
    with pytest.raises(ValueError, match="metric_weights"):
        readers.benchmark_config('{"metric_weights": {"canonical_cer": 0.5}}')
    writers.run_metadata(spark, str(tmp_path / "run"), model_id="m")
    found = json.loads(next((tmp_path / "run").glob("part*")).read_text())
    assert found["model_id"] == "m" and any(x.startswith("pyspark==") for x in found["packages"])
    manifest.require_assets(spark, [str(tmp_path)])
    with pytest.raises(FileNotFoundError, match="b.ttf"):
        manifest.require_assets(spark, [str(tmp_path), f"{tmp_path}/b.ttf"])


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from quire.sources import store

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_folder(Session)


def test_near_hashes_brute(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    base[:3] = [-h for h in base[:3]]
    hs = base + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in base]
    df = spark.createDataFrame(list(enumerate(hs)), "i int, h bigint")
    want = {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs)) if ((hs[i] ^ hs[j]) % (1 << 64)).bit_count() <= 3}
    for full in (1024, 2):
        got = [(r.id_a, r.id_b) for r in joins.near_hashes(df, "i", "h", 3, full=full).collect()]
        assert set(got) == want and len(got) == len(want)


def test_near_hashes_of_a_hot_key(spark):
    """A third of the hashes differ in their last 20 bits only: their keys are cut finer until few are left, and no link is lost."""
    import random

    rng = random.Random(6)
    hs = [(0x5A5A5A5A5A5 << 20 | rng.getrandbits(20)) - (1 << 63) for _ in range(300)] + [rng.getrandbits(64) - (1 << 63) for _ in range(600)] + [7, 7, 7]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, h bigint")
    first = {}
    for i, h in enumerate(hs):
        first.setdefault(h, i)
    want = {(first[h], i) for i, h in enumerate(hs) if first[h] < i}
    hashes = sorted(first, key=first.get)
    want |= {(first[a], first[b]) for k, a in enumerate(hashes) for b in hashes[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = [(r.id_a, r.id_b) for r in joins.near_hashes(df, "i", "h", 3, full=16).collect()]
    assert set(got) == want and len(got) == len(want) > 40


@pytest.mark.parametrize("parts", [1, 5])
def test_anchors_are_the_first_by_draw(spark, parts):
    rows = [(f"s{i}", ["x", "y", "other", None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, kind string").repartition(parts)
    got = sorted((r.kind, r.place, r.sample_id) for r in joins.anchors(df, "kind", {"x": 7, "y": 200, "z": 3}, "seed").collect())
    want = []
    for kind, quota in (("x", 7), ("y", 200)):
        own = sorted((hashlib.md5(f"seed|{s}".encode()).hexdigest(), s) for s, k in rows if k == kind)[:quota]
        want += [(kind, place, s) for place, (_, s) in enumerate(own, 1)]
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 9 and {r.model_id for r in rows if r["rank"] is None} >= {"spaceless", "failing", "partial", "repeating"}
    best = next(r for r in rows if r.model_id == "exact")
    assert best["rank"] == 1 and best.statistical_tier == 1 and 100.0 > best.persian_ocr_score > 99.0 > best.robustness
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_replicates_draw_as_many_clusters_as_there_are(spark):
    """Each replicate's weights add up to the number of clusters, however few there are, and the sums are those of a join."""
    rows = [(f"m{i % 5}", f"c{i % 3}", i * 1_000_003, -i) for i in range(200)]
    frame = spark.createDataFrame(rows, "model_id string, cluster_id string, x bigint, y bigint").repartition(5)
    drawn = bootstrap.resampled_weights(frame, 64, "s")
    totals = {r.replicate: r.n for r in drawn.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()}
    assert totals == {r: 3 for r in range(64)}
    got = bootstrap.replicate_sums(frame, ["model_id"], ["x", "y"], 64, "s", None).where("x <> 0 OR y <> 0")
    want = drawn.join(frame, "cluster_id").groupBy("replicate", "model_id").agg(F.sum(F.col("x") * F.col("weight")), F.sum(F.col("y") * F.col("weight")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert bootstrap.replicate_sums(frame.limit(0), ["model_id"], ["x"], 24, "s", None).count() == 0


def test_span_hits_alone_are_those_of_all_counts(spark):
    """With composed, tatweel, heh with hamza and presentation forms before a span, lines that lose, gain and exchange letters, CRLF, and no spans; nothing is shuffled."""
    from quire.operators.statistics import span_hits

    from quire.functions import align

    fronts = ["", "á́ ", "سـ ", "ۀ ", "ﻻ ", "شماره ", "ab\r\n"]
    rows = []
    for i, f in enumerate(fronts * 3):
        raw, line = f"{i}7{i}", f"{f}{i}7{i} با 12.50"
        spans = [dict(start=len(f), end=len(f) + len(raw), type="integer", raw=raw, canonical_value=raw, preserve_leading_zero=False), dict(start=len(line) - 5, end=len(line), type="price", raw="12.50", canonical_value="12.50", preserve_leading_zero=False)]
        rows += [(f"m{k}", line, p, False, s) for k, p in enumerate((line, line.replace("7", "1"), line.rsplit(" ", 1)[0], "x " + line + "\n", line.replace("5", "2").replace("2", "5"), "")) for s in (spans, [])]
    grid = spark.createDataFrame(rows, "model_id string, reference_raw string, prediction string, is_blank boolean, numeric_spans array<struct<start:int,end:int,type:string,raw:string,canonical_value:string,preserve_leading_zero:boolean>>")
    keys = ["model_id", "reference_raw", "prediction", F.to_json("numeric_spans"), "span_hits"]
    got, want = span_hits(grid), line_statistics(grid)
    assert sorted(map(str, got.select(*keys).collect())) == sorted(map(str, want.select(*keys).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rng = __import__("random").Random(2)
    for _ in range(3000):  # moves that need no table are those of the table
        a = "".join(rng.choices("ab1", k=rng.randint(0, 9)))
        b = "".join(c for c in a if rng.random() < 0.7) if rng.random() < 0.5 else "".join(rng.choice("ab1c") if rng.random() < 0.3 else c for c in a)
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        plain = align._plain_path(a, b)
        if a != b and plain is not None:
            band, out = align._Band(*align._codes(a, b)), []
            j = align._back(band, band.first(), 0, len(a), len(b), out)
            assert plain == "".join(reversed([*out, "I" * j])), (a, b)
