"""A benchmark made from the test tables. The systems are deterministic corruptions, not real recognisers.

Samples come from `benchmark`: its whole text with Latin letters read as Persian ones, ZWNJ for some spaces and a
number at the end. The smoke set is a literal of twenty lines. The SQL says the same, for the comparison with DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.text import ZWNJ
from quire.operators import joins, manifest
from quire.sources.schemas import ANCHORS, CORRUPTIONS, QUOTAS, REGISTRY, SPANS, STRATA  # noqa: F401

LATIN, LETTERS = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزژسشصضطظعغفقکی"
PERSIAN, ARABIC = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
SYSTEMS = ["exact", "dropping", "swapping", "repeating", "spaceless", "preamble", "arabic", "failing", "partial"]

#: The smoke set: reference, stratum, origin, attributes, number spans (type, as written). One line is blank.
SMOKE = [
    ("صبح زود به بازار رفتیم و نان تازه خریدیم.", STRATA[0], "synthetic", [], []),
    ("کوه‌های شمال در زمستان پر از برف‌اند.", STRATA[0], "synthetic", ["zwnj"], []),
    ("او هر شب پیش از خواب کتاب می‌خواند.", STRATA[0], "synthetic", ["zwnj"], []),
    ("باران آرام روی بام می‌بارید.", STRATA[0], "synthetic", ["zwnj", "small_font"], []),
    ("آیا می‌دانی راه کجاست؟ نه، نمی‌دانم!", STRATA[0], "synthetic", ["zwnj", "punctuation"], []),
    ("در باغ پشت خانه درخت انار کاشتند", STRATA[1], "real", ["real_scan"], []),
    ("رودخانه از میان دشت می‌گذرد.", STRATA[0], "synthetic", ["zwnj", "jpeg"], []),
    ("عکس را از پنجرهٔ قطار گرفتم.", STRATA[2], "synthetic", ["mobile_photo"], []),
    ("نامه‌ات دیروز به دستم رسید.", STRATA[3], "synthetic", ["zwnj", "handwriting"], []),
    ("دوست من خط خوشی دارد.", STRATA[3], "synthetic", ["handwriting", "cursive"], []),
    ("بچه‌ها توپ‌هایشان را پیدا کرده‌اند.", STRATA[0], "synthetic", ["zwnj"], []),
    ("گل‌فروش دسته‌گل‌ها را کنار در چید.", STRATA[0], "synthetic", ["zwnj"], []),
    ("تلفن: ۰۲۱۵۵۶۶۷۷۸۸", STRATA[4], "synthetic", ["persian_digits"], [("phone", "۰۲۱۵۵۶۶۷۷۸۸")]),
    ("پلاک 4521 در سال 1999 صادر شد", STRATA[4], "synthetic", ["latin_digits"], [("integer", "4521"), ("integer", "1999")]),
    ("ساعت ۰۷:۱۵ روز ۱۳۹۸/۱۱/۰۲ بلیت ۳۲٬۵۰۰ تومان و ۸٪ مالیات دارد", STRATA[4], "synthetic", ["persian_digits"], [("time", "۰۷:۱۵"), ("date", "۱۳۹۸/۱۱/۰۲"), ("price", "۳۲٬۵۰۰"), ("percentage", "۸٪")]),
    ("فصل سوم series آغاز شد", STRATA[5], "synthetic", ["mixed_script"], []),
    ("او گفت Hi و رفت.", STRATA[5], "synthetic", ["mixed_script"], []),
    ("کارگران پس از پایان کار روزانه کنار رودخانه نشستند، چای نوشیدند و از سفرهای دور و دراز خود برای یکدیگر گفتند.", STRATA[0], "synthetic", ["long_line"], []),
    ("پادشاه فرمان داد تا دروازه‌های شهر را ببندند", STRATA[6], "real", ["historical", "real_scan"], []),
    ("", STRATA[7], "synthetic", ["blank"], []),
]
#: What a line costs at a system that is paid for.
COSTS = {"preamble": 0.002, "arabic": 0.001}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    number = (i * 37 + 1005).cast("string")
    letters = F.translate(F.replace(F.translate(F.lower("text"), "\n", " "), F.lit(" th"), F.lit(f"{ZWNJ}th")), LATIN, LETTERS)
    blank = i % 20 == 19
    digits = F.translate(number, "0123456789", PERSIAN)
    line = F.when(blank, "").otherwise(F.concat(letters, F.lit(" "), digits))
    rows = table(spark, sf_dir, "benchmark").select("item_id", line.alias("reference_raw"), digits.alias("digits"), number.alias("number"), blank.alias("is_blank"))
    stratum = F.when(F.col("is_blank"), STRATA[7]).otherwise(F.element_at(F.array(*[F.lit(s) for s in STRATA[:7]]), (i % 7 + 1).cast("int")))
    n = F.char_length("reference_raw")
    span = F.struct((n - F.char_length("digits")).alias("start"), n.alias("end"), F.lit("integer").alias("type"), F.col("digits").alias("raw"), F.col("number").alias("canonical_value"), F.lit(False).alias("preserve_leading_zero"))
    return rows.select(
        "item_id",
        F.concat(F.lit("s"), F.lpad(i.cast("string"), 4, "0")).alias("sample_id"),
        F.when(i % 4 == 0, "dev").otherwise("test").alias("split"),
        F.sha2("reference_raw", 256).alias("sha256"),
        F.concat(F.lit("d"), F.floor(i / 4).cast("string")).alias("source_document_id"),
        F.when(stratum == "persian_handwriting", F.concat(F.lit("w"), (i % 3).cast("string"))).alias("writer_id"),
        "reference_raw",
        stratum.alias("primary_stratum"),
        F.when(F.contains("reference_raw", F.lit(ZWNJ)), F.array(F.lit("zwnj"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
        F.when(i % 5 == 0, "synthetic").otherwise("real").alias("origin"),
        F.when(F.col("is_blank"), F.array().cast(SPANS)).otherwise(F.array(span)).alias("numeric_spans"),
        "is_blank",
    )


def literal_samples(spark: SparkSession, rows: list[tuple], prefix: str = "smoke_", split: str = "smoke") -> DataFrame:
    """Samples written down in the program. Ids, checksums, source documents, blanks and the offsets of the spans are derived."""
    base = spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "item_id long, reference_raw string, primary_stratum string, origin string, attributes array<string>, raws array<struct<type:string,raw:string>>")
    found = text.numeric_spans(F.col("reference_raw"), F.col("raws"))
    spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["raw"].alias("raw"), text.numeric_value(s["raw"], s["type"], s["preserve_leading_zero"]).alias("canonical_value"), s["preserve_leading_zero"].alias("preserve_leading_zero")))
    return base.withColumn("sample_id", text.padded_id(prefix, F.col("item_id"))).select(
        "item_id", "sample_id", F.lit(split).alias("split"), F.sha2("reference_raw", 256).alias("sha256"),
        manifest.source_document(F.col("origin"), F.col("sample_id")).alias("source_document_id"), F.lit(None).cast("string").alias("writer_id"), "reference_raw", "primary_stratum", "attributes", "origin",
        spans.cast(SPANS).alias("numeric_spans"), manifest.blank(F.col("reference_raw")).alias("is_blank"),
    )


def smoke(spark: SparkSession) -> DataFrame:
    return literal_samples(spark, SMOKE)


def gate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty lines of `benchmark` that stand for the smoke set in the gate: its size is the gate's."""
    return samples(spark, sf_dir).where(F.col("item_id") < len(SMOKE))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SYSTEMS], "model_id string")


def output(m: Column, r: Column) -> Column:
    """What a system reads where the line says r."""
    return (
        F.when(m == "dropping", F.replace(r, F.lit("ر"), F.lit("")))
        .when(m == "swapping", F.translate(r, "ثس", "اش"))
        .when(m == "repeating", F.concat(r, F.lit(" "), r))
        .when(m == "spaceless", F.replace(F.replace(r, F.lit(" "), F.lit("")), F.lit(ZWNJ), F.lit(" ")))
        .when(m == "preamble", F.concat(F.lit("Here is: "), r))
        .when(m == "arabic", F.replace(F.translate(r, "یک" + PERSIAN, "يك" + ARABIC), F.lit("س"), F.lit("سـ")))
        .otherwise(r)
    )


def attempts(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """All attempts at samples (item_id, sample_id, reference_raw). The system named failing times out at first and on every third sample again, or crashes; the one named partial has no rows for every fifth sample and a cut one for the next; the one named repeating has changed its configuration on the way."""
    rows = joins.each_model(rows.select("item_id", "sample_id", "reference_raw"), models(spark))
    m, i = F.col("model_id"), F.col("item_id")
    tries = F.explode(F.when(m == "failing", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("retry_count")
    tried = rows.where(~((m == "partial") & (i % 5 == 0))).select("*", output(m, F.col("reference_raw")).alias("raw_prediction"), tries)
    status = (
        F.when((m == "failing") & (F.col("retry_count") == 0), "timeout").when((m == "failing") & (i % 6 == 0), "crash").when((m == "failing") & (i % 3 == 0), "timeout").when((m == "partial") & (i % 5 == 1), "truncated").otherwise("success")
    )
    setting = F.when((m == "repeating") & (i % 10 == 0), 0.2).otherwise(0.0)
    cost = F.coalesce(*[F.when(m == k, v) for k, v in COSTS.items()], F.lit(0.0))
    return tried.select(
        "model_id",
        "sample_id",
        F.when(status == "success", F.col("raw_prediction")).otherwise("").alias("raw_prediction"),
        status.alias("status"),
        "retry_count",
        (100 + i * 7919 % 400).cast("bigint").alias("runtime_ms"),
        (1000 + F.length("model_id") * 10).cast("bigint").alias("peak_vram_mb"),
        cost.alias("api_cost"),
        F.lit("r1").alias("model_revision"),
        F.lit("1.0.0").alias("adapter_version"),
        text.sha256(F.lit(PROMPT)).alias("prompt_hash"),
        text.config_hash(F.lit("r1").alias("revision"), setting.alias("temperature"), F.lit(512).alias("max_new_tokens")).alias("config_hash"),
    )


#: An instruction of our own; a benchmark sends one to every system and keeps its hash.
PROMPT = "Write down the line of text in the picture as it stands, and nothing else."


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(samples(spark, sf_dir), spark)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, anchor_type, place: the parents of the robustness set."""
    s = F.col("primary_stratum")
    kind = F.when(s == "clean_modern_printed", "modern_print").when(s == "persian_handwriting", "handwriting").when(s.isin("numeric_heavy", "mixed_persian_english"), s).otherwise("form_like")
    typed = samples(spark, sf_dir).where(~F.col("is_blank")).select("sample_id", kind.alias("anchor_type"))
    return joins.anchors(typed, "anchor_type", ANCHORS, "anchors")


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, sample_id, parent_sample_id, corruption, severity, reference_raw, prediction: each system on each degraded anchor of the test split, and on the anchor itself (corruption null, severity 0). The worse a line is degraded, the more of its end is lost."""
    own = samples(spark, sf_dir).where("split = 'test'").join(anchors(spark, sf_dir).select("sample_id"), "sample_id", "left_semi")
    grid = joins.inherit(joins.corruption_grid(own, CORRUPTIONS), own, ["reference_raw"])
    lost = F.col("severity") * (F.char_length("corruption") % 3 + 1) * 4
    seen = grid.select("sample_id", "parent_sample_id", "corruption", "severity", "reference_raw", F.substring("reference_raw", F.lit(1), F.char_length("reference_raw") - lost).alias("seen"))
    clean = own.select("sample_id", F.col("sample_id").alias("parent_sample_id"), F.lit(None).cast("string").alias("corruption"), F.lit(0).alias("severity"), "reference_raw", F.col("reference_raw").alias("seen"))
    rows = joins.each_model(seen.unionByName(clean), models(spark))
    return rows.select("model_id", "sample_id", "parent_sample_id", "corruption", "severity", "reference_raw", output(F.col("model_id"), F.col("seen")).alias("prediction"))


TRACKS = {"preamble": "pipeline", "spaceless": "not_ocr"}


def registry(spark: SparkSession) -> DataFrame:
    rows = [
        (s, s.title(), TRACKS.get(s, "general_line_recognition"), "stub", None if s == "partial" else f"demo/{s}", "r1" if s != "swapping" else "EXACT_COMMIT_HASH", "ready", s in COSTS, "page_image" if s == "preamble" else "line_image", "p1", 512, 0.0, "none", "cpu", "1.0.0", None if s == "failing" else True)
        for s in SYSTEMS
    ]
    return spark.createDataFrame(rows, f"{REGISTRY}, persian_tokenizer boolean")


SAMPLES_SQL = f"""
base AS (
  SELECT item_id, item_id % 20 = 19 AS is_blank, (item_id * 37 + 1005)::VARCHAR AS number,
         translate((item_id * 37 + 1005)::VARCHAR, '0123456789', '{PERSIAN}') AS digits,
         translate(replace(translate(lower(text), chr(10), ' '), ' th', '{ZWNJ}th'), '{LATIN}', '{LETTERS}') AS letters
  FROM benchmark
), samples AS (
  SELECT item_id, 's' || lpad(item_id::VARCHAR, 4, '0') AS sample_id, CASE WHEN item_id % 4 = 0 THEN 'dev' ELSE 'test' END AS split,
         sha256(CASE WHEN is_blank THEN '' ELSE letters || ' ' || digits END) AS sha256, 'd' || (item_id // 4)::VARCHAR AS source_document_id,
         CASE WHEN NOT is_blank AND item_id % 7 = 3 THEN 'w' || (item_id % 3)::VARCHAR END AS writer_id,
         CASE WHEN is_blank THEN '' ELSE letters || ' ' || digits END AS reference_raw, digits, number,
         CASE WHEN is_blank THEN '{STRATA[7]}' ELSE list_extract({STRATA[:7]!r}, (item_id % 7 + 1)::INT) END AS primary_stratum,
         CASE WHEN item_id % 5 = 0 THEN 'synthetic' ELSE 'real' END AS origin, is_blank
  FROM base
)"""

SMOKE_SQL = "samples AS (SELECT item_id, 'smoke_' || lpad(item_id::VARCHAR, 3, '0') AS sample_id, 'smoke' AS split, NULL::VARCHAR AS source_document_id, reference_raw, primary_stratum, origin, reference_raw = '' AS is_blank FROM (VALUES " + ", ".join(
    f"({k}, '{r[0]}', '{r[1]}', '{r[2]}')" for k, r in enumerate(SMOKE, 1)
) + ") t(item_id, reference_raw, primary_stratum, origin))"


def output_sql(m: str, r: str) -> str:
    return f"""CASE WHEN {m} = 'dropping' THEN replace({r}, 'ر', '') WHEN {m} = 'swapping' THEN translate({r}, 'ثس', 'اش')
              WHEN {m} = 'repeating' THEN {r} || ' ' || {r} WHEN {m} = 'spaceless' THEN replace(replace({r}, ' ', ''), '{ZWNJ}', ' ')
              WHEN {m} = 'preamble' THEN 'Here is: ' || {r}
              WHEN {m} = 'arabic' THEN replace(translate({r}, 'یک{PERSIAN}', 'يك{ARABIC}'), 'س', 'سـ') ELSE {r} END"""


GRID_SQL = f"""models AS (
  SELECT unnest({SYSTEMS!r}) AS model_id
), attempts AS (
  SELECT model_id, sample_id, item_id, reference_raw AS r, unnest(CASE WHEN model_id = 'failing' THEN [0, 1] ELSE [0] END) AS retry_count
  FROM samples CROSS JOIN models WHERE NOT (model_id = 'partial' AND item_id % 5 = 0)
), outcomes AS (
  SELECT *, CASE WHEN model_id = 'failing' AND retry_count = 0 THEN 'timeout' WHEN model_id = 'failing' AND item_id % 6 = 0 THEN 'crash' WHEN model_id = 'failing' AND item_id % 3 = 0 THEN 'timeout'
    WHEN model_id = 'partial' AND item_id % 5 = 1 THEN 'truncated' ELSE 'success' END AS status FROM attempts
), predictions AS (
  SELECT model_id, sample_id, item_id, retry_count, (100 + item_id * 7919 % 400)::BIGINT AS runtime_ms, (1000 + length(model_id) * 10)::BIGINT AS peak_vram_mb, status,
         CASE WHEN status = 'success' THEN {output_sql('model_id', 'r')} ELSE '' END AS raw_prediction,
         CASE {' '.join(f"WHEN model_id = '{k}' THEN {v}" for k, v in COSTS.items())} ELSE 0 END::DOUBLE AS api_cost,
         sha256('{{"revision":"r1","temperature":' || CASE WHEN model_id = 'repeating' AND item_id % 10 = 0 THEN '0.2' ELSE '0.0' END || ',"max_new_tokens":512}}') AS config_hash
  FROM outcomes
), final AS (
  SELECT * FROM predictions p WHERE retry_count = (SELECT max(q.retry_count) FROM predictions q WHERE q.model_id = p.model_id AND q.sample_id = p.sample_id)
), grid AS (
  SELECT m.model_id, s.sample_id, s.item_id, s.split, s.source_document_id, s.primary_stratum, s.is_blank, s.reference_raw, f.status, f.runtime_ms, f.peak_vram_mb,
         coalesce(CASE WHEN f.status = 'success' THEN f.raw_prediction END, '') AS prediction
  FROM models m CROSS JOIN samples s LEFT JOIN final f ON f.model_id = m.model_id AND f.sample_id = s.sample_id
)"""
PREDICTIONS_SQL = f"{SAMPLES_SQL}, {GRID_SQL}"
GATE_GRID_SQL = f"""{SAMPLES_SQL.replace("), samples AS (", "), every_sample AS (")}, samples AS (SELECT * FROM every_sample WHERE item_id < {len(SMOKE)}), {GRID_SQL}"""

ANCHORS_SQL = f"""typed AS (
  SELECT sample_id, CASE WHEN primary_stratum = 'clean_modern_printed' THEN 'modern_print' WHEN primary_stratum = 'persian_handwriting' THEN 'handwriting'
    WHEN primary_stratum IN ('numeric_heavy', 'mixed_persian_english') THEN primary_stratum ELSE 'form_like' END AS anchor_type FROM samples WHERE NOT is_blank
), quota(anchor_type, most) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in ANCHORS.items())}), placed AS (
  SELECT sample_id, anchor_type, row_number() OVER (PARTITION BY anchor_type ORDER BY md5('anchors|' || sample_id), sample_id) AS place FROM typed
), anchors AS (SELECT sample_id, anchor_type, place::INT AS place FROM placed JOIN quota USING (anchor_type) WHERE place <= most)"""

#: After SAMPLES_SQL and GRID_SQL.
DEGRADED_SQL = f"""{ANCHORS_SQL}, parents AS (
  SELECT sample_id, reference_raw FROM samples WHERE split = 'test' AND sample_id IN (SELECT sample_id FROM anchors)
), families AS (SELECT unnest({CORRUPTIONS!r}) AS corruption), severities AS (SELECT unnest([1, 2, 3]) AS severity), seen AS (
  SELECT sample_id || '__' || corruption || '_s' || severity::VARCHAR AS sample_id, sample_id AS parent_sample_id, corruption, severity, reference_raw,
         substr(reference_raw, 1, greatest(0, length(reference_raw) - severity * (length(corruption) % 3 + 1) * 4)) AS seen FROM parents CROSS JOIN families CROSS JOIN severities
  UNION ALL SELECT sample_id, sample_id, NULL, 0, reference_raw, reference_raw FROM parents
), degraded AS (
  SELECT model_id, sample_id, parent_sample_id, corruption, severity, reference_raw, {output_sql('model_id', 'seen')} AS prediction FROM seen CROSS JOIN models
)"""


def canonical_sql(x: str) -> str:
    """Steps of the canonical form that these texts need: composed letters, no presentation forms or bidi controls."""
    return f"translate(replace(replace(translate(nfc_normalize({x}), 'يىك', 'ییک'), 'ۀ', 'هٔ'), 'ـ', ''), '{PERSIAN}{ARABIC}', '01234567890123456789')"


#: One ASCII character for each other character of the texts made from `benchmark`, none of them used there: DuckDB's levenshtein counts bytes.
BYTES = str.maketrans(dict(zip(LETTERS + ZWNJ + "ßäçèéêíñóöü" + PERSIAN + ARABIC + "يكـ", "ABCDEFGIJKLMNOPQRSTUVWXYZabcdfghjklmnopqtuvwxyz!#$%&*+;<=>?@^_`|~"[:61], strict=True)))


def distance_sql(a: str, b: str) -> str:
    """The edit distance of two texts made from `benchmark`, in code points."""
    from_, to = "".join(map(chr, BYTES)), "".join(BYTES.values())
    return f"levenshtein(translate({a}, '{from_}', '{to}'), translate({b}, '{from_}', '{to}'))"


def alignment_sql(a: str, b: str, name: str = "aligned", source: str = "grid", split: str = "string_split({}, '')", steps: int = 11) -> str:
    """CTEs `name`_pairs, `name`_dp (a row of costs a reference item) and `name` (a, b, s, d, i, n): the edit counts of each distinct pair, by the recursion over the rows of the table. A row's running minimum is made in `steps` doublings, enough for 2 ** steps items."""
    la, lb = split.format("a"), split.format("b")
    costs = "list_prepend((i + 1) * 1048576, list_transform(range(1, len(ys) + 1), lambda j: least(costs[j + 1] + 1048576, costs[j] + CASE WHEN xs[i + 1] = ys[j] THEN 0 ELSE 1048575 END)))"
    row = f"SELECT a, b, xs, ys, i, list_transform({costs}, lambda v, j: v - (j - 1) * 1048576) AS u FROM {name}_dp WHERE i < len(xs)"
    for k in range(steps):
        row = f"SELECT a, b, xs, ys, i, list_transform(u, lambda v, j: least(v, u[greatest(1, j - {1 << k})])) AS u FROM ({row}) t{k}"
    return f"""{name}_pairs AS (
  SELECT a, b, CASE WHEN a = '' THEN [] ELSE {la} END AS xs, CASE WHEN b = '' THEN [] ELSE {lb} END AS ys FROM (SELECT DISTINCT {a} AS a, {b} AS b FROM {source}) t
), {name}_dp AS (
  SELECT a, b, xs, ys, 0 AS i, list_transform(range(0, len(ys) + 1), lambda j: j * 1048576) AS costs FROM {name}_pairs
  UNION ALL
  SELECT a, b, xs, ys, i + 1, list_transform(u, lambda v, j: v + (j - 1) * 1048576) AS costs FROM ({row}) done
), {name}_done AS (
  SELECT a, b, len(xs) AS n, len(ys) AS m, costs[-1] AS cost, (costs[-1] + 1048575) // 1048576 AS dist FROM {name}_dp WHERE i = len(xs)
), {name} AS (
  SELECT a, b, n, m, dist * 1048576 - cost AS s, (dist - (dist * 1048576 - cost) + n - m) // 2 AS d, (dist - (dist * 1048576 - cost) - n + m) // 2 AS i FROM {name}_done
)"""


def path_sql(name: str) -> str:
    """After alignment_sql: `name`_moves (a, b, i, j, move), the path of each pair from its end, diagonal before deletion before insertion; i and j are the items that a move ends with."""
    return f"""{name}_marks AS (
  SELECT c.a, c.b, c.i, array_to_string(list_transform(range(1, len(c.ys) + 1), lambda j: CASE WHEN c.costs[j + 1] = p.costs[j] + CASE WHEN c.xs[c.i] = c.ys[j] THEN 0 ELSE 1048575 END THEN CASE WHEN c.xs[c.i] = c.ys[j] THEN '=' ELSE 'S' END
    WHEN c.costs[j + 1] = p.costs[j + 1] + 1048576 THEN 'D' ELSE 'I' END), '') AS marks
  FROM {name}_dp c JOIN {name}_dp p ON p.a = c.a AND p.b = c.b AND p.i = c.i - 1
), {name}_ids AS (SELECT a, b, row_number() OVER () AS id, len(xs) AS n, len(ys) AS m FROM {name}_pairs), {name}_rows AS MATERIALIZED (
  SELECT k.id, r.i, r.marks FROM {name}_marks r JOIN {name}_ids k ON k.a = r.a AND k.b = r.b
), {name}_walk AS (
  SELECT k.id, k.n AS i, k.m AS j, coalesce(CASE WHEN k.m > 0 THEN r.marks[k.m] ELSE 'D' END, 'I') AS move FROM {name}_ids k LEFT JOIN {name}_rows r ON r.id = k.id AND r.i = k.n WHERE k.n > 0 OR k.m > 0
  UNION ALL
  SELECT w.id, w.ni, w.nj, coalesce(CASE WHEN w.nj > 0 THEN r.marks[w.nj] ELSE 'D' END, 'I') AS move
  FROM (SELECT id, CASE WHEN move = 'I' THEN i ELSE i - 1 END AS ni, CASE WHEN move = 'D' THEN j ELSE j - 1 END AS nj FROM {name}_walk) w LEFT JOIN {name}_rows r ON r.id = w.id AND r.i = w.ni
  WHERE w.ni > 0 OR w.nj > 0
), {name}_moves AS (SELECT k.a, k.b, w.i, w.j, w.move FROM {name}_walk w JOIN {name}_ids k ON k.id = w.id)"""
