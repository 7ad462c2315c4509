"""Checks of a manifest. Each gives violations (check, sample_id, detail); an empty union is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ZWNJ, slice_of
from quire.operators.joins import leaked, numbered, repeated_checksums
from quire.sources.schemas import ATTRIBUTE_MINIMA, QUOTAS, SPLIT_SIZES
from quire.sources.store import stored

PNG = "89504E470D0A1A0A"
LEAST_WIDTH, LEAST_HEIGHT, LEAST_SPREAD = 200, 30, 40


def _where(df: DataFrame, check: str, condition: Column, detail: Column) -> DataFrame:
    return df.where(condition).select(F.lit(check).alias("check"), F.col("sample_id").cast("string").alias("sample_id"), detail.cast("string").alias("detail"))


def expected_ids(samples: DataFrame, prefix: str, n: int, width: int = 3) -> DataFrame:
    """V1: in the order of `line`, ids are prefix1 ... prefixN. Each line is compared with the id of its place; ids missing at the end are one more violation."""
    places = numbered(samples.select("line", "sample_id"), "line")
    want = F.when(F.col("place") < n, F.concat(F.lit(prefix), F.lpad((F.col("place") + 1).cast("string"), width, "0")))
    wrong = _where(places, "V1", ~F.col("sample_id").eqNullSafe(want), F.coalesce(want, F.lit("one too many")))
    few = places.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n).select(F.lit("V1").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.concat(F.lit("only "), F.col("n").cast("string")).alias("detail"))
    return wrong.unionByName(few)


def files(joined: DataFrame) -> DataFrame:
    """V2, V3, V5, V6 of samples with `content` (null: the file is missing, and nothing else is asked of it). Format and size come from the PNG header."""
    head, size = F.hex(F.substring("content", 1, 8)), lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("bigint")
    there = F.col("content").isNotNull()
    small = there & (head == PNG) & ((size(17) < LEAST_WIDTH) | (size(21) < LEAST_HEIGHT))
    parts = [
        _where(joined, "V2", ~there, F.col("image_path")),
        _where(joined, "V3", there & (F.sha2("content", 256) != F.col("sha256")), F.sha2("content", 256)),
        _where(joined, "V5", there & (head != PNG), head),
        _where(joined, "V6", small, F.concat_ws("x", size(17), size(21))),
    ]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_files(samples: DataFrame) -> DataFrame:
    """V4."""
    return _where(repeated_checksums(samples), "V4", F.lit(True), F.col("sha256"))


def contrast(pixels: DataFrame) -> DataFrame:
    """V7, V8 of decoded images (sample_id, is_blank, low, high: greyscale extrema)."""
    flat = ~F.col("is_blank") & (F.col("high") - F.col("low") < LEAST_SPREAD)
    return _where(pixels, "V7", flat, F.col("high") - F.col("low")).unionByName(_where(pixels, "V8", F.col("is_blank") & (F.col("low") >= 255), F.col("low")))


def labels(samples: DataFrame) -> DataFrame:
    """V9 blank and reference agree, V10 spans select their text, V11 the zwnj tag has a ZWNJ, V18 no forbidden control characters."""
    spans = samples.select("sample_id", "reference_raw", F.explode("numeric_spans").alias("s"))
    selected = slice_of(F.col("reference_raw"), F.col("s.start"), F.col("s.end"))
    parts = [
        _where(samples, "V9", F.col("is_blank") != (F.col("reference_raw") == ""), F.col("reference_raw")),
        _where(spans, "V10", selected != F.col("s.raw"), F.col("s.raw")),
        _where(samples, "V11", F.array_contains("attributes", "zwnj") & ~F.contains("reference_raw", F.lit(ZWNJ)), F.lit("no ZWNJ")),
        _where(samples, "V18", F.col("reference_raw").rlike(r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"), F.lit("control character")),
    ]
    return _all(parts)


def split_sizes(samples: DataFrame, sizes: dict[str, int] = SPLIT_SIZES) -> DataFrame:
    """V13."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    got = samples.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("want", F.coalesce(F.try_element_at(want, F.col("split")), F.lit(0)))
    return got.where("n <> want").select(F.lit("V13").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.concat_ws(" ", "split", "n", "want").alias("detail"))


def quotas(samples: DataFrame, wanted: dict[str, tuple[int, int]] = QUOTAS) -> DataFrame:
    """Split, primary_stratum, n, want of every quota that isn't met exactly."""
    rows = [(s, name, n) for name, both in wanted.items() for s, n in zip(("dev", "test"), both, strict=True)]
    want = samples.sparkSession.createDataFrame(rows, "split string, primary_stratum string, want long")
    got = samples.where(F.col("split").isin("dev", "test")).groupBy("split", "primary_stratum").agg(F.count(F.lit(1)).alias("n"))
    both = F.broadcast(want).join(got, ["split", "primary_stratum"], "full")
    return both.select("split", "primary_stratum", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("want", F.lit(0)).alias("want")).where("n <> want")


def attributes(samples: DataFrame) -> DataFrame:
    """Attribute, n of what the minima ask for, in one pass."""
    zwnj = F.size(F.split("reference_raw", ZWNJ)) - 1
    kinds = lambda *k: F.size(F.filter("numeric_spans", lambda s: s["type"].isin(*k)))
    digits = lambda c: F.size(F.filter("numeric_spans", lambda s: s["raw"].rlike(f"[{c}]")))
    counted = samples.agg(
        F.count_distinct("source_document_id").alias("source_documents"), F.count_distinct("writer_id").alias("writers"), F.count_if(zwnj > 0).alias("zwnj_lines"), F.sum(zwnj).alias("zwnj_boundaries"),
        F.sum(F.size("numeric_spans")).alias("numeric_spans"), F.sum(kinds("date", "time")).alias("dates_times"), F.sum(kinds("price", "currency")).alias("prices"), F.sum(kinds("percentage")).alias("percentages"),
        F.sum(kinds("phone", "id", "postal_code", "serial")).alias("identifiers"), F.sum(digits("۰-۹")).alias("persian_digit_spans"), F.sum(digits("0-9")).alias("latin_digit_spans"), F.sum(digits("٠-٩")).alias("arabic_digit_spans"),
        F.count_if(F.col("reference_raw").rlike("[A-Za-z]") & F.col("reference_raw").rlike(r"[\x{0600}-\x{06FF}]")).alias("mixed_lines"), F.count_if("is_blank").alias("blank_crops"),
        F.count_distinct(F.get(F.filter("attributes", lambda a: a.startswith("font:")), F.lit(0))).alias("font_families"),
    )
    names = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.lit(0)).cast("bigint").alias("n"), F.lit(m).cast("bigint").alias("least")) for a, m in ATTRIBUTE_MINIMA.items()])
    return counted.select(F.explode(names).alias("x")).select("x.*")


def provenance(samples: DataFrame, least_real: int = 500, most_synthetic: int = 149, most_lines: int = 4) -> DataFrame:
    """Numbers of real and synthetic samples, and documents with too many lines."""
    by_origin = samples.agg(F.count_if(F.col("origin") == "real").alias("real"), F.count_if(F.col("origin") == "synthetic").alias("synthetic"))
    bad = by_origin.where((F.col("real") < least_real) | (F.col("synthetic") > most_synthetic)).select(F.lit("V16").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.concat_ws(" ", "real", "synthetic").alias("detail"))
    many = samples.groupBy("source_document_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_lines)
    return bad.unionByName(many.select(F.lit("V16").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.concat_ws(" ", "source_document_id", "n").alias("detail")))


def leakage(samples: DataFrame) -> DataFrame:
    """Documents and writers in both dev and test."""
    parts = [leaked(samples, c).select(F.lit("V17").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.concat_ws(" ", F.lit(c), F.col(c)).alias("detail")) for c in ("source_document_id", "writer_id")]
    return _all(parts)


def reviews(samples: DataFrame, hard: Column, least_share: float = 0.2) -> DataFrame:
    """Hard samples have two reviews, and at least the share of the others has. Needs n_reviews."""
    missing = _where(samples, "V19", hard & (F.col("n_reviews") < 2), F.col("n_reviews"))
    share = samples.where(~hard).agg(F.avg((F.col("n_reviews") >= 2).cast("double")).alias("share")).where(F.col("share") < least_share)
    return missing.unionByName(share.select(F.lit("V19").alias("check"), F.lit(None).cast("string").alias("sample_id"), F.col("share").cast("string").alias("detail")))


def repeats(first: DataFrame, second: DataFrame) -> DataFrame:
    """Predictions (model_id, sample_id, raw_prediction) that differ between two runs."""
    a, b = (x.select("model_id", "sample_id", "raw_prediction") for x in (first, second))
    return _where(a.exceptAll(b).unionByName(b.exceptAll(a)).distinct(), "V21", F.lit(True), F.concat_ws(" ", "model_id", "raw_prediction"))


NAMED = 1000


def require(violations: DataFrame) -> None:
    """All errors together, or nothing. The message has their number, and names the first NAMED of them."""
    found = stored(violations, "violations")
    if n := found.count():
        named = found.orderBy("check", "sample_id", "detail").limit(NAMED).collect()
        more = [f"and {n - len(named)} more"] if n > len(named) else []
        raise ValueError("\n".join([f"{n} violations", *(f"{v['check']} {v['sample_id']}: {v['detail']}" for v in named), *more]))
