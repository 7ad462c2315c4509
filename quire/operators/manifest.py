"""Columns and audits of manifests and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLIC = "public_domain_source"


def source_document(origin: Column, sample_id: Column, real: str = PUBLIC) -> Column:
    """One document for all real samples, one of its own for each made one."""
    return F.when(origin == "real", real).otherwise(F.concat(F.lit("synthetic_"), sample_id))


def blank(reference: Column) -> Column:
    """P2."""
    return reference == ""


def relative_path(path: Column, root: str) -> Column:
    """A path below root as a POSIX path from there; null for a path outside it. Backslashes are separators, and doubled separators one."""
    plain = lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "/+", "/")
    own, top = plain(path), F.concat(F.regexp_replace(plain(F.lit(root)), "/$", ""), F.lit("/"))
    return F.when(own.startswith(top), F.substring(own, F.char_length(top) + 1, F.char_length(own)))


def image_kind(sample_id: Column, scans: list[str], blanks: list[str]) -> Column:
    """P5: how a sample's image is made: cut from a scan, without text, or rendered."""
    return F.when(sample_id.isin(*scans), "scan").when(sample_id.isin(*blanks), "blank").otherwise("render")


# Fixed value: what stands where a registry names no revision.
NO_REVISION = "EXACT_COMMIT_HASH"


def reproducible(revision: Column, track: Column) -> Column:
    return revision.isNotNull() & (revision != NO_REVISION) & (track != "unavailable")


def audit(registry: DataFrame) -> DataFrame:
    """The eight questions about each candidate; null where the registry can't answer, and `open_questions` counts these. registry: its columns and persian_tokenizer."""
    c = F.col
    answers = {
        "image_to_text": c("track") != "not_ocr",
        "public_checkpoint": c("repository").isNotNull() & (c("availability") == "ready") & ~c("requires_api_key"),
        "persian_output": c("persian_tokenizer"),
        "needs_detector": c("input_mode") == "page_image",
        "needs_line_crops": c("input_mode") == "line_image",
        "needs_api_key": c("requires_api_key"),
        "reproducible": reproducible(c("revision"), c("track")),
        "official_revision": F.when(c("revision") != NO_REVISION, c("revision")),
    }
    missing = sum((v.isNull().cast("int") for v in answers.values()), F.lit(0))
    return registry.select("id", *[v.alias(k) for k, v in answers.items()], missing.alias("open_questions"))


def freeze_set(predictions: DataFrame) -> DataFrame:
    """model_id, configurations, prompts, revisions, frozen: whether all predictions of a model come from one setting."""
    counts = predictions.groupBy("model_id").agg(F.count_distinct("config_hash").alias("configurations"), F.count_distinct("prompt_hash").alias("prompts"), F.count_distinct("model_revision", "adapter_version").alias("revisions"))
    return counts.withColumn("frozen", (F.col("configurations") == 1) & (F.col("prompts") == 1) & (F.col("revisions") == 1))


def preview(frame: DataFrame, order: str, rows: int = 50, column: str | None = None, characters: int = 10_000) -> DataFrame:
    """The first rows by a column, long texts cut; the limits are what a preview is."""
    first = frame.orderBy(order).limit(rows)
    return first.withColumn(column, F.substring(column, 1, characters)) if column else first


def missing_assets(spark: SparkSession, paths: list[str]) -> list[str]:
    """Which of the files aren't there, by any store that Spark reads."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def require_assets(spark: SparkSession, paths: list[str]) -> None:
    """An error that names all missing files."""
    if found := missing_assets(spark, paths):
        raise FileNotFoundError(f"missing assets: {', '.join(found)}")
