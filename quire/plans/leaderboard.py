"""The flagship plan: grid, line statistics, metrics, intervals, tiers, ranks, and the views of the leaderboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import bootstrap, gates, joins, manifest, metrics
from quire.operators.statistics import line_statistics, summed
from quire.plans import demo
from quire.sources.schemas import METRIC_WEIGHTS
from quire.sources.store import stored

COMPONENTS = list(METRIC_WEIGHTS)


def cluster():
    return joins.cluster_key(F.col("primary_stratum"), F.col("origin"), F.col("source_document_id"), F.col("writer_id"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_statistics(joins.work_grid(demo.models(spark), demo.samples(spark, sf_dir), demo.predictions(spark, sf_dir)))


def gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = demo.gate_samples(spark, sf_dir)
    return line_statistics(joins.work_grid(demo.models(spark), samples, demo.attempts(samples, spark)))


def degraded_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, corruption, severity, cluster_id (the parent), cs, cd, ci, cn of the degraded anchors and, at severity 0, of the clean ones. Only the distance counts here, so it is all in cs."""
    rows = demo.degraded(spark, sf_dir)
    a, b = text.canonical(F.col("reference_raw")), text.canonical(F.col("prediction"))
    zero = F.lit(0).cast("bigint")
    sums = [F.sum(F.levenshtein("a", "b")).cast("bigint").alias("cs"), zero.alias("cd"), zero.alias("ci"), F.sum(F.char_length("a")).alias("cn")]
    return rows.select("model_id", "corruption", "severity", F.col("parent_sample_id").alias("cluster_id"), a.alias("a"), b.alias("b")).groupBy("model_id", "corruption", "severity", "cluster_id").agg(*sums)


def _added(frame: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


@dataclass
class Sums:
    """What all results are made from, computed once: lines of the test split, their sums by (model, stratum, cluster), and degraded sums by (model, corruption, severity, parent)."""

    lines: DataFrame
    clusters: DataFrame
    degraded: DataFrame

    @staticmethod
    def of(spark: SparkSession, sf_dir: str) -> Sums:
        lines = stored(lines_of(spark, sf_dir).where("split = 'test'").withColumn("cluster_id", cluster()), "lines")
        return Sums(lines, stored(summed(lines, "model_id", "primary_stratum", "cluster_id"), "sums"), stored(degraded_sums(spark, sf_dir), "degraded"))

    def cells(self) -> DataFrame:
        return _added(self.degraded, bootstrap.CELLS, "model_id", "corruption", "severity")

    def scores(self) -> DataFrame:
        """The ten metrics and the composite of each model."""
        by_stratum, overall = (_added(self.clusters, bootstrap.SUMMED, *k) for k in (("model_id", "primary_stratum"), ("model_id",)))
        cells = self.cells()
        kept = metrics.robustness(cells.where("severity = 0").drop("corruption", "severity"), cells.where("severity > 0"))
        return metrics.composite(metrics.balanced(by_stratum, overall, ["model_id"]).join(kept, "model_id", "left"))

    def replicates(self, replicates: int = bootstrap.REPLICATES, drawn=bootstrap.draws) -> DataFrame:
        return stored(bootstrap.replicate_scores(self.clusters, self.degraded, replicates, drawn=drawn), "scores")


def leaderboard(spark: SparkSession, sf_dir: str, replicates: int = bootstrap.REPLICATES, sums: Sums | None = None) -> DataFrame:
    sums = sums or Sums.of(spark, sf_dir)
    replicated = sums.replicates(replicates)
    board = sums.scores().join(bootstrap.intervals(replicated, "model_id"), "model_id")
    apart = bootstrap.difference_intervals(replicated)
    board = stored(board, "board")
    tiered = gates.tiers(board.select("model_id", "persian_ocr_score"), apart)
    failed = metrics.failures(sums.lines, "model_id").select("model_id", "completion", "failure_rate")
    attempts = demo.predictions(spark, sf_dir)
    speed = metrics.efficiency(attempts, "model_id")
    frozen = reproducibility(spark, sf_dir)
    kept = sums.lines.groupBy("model_id").agg(F.avg((F.col("raw_prediction").isNotNull()).cast("double")).alias("raw_share"))
    gate = gates.statuses(gates.smoke_gate(gate_lines(spark, sf_dir)), demo.registry(spark))
    joined = board.join(tiered.drop("persian_ocr_score"), "model_id").join(failed, "model_id").join(speed, "model_id").join(gate, "model_id").join(frozen.drop("track"), "model_id").join(kept, "model_id")
    able = gates.rankable(F.col("status"), F.col("completion"), F.col("reproducible"), F.col("track"), F.col("raw_share"))
    rounded = [F.round(c, 6).alias(c) for c in ("persian_ocr_score", "ci_low", "ci_high", *COMPONENTS, "failure_rate", "latency_mean", "latency_p95", "api_cost")]
    columns = ["rank", "statistical_tier", "model_id", "model_name", "track", "status", *rounded, "peak_vram_mb", "model_revision", "adapter_version", "prompt_hash"]
    return gates.ranked(joined, able).select(*columns, F.lit(text.VERSION).alias("canonical_version")).orderBy(F.col("rank").asc_nulls_last(), "model_id")


def reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_id, model_name, track, the revisions and hashes that the predictions carry, frozen, reproducible (a named revision, and one setting for all predictions)."""
    attempts = demo.predictions(spark, sf_dir)
    carried = attempts.groupBy("model_id").agg(*[F.array_join(F.sort_array(F.collect_set(c)), " ").alias(c) for c in ("model_revision", "adapter_version", "prompt_hash", "config_hash")])  # a few a model
    known = demo.registry(spark).select(F.col("id").alias("model_id"), F.col("display_name").alias("model_name"), "track", manifest.reproducible(F.col("revision"), F.col("track")).alias("named"))
    out = known.join(carried, "model_id").join(manifest.freeze_set(attempts).select("model_id", "frozen"), "model_id")
    return out.withColumn("reproducible", F.col("named") & F.col("frozen")).drop("named")


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """K5: the nine views."""
    sums = Sums.of(spark, sf_dir)
    board = stored(leaderboard(spark, sf_dir, sums=sums), "leaderboard")
    by_domain = metrics.scored(_added(sums.clusters, bootstrap.SUMMED, "model_id", "primary_stratum"))
    cells = sums.cells()
    kept = metrics.retention(cells.where("severity = 0").drop("corruption", "severity"), cells.where("severity > 0"), "model_id")
    failures = metrics.failures(sums.lines, "model_id")
    types = metrics.by_span_type(sums.lines, "model_id")
    nine = [c for c in COMPONENTS if c != "robustness"]
    return {
        "general": board.where(F.col("rank").isNotNull()),
        "handwriting": by_domain.where("primary_stratum = 'persian_handwriting'").select("model_id", F.round("canonical_cer", 6).alias("canonical_cer")),
        "digits": types.select("model_id", "type", "spans", "spans_exact"),
        "support": board.select("model_id", "track", "status"),
        "domains": by_domain.select("model_id", "primary_stratum", *[F.round(c, 6).alias(c) for c in nine]),
        "robustness": kept.select("model_id", "corruption", "severity", F.round("r", 6).alias("kept")),
        "efficiency": board.select("model_id", "latency_mean", "latency_p95", "peak_vram_mb", "api_cost"),
        "failures": failures.select("model_id", *[F.round(c, 6).alias(c) for c in failures.columns[1:]]),
        "reproducibility": reproducibility(spark, sf_dir).withColumn("canonical_version", F.lit(text.VERSION)),
    }
