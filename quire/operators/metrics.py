"""The metrics, as expressions of sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import align
from quire.operators.quantiles import quantiles
from quire.sources.schemas import BALANCED, METRIC_WEIGHTS, STRATUM_WEIGHTS

EPSILON = 1e-9


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where there is nothing to measure."""
    return F.when(b > 0, a / b)


def _score(rate: Column) -> Column:
    return F.when(rate.isNotNull(), 100 * F.greatest(F.lit(0.0), 1 - rate))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def error_rate(prefix: str) -> Column:
    s, d, i, n = (F.col(prefix + x) for x in "sdin")
    return _ratio(s + d + i, n)


def chrfpp(beta: float = 2.0) -> Column:
    """Average precision and recall over the orders that both sides have, then F."""
    p, r, k = F.lit(0.0), F.lit(0.0), F.lit(0)
    for o in range(align.CHARS + align.WORDS):
        hyp, ref, match = (F.col(f"g{3 * o + x}") for x in range(3))
        both = (hyp > 0) & (ref > 0)
        p, r, k = p + F.when(both, match / hyp).otherwise(0.0), r + F.when(both, match / ref).otherwise(0.0), k + both.cast("int")
    p, r = _ratio(p, k), _ratio(r, k)
    factor = beta * beta
    f = F.when(p + r > 0, (1 + factor) * p * r / (factor * p + r)).otherwise(0.0)
    return F.when(F.col("lines") > 0, F.coalesce(100 * f, F.lit(0.0)))


def spacing() -> Column:
    """The mean F1 of spaces and ZWNJ; one that neither side has isn't applicable."""
    space, zwnj = (_f1(*(F.col(f"{x}_{y}") for y in ("tp", "fp", "fn"))) for x in ("space", "zwnj"))
    return 100 * F.coalesce((space + zwnj) / 2, space, zwnj)


def hallucination() -> Column:
    """Text lines by insertions; blank lines by empty outputs; together by their numbers of lines."""
    own, blank = _score(_ratio(F.col("ci"), F.col("cn"))), 100 * _ratio(F.col("blanks_empty"), F.col("blanks"))
    n = F.when(own.isNotNull(), F.col("lines")).otherwise(0) + F.col("blanks")
    return _ratio(F.coalesce(own, F.lit(0.0)) * F.when(own.isNotNull(), F.col("lines")).otherwise(0) + F.coalesce(blank, F.lit(0.0)) * F.col("blanks"), n)


def scored(sums: DataFrame) -> DataFrame:
    """The nine metrics that sums of lines give; the tenth, robustness, is made from degraded pairs."""
    return sums.withColumns(
        {
            "canonical_cer": _score(error_rate("c")),
            "strict_cer": _score(error_rate("s")),
            "canonical_wer": _score(error_rate("w")),
            "chrfpp": chrfpp(),
            "exact_line": 100 * _ratio(F.col("exact"), F.col("lines")),
            "spacing_f1": spacing(),
            "numeric_span": 100 * _ratio(F.col("spans_exact"), F.col("spans") + F.col("spans_extra")),
            "omission": _score(_ratio(F.col("cd"), F.col("cn"))),
            "hallucination": hallucination(),
        }
    )


def balanced(by_stratum: DataFrame, overall: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of BALANCED averaged over strata by weight (weights of strata with no lines are shared out), the others from the overall sums. Blank lines are a stratum of no weight: their part of hallucination joins by its share of lines."""
    weight = F.create_map(*[F.lit(x) for kv in STRATUM_WEIGHTS.items() for x in kv])
    rows = scored(by_stratum).withColumn("weight", F.try_element_at(weight, F.col("primary_stratum")))
    means = [_ratio(F.sum(F.col(m) * F.col("weight")), F.sum(F.when(F.col(m).isNotNull(), F.col("weight")))).alias(f"b_{m}") for m in BALANCED]
    mean = rows.where("weight is not null").groupBy(*keys).agg(*means)
    whole = scored(overall)
    joined = whole.join(mean, keys, "left")
    blank = 100 * _ratio(F.col("blanks_empty"), F.col("blanks"))
    halls = _ratio(F.coalesce(F.col("b_hallucination"), F.lit(0.0)) * F.col("lines") + F.coalesce(blank, F.lit(0.0)) * F.col("blanks"), F.col("lines") + F.col("blanks"))
    out = joined.withColumns({m: F.col(f"b_{m}") for m in BALANCED if m != "hallucination"} | {"hallucination": halls})
    return out.drop(*[f"b_{m}" for m in BALANCED])


def robustness(clean: DataFrame, degraded: DataFrame, *keys: str) -> DataFrame:
    """keys (model_id), robustness, conditions, from sums of clean parents (keys, cell sums) and of degraded ones (keys, corruption, severity, cell sums): 100 sqrt(mean r · least r), r the accuracy kept in a cell, at most 1."""
    keys = keys or ("model_id",)
    return retention(clean, degraded, *keys).groupBy(*keys).agg((100 * F.sqrt(F.avg("r") * F.min("r"))).alias("robustness"), F.count(F.lit(1)).alias("conditions"))


def retention(clean: DataFrame, degraded: DataFrame, *keys: str) -> DataFrame:
    """keys, corruption, severity, r: the share of the clean accuracy that each cell keeps."""
    accuracy = lambda: F.greatest(F.lit(0.0), 1 - F.coalesce(error_rate("c"), F.lit(1.0)))
    a0 = clean.select(*keys, accuracy().alias("a0"))
    cells = degraded.select(*keys, "corruption", "severity", accuracy().alias("ac")).join(a0, list(keys))
    return cells.select(*keys, "corruption", "severity", F.least(F.lit(1.0), F.col("ac") / F.greatest(F.col("a0"), F.lit(EPSILON))).alias("r"))


def composite(scores: DataFrame) -> DataFrame:
    """The weighted sum of the ten metrics. A metric that doesn't apply is null and its weight is shared out; a column that isn't there is an error."""
    total = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in METRIC_WEIGHTS.items()), F.lit(0.0))
    weights = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(0.0) for m, w in METRIC_WEIGHTS.items()), F.lit(0.0))
    return scores.withColumn("persian_ocr_score", _ratio(total, weights))


def spacing_rates(sums: DataFrame) -> DataFrame:
    """Precision and recall of spaces and ZWNJ."""
    rates = {}
    for x in ("space", "zwnj"):
        tp, fp, fn = (F.col(f"{x}_{y}") for y in ("tp", "fp", "fn"))
        rates |= {f"{x}_precision": 100 * _ratio(tp, tp + fp), f"{x}_recall": 100 * _ratio(tp, tp + fn)}
    return sums.withColumns(rates)


def by_span_type(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, type, spans, spans_exact: the numeric spans of text lines by their type."""
    own = lines.where(~F.col("is_blank")).select(*keys, F.explode(F.arrays_zip(F.col("numeric_spans.type").alias("type"), F.col("span_hits").alias("hit"))).alias("s"))
    return own.groupBy(*keys, F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("spans"), F.count_if("s.hit").alias("spans_exact"))


def diagnostics(lines: DataFrame, *keys: str) -> DataFrame:
    """Per-line distributions and rates that carry no weight. lines are read several times: keep them where they cost much."""
    text_line = ~F.col("is_blank")
    rate = F.when(text_line & (F.col("cn") > 0), (F.col("cs") + F.col("cd") + F.col("ci")) / F.col("cn"))
    inserted = F.when(text_line & (F.col("cn") > 0), F.col("ci") / F.col("cn"))
    lost = F.when(text_line & (F.col("cn") > 0), F.col("cd") / F.col("cn"))
    ranked = quantiles(lines, list(keys), {"cer_median": (rate, 0.5), "cer_p95": (rate, 0.95), "insertion_p95": (inserted, 0.95)})
    rates = lines.groupBy(*keys).agg(
        F.avg(rate).alias("cer_mean"), F.avg((inserted > 1.0).cast("double")).alias("catastrophic_insertions"),
        F.avg((lost == 1.0).cast("double")).alias("omitted_lines"), F.avg((lost > 0.25).cast("double")).alias("lines_losing_a_quarter"),
        F.max(F.when(text_line, F.col("longest_omission"))).alias("longest_omission"),
        (F.sum(F.when(text_line, F.col("wd"))) / F.sum(F.when(text_line, F.col("wn")))).alias("word_deletions"),
        (F.sum(F.when(text_line, F.col("cn") + F.col("ci") - F.col("cd"))) / F.sum(F.when(text_line, F.col("cn")))).alias("length_ratio"),
        F.avg(F.when(F.col("is_blank"), (F.col("prediction") != "").cast("double"))).alias("blank_hallucinations"),
        F.sum(F.when(text_line, F.col("zwnj_as_space"))).alias("zwnj_as_space"), F.sum(F.when(text_line, F.col("zwnj_gone"))).alias("zwnj_gone"),
        F.avg(F.when(text_line, F.col("strict_exact"))).alias("strict_exact_rate"),
    )
    return rates.join(ranked, list(keys))


def repetition(text: Column, n: int = 3) -> Column:
    """1 - distinct share of the text's character n-grams; null where it has none."""
    grams = F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return 1 - F.size(F.array_distinct(grams)) / F.size(grams)


def repeated_lines(text: Column) -> Column:
    lines = F.split(text, "\n")
    return 1 - F.size(F.array_distinct(lines)) / F.size(lines)


def failures(grid: DataFrame, *keys: str) -> DataFrame:
    """Rates of outcomes; a missing prediction is a failure of its own."""
    rate = lambda c: F.count_if(c) / F.count(F.lit(1))
    status = F.col("status")
    return grid.groupBy(*keys).agg(
        rate(status == "success").alias("completion"), rate(F.coalesce(status != "success", F.lit(True))).alias("failure_rate"), rate(status == "timeout").alias("timeouts"),
        rate(status == "crash").alias("crashes"), rate(status == "truncated").alias("truncations"), rate(status.isNull()).alias("missing"),
    )


def efficiency(predictions: DataFrame, *keys: str) -> DataFrame:
    """Latency, memory and cost, with the exact 95th percentile."""
    means = predictions.groupBy(*keys).agg(F.avg("runtime_ms").alias("latency_mean"), F.max("peak_vram_mb").alias("peak_vram_mb"), F.sum("api_cost").alias("api_cost"))
    return means.join(quantiles(predictions, list(keys), {"latency_p95": (F.col("runtime_ms"), 0.95)}), list(keys))


def repeat_runs(scores: DataFrame, value: str) -> DataFrame:
    """Mean, deviation and worst of a model's runs."""
    return scores.groupBy("model_id").agg(F.avg(value).alias("run_mean"), F.stddev_samp(value).alias("run_stddev"), F.min(value).alias("run_worst"), F.count(F.lit(1)).alias("runs"))
