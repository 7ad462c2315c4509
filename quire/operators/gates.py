"""The smoke gate, ranks and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators.metrics import error_rate

# The gate's thresholds.
LEAST_SUCCESS, LEAST_NONEMPTY, LEAST_CER_SCORE, MOST_CATASTROPHIC, LEAST_COMPLETION = 18, 15, 10.0, 2, 0.99
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}]"


def persian_share(prediction: Column) -> Column:
    """The share of letters that are in the Arabic blocks; null without letters."""
    letters = F.size(F.regexp_extract_all(prediction, F.lit(r"\p{L}"), F.lit(0)))
    return F.when(letters > 0, F.size(F.regexp_extract_all(prediction, F.lit(ARABIC + r"(?<=\p{L})"), F.lit(0))) / letters)


def catastrophic(reference: Column, prediction: Column) -> Column:
    """Over four times as long as the reference, or a run of up to ten characters repeated five times where the reference has no such run."""
    longer = (F.char_length(reference) > 0) & (F.char_length(prediction) > 4 * F.char_length(reference))
    return longer | (text.repeated_runs(prediction) & ~text.repeated_runs(reference))


def smoke_gate(lines: DataFrame, least_success: int = LEAST_SUCCESS, least_nonempty: int = LEAST_NONEMPTY) -> DataFrame:
    """model_id, the five criteria and the number that fail. lines: line statistics with status."""
    text_line = ~F.col("is_blank")
    rows = lines.withColumn("bad", catastrophic(F.col("reference_raw"), F.col("prediction"))).withColumn("share", persian_share(F.col("prediction")))
    sums = [F.coalesce(F.sum(F.when(text_line, F.col(c))), F.lit(0)).alias(c) for c in ("cs", "cd", "ci", "cn")]
    out = rows.groupBy("model_id").agg(
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(text_line & (F.col("prediction") != "")).alias("n_nonempty"),
        F.count_if("bad").alias("n_catastrophic"),
        F.avg(F.when(text_line, F.col("share"))).alias("persian"),
        *sums,
    )
    out = out.withColumn("cer_score", 100 * F.greatest(F.lit(0.0), 1 - F.coalesce(error_rate("c"), F.lit(1.0))))
    checks = [F.col("n_success") >= least_success, F.col("n_nonempty") >= least_nonempty, F.col("cer_score") >= LEAST_CER_SCORE, F.coalesce(F.col("persian") >= 0.5, F.lit(False)), F.col("n_catastrophic") <= MOST_CATASTROPHIC]
    failed = sum((F.when(c, 0).otherwise(1) for c in checks), F.lit(0))
    return out.select("model_id", "n_success", "n_nonempty", "cer_score", "persian", "n_catastrophic", failed.alias("n_failed"))


def statuses(gate: DataFrame, registry: DataFrame) -> DataFrame:
    """model_id, status: the registry's verdict first, then all criteria met, all but one, or fewer."""
    known = registry.select(F.col("id").alias("model_id"), "track")
    status = (
        F.when(F.col("track") == "not_ocr", "NOT_APPLICABLE").when(F.col("track") == "unavailable", "UNAVAILABLE").when(F.col("n_failed") == 0, "QUALIFIED").when(F.col("n_failed") == 1, "BORDERLINE").otherwise("FAILED_PERSIAN_SUPPORT")
    )
    return known.join(gate, "model_id", "left").select("model_id", "track", status.alias("status"))


def rankable(status: Column, completion: Column, reproducible: Column, track: Column, raw_share: Column) -> Column:
    """The gate passed, nearly all inputs completed, one reproducible configuration, any text as output, and raw predictions kept for audit."""
    return (status == "QUALIFIED") & (completion >= LEAST_COMPLETION) & reproducible & track.isin("general_line_recognition", "pipeline") & (raw_share == 1)


def ranked(board: DataFrame, eligible: Column) -> DataFrame:
    """Ranks by score for the eligible rows, equal scores sharing one; the others keep their row without a rank. A row a model: some hundreds at most."""
    place = F.rank().over(Window.partitionBy("quire_ok").orderBy(F.desc("persian_ocr_score")))
    return board.withColumn("quire_ok", F.coalesce(eligible, F.lit(False))).withColumn("rank", F.when(F.col("quire_ok"), place)).drop("quire_ok")


def tiers(board: DataFrame, differences: DataFrame) -> DataFrame:
    """statistical_tier: going down by score, a new tier opens where the interval of the difference from the tier's leader leaves zero out.

    board: model_id, persian_ocr_score. differences: model_a, model_b, ci_low, ci_high of every two models with model_a < model_b. The rule isn't
    transitive, so the models are walked through in one array; there is one a system.
    """
    apart = differences.where("ci_low > 0 or ci_high < 0").select(F.concat_ws("\t", "model_a", "model_b").alias("pair"))
    walk = board.agg(F.sort_array(F.collect_list(F.struct((-F.col("persian_ocr_score")).alias("by"), "model_id"))).alias("models")).crossJoin(apart.agg(F.collect_set("pair").alias("apart")))  # both sides are one row
    start = F.struct(F.lit("").alias("leader"), F.lit(0).alias("tier"), F.array().cast("array<struct<model_id:string,tier:int>>").alias("done"))

    def step(acc: Column, m: Column) -> Column:
        pair = F.concat_ws("\t", F.least(acc["leader"], m["model_id"]), F.greatest(acc["leader"], m["model_id"]))
        opens = (acc["tier"] == 0) | F.array_contains(F.col("apart"), pair)
        tier = acc["tier"] + opens.cast("int")
        own = F.struct(m["model_id"].alias("model_id"), tier.alias("tier"))
        return F.struct(F.when(opens, m["model_id"]).otherwise(acc["leader"]).alias("leader"), tier.alias("tier"), F.concat(acc["done"], F.array(own)).alias("done"))

    done = walk.select(F.explode(F.aggregate("models", start, step)["done"]).alias("d"))
    return board.join(done.select("d.model_id", F.col("d.tier").alias("statistical_tier")), "model_id")


# Openings of answers that explain instead of transcribing.
EXPLANATIONS = ("here is", "the text", "sure", "this image", "transcription:")


def adapter_screens(prediction: Column, prompt: Column, n_tokens: Column | None = None, limit: Column | int | None = None, reference: Column | None = None, neighbour: Column | None = None, size: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Diagnostics of an adapter's defects on the development lines. They clean nothing.

    n_tokens and limit: generated tokens and their bound; neighbour: the reference of the batch's next line, which a batch in the
    wrong order answers with; size: (width given to the model, width of the image).
    """
    start = F.lower(F.substring(F.ltrim(prediction), 1, 24))
    out = {
        "markdown_wrapper": prediction.startswith("```"),
        "prompt_echo": F.contains(prediction, prompt),
        "task_token": prediction.rlike(r"<\|?/?[A-Za-z_]+\|?>"),
        "explanation": _any([start.startswith(x) for x in EXPLANATIONS]),
        "replacement_character": F.contains(prediction, F.lit("\ufffd")),
    }
    if n_tokens is not None:
        out["truncated"] = n_tokens >= limit
    if neighbour is not None:
        out["batch_order"] = F.coalesce((prediction == neighbour) & (prediction != reference) & (prediction != ""), F.lit(False))
    if size is not None:
        out["resized"] = size[0] != size[1]
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
