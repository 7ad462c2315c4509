"""From aligned lines to sums: one Arrow pass makes all counts of a line, and everything after it is sums of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from quire.functions import align, text

COUNTS = ["cs", "cd", "ci", "cn", "ss", "sd", "si", "sn", "ws", "wd", "wi", "wn", "space_tp", "space_fp", "space_fn", "zwnj_tp", "zwnj_fp", "zwnj_fn", "zwnj_as_space", "zwnj_gone", "spans", "spans_exact", "spans_extra", "longest_omission"]
_NUMBER = None


def _found(canonical: str) -> list[tuple[int, int, str]]:
    import regex

    global _NUMBER
    _NUMBER = _NUMBER or regex.compile(text.NUMBER)
    return [(m.start(), m.end(), _value(m.group())) for m in _NUMBER.finditer(canonical)]


def _value(raw: str) -> str:
    """A detected number's value, without thousands separators."""
    return raw.replace("٬", "").replace("٪", "%").replace("٫", ".")


def _tokens(canonical: str) -> list[str]:
    import regex

    return regex.findall(text.NUMBER + "|[\\p{L}\\p{M}\\p{N}\u200c]+|[^\\s]", canonical)


def _places(reference: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans with offsets in the canonical text, by the length of what stands before."""
    if text.keeps_places(reference):
        return [(min(s, n), min(e, n), v) for n in [len(reference)] for s, e, v in spans]
    return [(len(text.canonical_text(reference[:s])), len(text.canonical_text(reference[:e])), v) for s, e, v in spans]


@F.pandas_udf(ArrayType(BooleanType()))
def _hits(reference: pd.Series, prediction: pd.Series, starts: pd.Series, ends: pd.Series, values: pd.Series) -> pd.Series:
    def of(r: str, p: str, *spans) -> list[bool]:
        b = text.canonical_text(p.replace("\r\n", "\n").removesuffix("\n"))
        moves = align.path(text.canonical_text(r.replace("\r\n", "\n")), b)
        return align.numeric(moves, _places(r, list(zip(*spans, strict=True))), _found(b))[0]

    lists = [[x.tolist() for x in c] for c in (starts, ends, values)]
    return pd.Series([of(*row) for row in zip(reference, prediction, *lists, strict=True)])


def span_hits(grid: DataFrame) -> DataFrame:
    """grid (reference_raw, prediction, numeric_spans and more) with the span_hits of line_statistics alone: one path a line, no other counts, and no shuffle. For lines that hardly repeat."""
    spans = F.coalesce("numeric_spans", F.array().cast(grid.schema["numeric_spans"].dataType))
    return grid.withColumn("span_hits", _hits("reference_raw", "prediction", spans["start"], spans["end"], spans["canonical_value"]))


def line_counts(reference: str, prediction: str, spans: list) -> list:
    """COUNTS, the chrF counts and the exact spans of one pair. The canonical texts are aligned once: the edit counts, the longest omission and the places of numbers all come from that path."""
    strict_a, strict_b = reference.replace("\r\n", "\n"), prediction.replace("\r\n", "\n").removesuffix("\n")
    a, b = text.canonical_text(strict_a), text.canonical_text(strict_b)
    moves = align.path(a, b)
    c = align.move_counts(moves)
    s = c if (a, b) == (strict_a, strict_b) else align.counts(strict_a, strict_b)
    words_a, words_b = _tokens(a), _tokens(b)
    w = align.counts(words_a, words_b)
    own = _places(reference, [(x["start"], x["end"], x["canonical_value"]) for x in spans])
    hits, extra = align.numeric(moves, own, _found(b))
    return [*c, len(a), *s, len(strict_a), *w, len(words_a), *align.spacing(a, b), len(own), sum(hits), extra, align.longest_omission(moves), align.chrf(a, b), hits]


def line_statistics(grid: DataFrame) -> DataFrame:
    """grid (reference_raw, prediction, numeric_spans and more) with COUNTS, chrf, span_hits, exact and strict_exact. Equal pairs are aligned once: outputs repeat a lot."""
    sizes = [F.lpad(F.char_length(c).cast("string"), 10, "0") for c in ("reference_raw", "prediction")]
    key = F.sha2(F.concat(*sizes, "reference_raw", "prediction", F.coalesce(F.to_json("numeric_spans"), F.lit(""))), 256)
    keyed = grid.withColumn("pair", key)
    once = keyed.groupBy("pair").agg(F.first("reference_raw").alias("r"), F.first("prediction").alias("p"), F.first("numeric_spans").alias("spans"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [line_counts(r, p, list(s) if s is not None else []) for r, p, s in zip(batch["r"], batch["p"], batch["spans"], strict=True)]
            out = pd.DataFrame(rows, columns=[*COUNTS, "chrf", "span_hits"])
            out.insert(0, "pair", batch["pair"].to_numpy())
            yield out

    # pairs are few bytes and much work: as many tasks as the shuffle has partitions, however small they are
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = once.repartition(tasks, "pair").mapInPandas(count, "pair string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", chrf array<bigint>, span_hits array<boolean>")
    joined = keyed.join(made, "pair").drop("pair")
    plain = text.strict(F.col("prediction"), True)
    return joined.withColumn("strict_exact", (text.strict(F.col("reference_raw")) == plain).cast("bigint")).withColumn("exact", ((F.col("cs") + F.col("cd") + F.col("ci")) == 0).cast("bigint"))


SUMS = [c for c in COUNTS if c != "longest_omission"] + ["exact", "strict_exact"]
N_CHRF = 3 * (align.CHARS + align.WORDS)


def summed(lines: DataFrame, *keys: str) -> DataFrame:
    """Sums of the text lines of each group, and the blank lines and their empty outputs. Any metric is an expression of these, so groups can be summed further."""
    text_line = ~F.col("is_blank")
    sums = [F.coalesce(F.sum(F.when(text_line, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in SUMS]
    grams = [F.coalesce(F.sum(F.when(text_line, F.col("chrf")[i])), F.lit(0)).cast("bigint").alias(f"g{i}") for i in range(N_CHRF)]
    blank = [F.count_if(F.col("is_blank")).alias("blanks"), F.count_if(F.col("is_blank") & (F.col("prediction") == "")).alias("blanks_empty"), F.count_if(text_line).alias("lines")]
    return lines.groupBy(*keys).agg(*sums, *grams, *blank)
