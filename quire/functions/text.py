"""Text forms and scalar functions. Everything is built-in expressions but NFC and the folding of presentation forms, which Spark has no function for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "canonical_v1.0.0"
ZWNJ = "‌"
PERSIAN_DIGITS, ARABIC_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
BIDI = "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"
SPACES = "\t               　"
TATWEEL = "ـ"
#: What words are made of; a number with separators is one token.
NUMBER = r"[0-9]+(?:[./:,٫٬\-][0-9]+)*[%٪]?"
TOKEN = NUMBER + r"|[\p{L}\p{M}\p{N}\x{200C}]+|[^\s]"


@lru_cache(maxsize=1)
def presentation_forms() -> dict[int, str]:
    """Arabic presentation forms to their letters, by the compatibility decomposition of each character on its own."""
    spans = (range(0xFB50, 0xFE00), range(0xFE70, 0xFEFD))
    return {c: n for span in spans for c in span if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


#: Blocks that most text is written in: Latin, Greek, Cyrillic, Arabic, general punctuation.
COMMON_BLOCKS = ((0x0000, 0x02FF), (0x0370, 0x04FF), (0x0600, 0x06FF), (0x2000, 0x206F))


@lru_cache(maxsize=1)
def inert() -> str:
    """A character class of what composing leaves alone in any text: characters of the common blocks that are their own composed form, follow no letter as a mark, and end no composed letter."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    ends = {int(p[1], 16) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    fine = [c for lo, hi in COMMON_BLOCKS for c in range(lo, hi + 1) if unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in ends and c not in presentation_forms()]
    runs: list[list[int]] = []
    for c in fine:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in runs)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    table = presentation_forms()
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).translate(table))


def composed(text: Column | str) -> Column:
    """NFC, then presentation forms folded; null stays null. A text of inert characters, which an expression tells, is its own composed form and isn't sent to Python."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_composed(F.when(text.rlike(f"[^{inert()}]"), text)), text)


def strict(text: Column, inserted_newline: bool = False) -> Column:
    """CRLF as LF; for predictions, one newline at the end that the runner has put there goes."""
    out = F.regexp_replace(text, "\r\n", "\n")
    return F.regexp_replace(out, r"\n\z", "") if inserted_newline else out


def canonical_tail(text: Column) -> Column:
    """Steps 3 to 10 of the canonical form, on composed text: letters, heh with hamza, tatweel, bidi controls, spaces, digits. ZWNJ, repeated spaces and punctuation stay."""
    letters = F.translate(text, "يىك", "ییک")
    heh = F.replace(letters, F.lit("ۀ"), F.lit("هٔ"))
    bare = F.translate(heh, TATWEEL + BIDI, "")
    spaced = F.translate(bare, SPACES, " " * len(SPACES))
    return F.translate(spaced, PERSIAN_DIGITS + ARABIC_DIGITS, DIGITS * 2)


def canonical(text: Column) -> Column:
    return canonical_tail(composed(text))


_LETTERS = str.maketrans("يىك", "ییک")
_PLAIN = {ord(c): None for c in TATWEEL + BIDI} | {ord(c): " " for c in SPACES} | {ord(c): d for c, d in zip(PERSIAN_DIGITS + ARABIC_DIGITS, DIGITS * 2, strict=True)}


def canonical_text(x: str) -> str:
    """The same of one Python string, for use inside Arrow functions."""
    if not unicodedata.is_normalized("NFC", x):
        x = unicodedata.normalize("NFC", x)
    if not _changing().isdisjoint(x):
        x = x.translate(presentation_forms())
    return x.translate(_LETTERS).replace("ۀ", "هٔ").translate(_PLAIN)


@lru_cache(maxsize=1)
def _changing() -> frozenset[str]:
    return frozenset(chr(c) for c in presentation_forms())


def keeps_places(x: str) -> bool:
    """Whether every start of the text has as many characters in its canonical form: it is composed (a start of it then is, too), and what isn't exchanged one for one isn't in it."""
    return unicodedata.is_normalized("NFC", x) and _changing().isdisjoint(x) and _MOVING.isdisjoint(x)


_MOVING = frozenset(TATWEEL + BIDI + "ۀ")


def tokens(text: Column) -> Column:
    """Words of canonical text: split at white space, punctuation apart, ZWNJ within words, numbers whole."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def visible(text: Column) -> Column:
    """Invisible characters as [SP], [ZWNJ] and [TAB]."""
    for c, name in ((" ", "[SP]"), (ZWNJ, "[ZWNJ]"), ("\t", "[TAB]")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def numeric_value(raw: Column, kind: Column, keep_zeros: Column) -> Column:
    """A number's canonical value by type. Digits become Latin; thousands separators go from integers, decimals, prices, currencies and percentages; dates, times, phones and codes keep their separators and order. Leading zeros go only from the numbers that don't keep them."""
    latin = F.translate(raw, PERSIAN_DIGITS + ARABIC_DIGITS + "٪٫", DIGITS * 2 + "%.")
    counted = kind.isin("integer", "decimal", "price", "currency", "percentage", "measurement")
    plain = F.when(counted, F.regexp_replace(latin, "[٬,‌ ]", "")).otherwise(latin)
    return F.when(counted & ~F.coalesce(keep_zeros, F.lit(False)), F.regexp_replace(plain, "^0+(?=[0-9])", "")).otherwise(plain)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def config_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


def padded_id(prefix: str, n: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def repeated_runs(text: Column) -> Column:
    """Whether a run of one to ten characters follows itself four times or more."""
    return text.rlike(r"(?s)(.{1,10}?)\1{4,}")


def distance_by_pieces(a: Column, b: Column, pieces: Column, changed: Callable[[Column], Column]) -> Column:
    """levenshtein(a, b), where `pieces` put together are a and, each of them changed, b. The pieces' distances add up to no less than it, and the difference of the lengths is no more; where these two are equal they are the distance, and
    work follows the text's length and not its square (even in a band: the built-in function walks to it through the text). A piece is worked out in a band as wide as its lengths differ; where one has a greater distance, or the sum is greater than the difference, the whole is worked out."""

    def own(x: Column) -> Column:
        y = changed(x)
        near = F.call_function("levenshtein", x, y, F.abs(F.char_length(x) - F.char_length(y)))
        return F.when(x == y, 0).otherwise(F.nullif(near, F.lit(-1)))

    least = F.abs(F.char_length(a) - F.char_length(b))
    most = F.aggregate(pieces, F.lit(0), lambda n, x: n + own(x))
    return F.transform(F.array(most), lambda most: F.when(most == least, most).otherwise(F.levenshtein(a, b)))[0]


def numeric_spans(text: Column, raws: Column) -> Column:
    """Offsets of the raws (array<struct<type,raw>>) found one after another, each from where the one before ends. One that isn't there fails the job."""
    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<start:int,end:int,type:string,raw:string,preserve_leading_zero:boolean>>").alias("found"))

    def step(acc: Column, item: Column) -> Column:
        at = F.call_function("locate", item["raw"], text, acc["cursor"] + 1)
        end = at - 1 + F.char_length(item["raw"])
        zero = item["raw"].startswith("۰") | item["raw"].startswith("0")
        span = F.struct((at - 1).alias("start"), end.alias("end"), item["type"].alias("type"), item["raw"].alias("raw"), zero.alias("preserve_leading_zero"))
        missing = F.raise_error(F.concat(F.lit("no such span: "), item["raw"])).cast("int")
        return F.struct(F.when(at == 0, missing).otherwise(end).alias("cursor"), F.concat(acc["found"], F.array(span)).alias("found"))

    return F.aggregate(raws, begin, step)["found"]
