"""Document fingerprints: the k least hashes of a text's word shingles.

The sketch of a union is made from the sketches of its parts (`merged`), so a text, a group of texts or a
partition can be sketched in parts. Two sketches estimate resemblance (the share of the union's k least
hashes that both have), the share of one set inside the other, and a sketch alone its number of distinct
shingles. A sketch with fewer than k hashes is the whole set, and its estimates are exact.

Cases: a null text is empty and its sketch is empty; a text of fewer words than a shingle is one shingle;
two empty sketches resemble each other fully, an empty and another one not at all; repeated rows get equal
fingerprints. All of it is built-in expressions.

`dealt_by_order` orders documents without bringing them together: ids are cut into ranges at sampled quantiles, and
the first document of each range is also sent to the range before, where it is the last one's next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import GAP, lower_ascii, text_bytes, texts

K = 128
SHINGLE = 5
RANGE_BYTES = 8 << 20  # of text in a range of ids, about
RANGES = 2048  # at most; beyond that ranges grow


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The hash of each run of n words, from the words' hashes."""
    words = F.transform(F.filter(F.split(lower_ascii(text), GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.when(F.size(h) < n, F.array(F.aggregate(h, F.lit(n).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(
        F.transform(F.arrays_zip(*[F.slice(h, i + 1, F.greatest(F.size(h) - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)]), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(n)]))
    )
    # the hashes are bound once, as the only element of an array
    return F.when(F.length(F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.array(words), runs)[0])


def sketch(hashes: Column, k: int = K) -> Column:
    """The k least distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(merged(a, b, k)), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that the k least take."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the counts."""
    union = distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def union_sketch(frame: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """by..., column: the sketch of each group's union. Hashes are made distinct before the shuffle and ranked with the group's rows dealt by hash, so no group is gathered in a list before it is cut to k."""
    parts = frame.select(*by, F.explode(column).alias("h")).groupBy(*by, "h").agg(F.lit(1).alias("one"))
    salted = parts.withColumn("salt", F.pmod(F.hash("h"), F.lit(64)))
    for key in (["salt"], []):
        rank = F.row_number().over(Window.partitionBy(*by, *key).orderBy("h"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return salted.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def as_text(a: Column) -> Column:
    """The hashes as 16 hexadecimal digits each: the sketch itself, from which resemblance can be had again."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _range(docs: DataFrame) -> Column:
    """The range of an id, from a bounded number of quantiles."""
    n = max(1, min(RANGES, text_bytes(docs) // RANGE_BYTES + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("cuts")).first()["cuts"] or []
    cuts = sorted({int(c) for c in cuts})
    places = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return F.coalesce(F.size(F.filter(places, lambda c: c < F.col("doc_id"))), F.lit(0))


def dealt_by_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, at (the range), guest: within a range, by guest, descending id and text, the row after a document is the next one by descending id (after the last of all: the first). Equal ids are ordered by text, null ids come last."""
    base = texts(docs)
    own = _range(base)
    tops = base.select("doc_id", own.alias("own")).groupBy("own").agg(F.max("doc_id").alias("top")).orderBy("own").collect()  # a row a range
    above = {t["own"]: tops[(i + 1) % len(tops)]["own"] for i, t in enumerate(tops)}
    guests = [(t["top"], above[t["own"]]) for t in tops]
    sent = F.lit(None).cast("int")
    if known := [F.lit(x) for top, to in guests if top is not None for x in (top, to)]:
        sent = F.when(F.col("doc_id").isNotNull(), F.try_element_at(F.create_map(*known), F.coalesce("doc_id", F.lit(0))))
    for to in (to for top, to in guests if top is None):
        sent = F.when(F.col("doc_id").isNull(), to).otherwise(sent)
    dealt = base.withColumn("own", own).withColumn("sent", sent.cast("int"))
    home, away = F.struct(F.col("own").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("sent").alias("at"), F.lit(1).alias("guest"))
    dealt = dealt.select("doc_id", "text", F.explode(F.when(F.col("sent").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("to"))
    return dealt.select("doc_id", "text", "to.at", "to.guest")


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    dealt = dealt_by_order(docs)
    order = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    # the sketch is made between two windows of one order: it isn't shuffled, and one exchange serves both
    rows = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("sketch", sketch(shingles(F.col("text")), k)).withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(shingles(F.col("edited")), k))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        F.round(distinct_count(F.col("sketch"), k)).cast("long").alias("n_shingles"),
        F.round(containment(F.col("edited_sketch"), F.col("sketch"), k), 6).alias("edited_in_text"),
    )
