"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Each source's documents are laid end to end in a seeded order, within shards of bounded size, and cut into
blocks of `block` words. The blocks that the mix has are seats: they go to sources, and each source's seats
to its shards, by the highest quotients votes / (2k + 1). A shard of n blocks with q seats takes each block
q div n times and the q mod n blocks that a seeded hash puts first once more. A document's `taken` is the
number of its words in the blocks taken.

Seats needn't be dealt one by one: with any divisor d, source i gets round(votes / d) seats, so a divisor
somewhat too large gives a lower count, one somewhat too small an upper count, and only the quotients between
the two are ranked, at most about three a party. All of it is DataFrame expressions.

Cases: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its own,
the last; equal rows count each; a null doc_id is an id like any other; an empty table gives an empty
result; other columns are left out. Equal ids with unequal texts are ordered by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, fresh, texts, written

WEIGHTS = (5, 2, 1)  # fixed values: of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times that a document may be taken
BLOCK = 256  # words
SHARD = 1 << 18  # words that a shard has at least, about
SHARDS = 4096  # of a source at most; beyond that shards grow
SEED = 17


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), nameless (a hash of the text where there is no id, so that such rows are dealt too; else null)."""
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("nameless")
    return texts(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("size"), nameless)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: the shares by weight, none above `most` times its source; what a full source can't take goes to the others by weight.

    With the sources in order of cap / weight the full ones come first, and for each prefix of full ones
    the level that the others get is known; the first source that the level doesn't fill ends the prefix. Later levels are lower.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    caps = by_source.select("source", "source_size", place.alias("place"), weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    levels = caps.select(
        "*",
        ((share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def apportioned(parties: DataFrame, within: list[str], tie: list[str], votes: str, seats: Column) -> DataFrame:
    """parties with `quota`: `seats` (the same in each group of `within`) dealt by the highest votes / (2k + 1); ties by `tie`."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    base = parties.withColumn("q_seats", seats).withColumn("q_votes", total).withColumn("q_n", n)
    share = F.when(F.col("q_votes") > 0, F.col(votes) / F.col("q_votes")).otherwise(0.0)

    def rounded(seats_: Column) -> Column:
        return F.floor(share * F.greatest(seats_, F.lit(0)) + 0.5)

    low, high = rounded(F.col("q_seats") - F.col("q_n")), rounded(F.col("q_seats") + F.col("q_n"))
    base = base.withColumn("q_low", low).withColumn("q_high", high).withColumn("q_left", F.col("q_seats") - F.sum("q_low").over(group))
    asked = base.where("q_high > q_low").select(*within, *[c for c in tie if c not in within], votes, "q_left", F.explode(F.sequence("q_low", F.col("q_high") - 1)).alias("k"))
    best = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), *tie)
    won = asked.withColumn("rank", F.row_number().over(best)).where("rank <= q_left").groupBy(*within, *[c for c in tie if c not in within]).agg(F.count(F.lit(1)).alias("q_won"))
    keys = within + [c for c in tie if c not in within]
    renamed = won.select(*[F.col(c).alias(f"w_{c}") for c in keys], "q_won")
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in keys]
    joined = base.join(renamed, on=_all(same), how="left")
    return joined.select(*parties.columns, (F.col("q_low") + F.coalesce("q_won", F.lit(0))).alias("quota"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def streams(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, source_key, shard, size, source_size, target, end: every document and its last word's place in its shard's stream; source_key, shard, k, times: how often each block is drawn)."""
    sized = written(sizes(docs), "sizes")
    wanted = written(targets(sized, weights, share, most), "targets")
    # one row a source: a null source is joined by its key "n", others by "s" + name
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    by_key = wanted.withColumn("source_key", key).drop("source").withColumn("n_shards", F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.floor(F.col("source_size") / shard))))
    laid = sized.withColumn("source_key", key).join(by_key, "source_key")
    laid = laid.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "nameless"), "n_shards"))  # a null leaves the hash as it is
    stream = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "nameless"), "doc_id", "size")
    placed = laid.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    placed = written(placed.select("doc_id", "source", "source_key", "shard", "size", "source_size", "target", "end"), "placed")

    shards = placed.groupBy("source_key", "shard").agg(F.sum("size").alias("words"))
    all_seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    seats = apportioned(by_key, [], ["source_key"], "target", all_seats).select("source_key", F.greatest("quota", F.least("source_size", F.lit(1))).alias("source_quota"))  # a source with words has a seat
    quotas = apportioned(shards.join(seats, "source_key"), ["source_key"], ["shard"], "words", F.col("source_quota"))
    # a full source is taken whole, `most` times: its part-blocks would cost whole seats
    quotas = quotas.join(by_key.select("source_key", (F.col("target") >= most * F.col("source_size") - 1e-6).alias("full")), "source_key")
    blocks = quotas.where("words > 0").select("source_key", "shard", "quota", "full", F.ceil(F.col("words") / block).alias("n"))
    blocks = blocks.withColumn("quota", F.when(F.col("full"), most * F.col("n")).otherwise(F.least("quota", most * F.col("n")))).drop("full")
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    drawn = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source_key", "shard", "k"), "k")
    times = blocks.withColumn("times", F.floor(F.col("quota") / F.col("n")) + (F.row_number().over(drawn) <= F.col("quota") % F.col("n")).cast("long"))
    return placed, times.select("source_key", "shard", "k", "times")


def mixed(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    placed, times = streams(docs, block=block, **how)
    earlier = Window.partitionBy("source_key", "shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    times = times.select("source_key", "shard", "k", "times", (F.coalesce(F.sum("times").over(earlier), F.lit(0)) * block).alias("before"))

    # words taken up to place p of a shard's stream: those of the blocks before p's, and p's part of its own
    def taken(frame: DataFrame, name: str) -> DataFrame:
        frame = frame.withColumn("k", F.floor(F.greatest(F.col(name) - 1, F.lit(0)) / block))
        got = F.col("before") + F.col("times") * (F.col(name) - F.col("k") * block)
        return frame.join(times, ["source_key", "shard", "k"], "left").withColumn(f"upto_{name}", F.coalesce(got, F.lit(0))).drop("k", "times", "before")

    both = taken(taken(placed.withColumn("start", F.col("end") - F.col("size")), "start"), "end")
    count = F.when(F.col("size") > 0, F.col("upto_end") - F.col("upto_start")).otherwise(0).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", count.alias("taken"))


def _kind(doc_id: Column, source: Column, size: Column) -> Column:
    """A key of its own for each id, size and source, null ones too."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("n")), F.lit("|"), size.cast("string"), F.coalesce(F.concat(F.lit("|s"), source), F.lit("|n")))


def pieces(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """kind, row (number of the document among those of its id, source and size, from 1), size, pieces: (first word, from 0; words) of each run of words drawn. A block drawn twice is in two runs; neighbouring blocks make one run, as far as both are drawn as often."""
    placed, times = streams(docs, block=block, **how)
    full = placed.where("size > 0").withColumn("start", F.col("end") - F.col("size")).withColumn("kind", _kind(F.col("doc_id"), F.col("source"), F.col("size")))
    full = full.withColumn("row", F.row_number().over(Window.partitionBy("kind").orderBy("end")))
    own = ["kind", "row", "size", "source_key", "shard", "start", "end"]
    blocks = full.select(*own, F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("k"))
    drawn = blocks.join(times.where("times > 0"), ["source_key", "shard", "k"]).select(*own, "k", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    run = F.col("k") - F.row_number().over(Window.partitionBy("kind", "row", "time").orderBy("k"))
    runs = drawn.withColumn("run", run).groupBy("kind", "row", "size", "start", "end", "time", "run").agg(F.min("k").alias("k"), F.max("k").alias("last"))
    first, stop = F.greatest(F.col("k") * block, "start"), F.least((F.col("last") + 1) * block, "end")
    return runs.groupBy("kind", "row", "size").agg(F.sort_array(F.collect_list(F.struct((first - F.col("start")).alias("first"), (stop - first).alias("words")))).alias("pieces"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them, all columns: a row for each run of a document's words that was drawn, with those words as its text; a run of all words is the document as it is. n_chars, where there is one, follows the text."""
    kind, place, size, runs, own_kind, own_row, run, cut = fresh(docs, "kind", "place", "size", "pieces", "own", "row", "piece", "text")
    drawn = pieces(docs, **how).select(F.col("kind").alias(kind), F.col("row").alias(place), F.col("size").alias(size), F.col("pieces").alias(runs))
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    own = docs.withColumn(own_kind, _kind(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words).cast("long")))
    own = own.withColumn(own_row, F.row_number().over(Window.partitionBy(own_kind).orderBy("text")))
    # the row isn't a key of the join, so that the texts are dealt once, by kind
    same = (F.col(own_kind) == F.col(kind)) & (F.col(own_row) <= F.col(place)) & (F.col(own_row) >= F.col(place))
    parts = own.join(drawn, same).withColumn(run, F.explode(runs))
    part = F.col(run)
    whole = part["words"] == F.col(size)
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, (part["first"] + 1).cast("int"), part["words"].cast("int")), " "))
    parts = parts.withColumn(cut, text)
    chars = F.when(whole, F.col("n_chars")).otherwise(F.char_length(cut)) if "n_chars" in docs.columns else None
    return parts.select(*[F.col(cut).alias(c) if c == "text" else chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
