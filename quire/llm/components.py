"""Connected components of a graph by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, tidied, written


TWICE = 2  # large and small stars between two looks at whether all are stars


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node with an edge (a, b: long).

    Each round links every node's larger neighbours to the least node around it (large star), then its
    smaller ones (small star). A hub's edges are grouped by minimum before the join, and the join's rows are
    a row an edge, so a component that holds a third of all nodes is no group in one task. Every star is a table of its own: it reads
    its pairs several times, so that in one plan each star would multiply those before it. It ends when all that is left are stars
    round their least nodes, which one aggregation tells, after about log² rounds of the largest component's size. Null ends link nothing, repeated and
    loop edges count once or not at all, and no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    while not _settled(pairs):
        for large in (True, False) * TWICE:
            last, pairs = pairs, written(_star(pairs, large), "stars")
            removed(last)
        tidied(edges.sparkSession)
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _settled(pairs: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or smaller and larger ones: then each pair is a component's least node and another."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(0).alias("below")).unionByName(pairs.select(F.col("b").alias("node"), F.lit(1).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("least"))
    return nodes.where("n > 1 OR n > 0 AND least = 0").agg(F.count(F.lit(1))).first()[0] == 0


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """large: link each node's larger neighbours to the least of it and its neighbours; else the node and its smaller neighbours to the least of these. Pairs are (smaller, larger)."""
    around = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = around.where("v > u") if large else around.unionByName(around.select("u", F.col("u").alias("v")).distinct())
    joined = moved.join(least, "u").where("v <> m")
    return joined.select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()
