"""Connected components of a large graph: alternating star contractions (Kiveris et al., 2014) with a settled table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import settle


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction of edges (a, b) with a > b: large stars link all larger neighbours of a node, small stars all others,
    to the smallest neighbour. Both only aggregate by node and join, so a node with very many links is no single group."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("m", "a").alias("m"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b): root is the smallest node reachable. No edges give no rows.

    Ends when a pair of contractions changes nothing; the rounds grow with the logarithm of the longest chain.
    """
    now = settle(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.xxhash64("b", "a") % (1 << 30))).first())
    seen = mark(now)
    while True:
        now = settle(_stars(_stars(now, small=False), small=True))
        found = mark(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
