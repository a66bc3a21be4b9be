"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped


def _mins(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the least of u and u's partners; pre-aggregated before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("mu")).drop("mu")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), both non-null; root is the least node reachable.

    Each round is one checkpointed table of at most as many rows as edges, and takes the place of the one before; links of a node with very many partners
    are joined to one row (its least partner), so a hot node can be split. Rounds grow with the logarithm of the
    longest path. An empty edge table gives an empty result; loops and repeated edges are harmless.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpointed(now)
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _mins(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, now = now, checkpointed(small.select(F.col("u").alias("a"), F.col("v").alias("b")))
        dropped(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
