"""Connected components of a graph given as a DataFrame of links, found by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether each greater end ``u`` has one edge and is nobody's lesser end ``v``: then every ``v`` is its component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all")).filter("up > 1 or (up = 1 and all > 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` but the smallest of each component.

    Every round is written to the shared folder, so lineage stays short.  A node
    with very many links is spread by adaptive execution like any skewed join.
    Links that are stars already, as those of a result of before are, take no round.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "links")
    while not _are_stars(edges):
        moved = written(_small_star(_large_star(edges)), "links")
        removed(edges)
        edges = moved
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
