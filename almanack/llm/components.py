"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Each node's neighbours above it (large) or not above it (small) move to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u itself keeps its place below m
        out = out.union(least.filter("m < u").select("u", F.col("m").alias("v")))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link to another.

    Each round is written to the shared folder, so a lost executor costs one round at most. Rounds grow with the
    logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while True:
        nxt = written(_star(_star(edges, True), False), "links")
        # settled when every node has one edge, and that leads to a root
        by_node = nxt.groupBy(F.col("u").alias("v")).agg((F.min("v") != F.max("v")).alias("several"))
        open_edges = by_node.filter("several").select("v").union(nxt.select("v").join(by_node, "v", "left_semi"))
        if not open_edges.limit(1).count():
            return nxt.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = nxt
