"""Connected components by alternating star contraction over edge tables.

Each round replaces every edge by edges to the smallest neighbour, first on the
side of the larger ends and then on that of the smaller ends, until all edges
point at the smallest node of their component: no node then has two edges upward, or
edges both ways. The number of rounds grows with the logarithm of the number of nodes.

A node with more than 64 edges, and more than a hundred-thousandth of all, is a
hub; so there are at most 200,000 hubs, whatever the size. Their smallest
neighbours are broadcast, so a hub's edges stay where they lie; all other nodes
meet theirs by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

HUB, HUBS = 64, 100_000


def _with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``rows`` (a, b) with m of ``least`` (a, m, n), where n is the number of rows of a."""
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("a", "m"))
    others = least.filter(F.col("n") <= hub).select("a", "m").hint("merge")
    return rows.join(hubs, "a").select("a", "b", "m").union(rows.join(hubs, "a", "left_anti").join(others, "a").select("a", "b", "m"))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, hub).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Edges here run from the larger end a to the smaller end b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, hub)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (a, b); root is the smallest node of the component."""
    edges = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        total, most, both = per.agg(F.sum("up"), F.max("up"), F.max(F.least("up", "down"))).first()
        if not total or (most == 1 and both == 0):
            break
        hub = max(HUB, total // HUBS)
        starred = scratch.keep(_large_star(edges, hub).distinct())
        after = scratch.keep(_small_star(starred, hub).distinct())
        scratch.drop(edges, starred)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
