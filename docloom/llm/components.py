"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, hot_limit

#: Edges in a partition: a few edges in very many partitions would be nothing but files and tasks.
PARTITION_EDGES = 50_000


def _with_least(edges: DataFrame, least: DataFrame, limit: int, hubs: bool) -> DataFrame:
    """``edges(u, v)`` with m of ``least(u, m, n)``. With ``hubs``, nodes of more than ``limit`` edges are broadcast."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    known = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = least.where(F.col("n") <= limit).select("u", "m")
    return edges.join(known, "u").unionByName(edges.join(known, "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the undirected ``edges(a, b)``.

    Nodes without edges don't appear; loops, repeated edges and null ends do no harm. Each step is a minimum by node,
    which Spark aggregates before its shuffle, and a join of the edges with those minima; the minima of hubs, few by
    their definition, are broadcast, so no hub's edges meet in one task. The number of steps grows with the logarithm of
    the longest path; a graph that isn't done after ``max_rounds`` raises an error. Only sums reach the driver.
    """
    now = cut(edges.where(f"{a} <> {b}").select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).distinct())
    state = parts = None
    for _ in range(max_rounds):
        now = now.coalesce(parts) if parts else now
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        of_node = [F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        least = both.groupBy("u").agg(*of_node)
        most, *seen = least.agg(F.max("n"), F.sum("n"), F.sum("h")).first()
        if seen == state:
            break
        state, limit = seen, hot_limit(seen[0] or 0)
        hubs, parts = (most or 0) > limit, (seen[0] or 0) // PARTITION_EDGES + 1
        both = both.coalesce(parts)
        least = both.groupBy("u").agg(*of_node[:2])
        # Large star: every larger neighbour of u is linked with u's smallest neighbour.
        least = cut(least.coalesce(parts)) if hubs else least
        large = _with_least(both.where("v > u"), least, limit, hubs).select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        large = cut(large.coalesce(parts)) if hubs else large
        # Small star: u and its smaller neighbours are linked with the smallest of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = _with_least(large, floor, limit, hubs).where("v <> m").select(F.col("m").alias("v"), F.col("v").alias("u"))
        now = cut(moved.union(floor.select(F.col("m").alias("v"), "u")).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components are not stable after {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
