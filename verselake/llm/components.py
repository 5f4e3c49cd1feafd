"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join. Each is written to the shared folder, so a lost executor costs at most one
of them, and no plan holds another one's: nested, the plans of a round cost the driver more memory than their rows do.
Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verselake.session import discard, written


#: A node with more than 1/HUBS of the edges is a hub. An edge has two ends, so fewer than 2 * HUBS + 2 nodes are, and their
#: table may be broadcast; no hub's edges are gathered in one task.
HUBS = 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Each (u, v) of up to 2 * total edges with m, what ``least`` has for u."""
    is_hub = F.col("n") > max(total // HUBS, 1)
    hubs = F.broadcast(least.filter(is_hub).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    # The edges of hubs have their answer; spread over keys of their own they fill no task.
    key = F.when(F.col("hub").isNull(), F.xxhash64("u")).otherwise(F.xxhash64("v", F.lit("hub")))
    rest = least.select(F.xxhash64("u").alias("key"), F.col("u").alias("_u"), "m")
    joined = marked.withColumn("key", key).join(rest, ["key"], "left").filter(F.col("hub").isNotNull() | (F.col("u") == F.col("_u")))
    return joined.select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n), written: the least of u and all its v, and how many those are."""
    return written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "least")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = written(_with_least(both, least, total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    discard(least)
    return out


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    near = _with_least(down, least, total)
    # A node's own edge to its least node comes from the table of these, the other neighbours from the join.
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    discard(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Are the distinct edges (u > v) stars: has each u one v, which is no u itself?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return open_.count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v, of any orderable type without nulls); the component
    is its least node. Self-loops and repeated edges are ignored; no edges give no rows."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # A round never adds edges, so the first count bounds them all.
    total = now.count()
    for _ in range(max_rounds):
        if not total or _settled(now):
            break
        large = _large_star(now, total)
        discard(now)
        now = _small_star(large, total)
        discard(large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
