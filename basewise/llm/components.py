"""Connected components by alternating large-star and small-star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Hubs that a round joins by broadcast at most; a node is a hub from twice the edges over this on, and HUB_EDGES at least.
BROADCAST_HUBS, HUB_EDGES = 50_000, 256


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with the node ``m`` that ``least`` (u, m, n) has for u.

    The edges of hubs, nodes with very many, stay where they are and get it by broadcast; of hubs there are few, since
    they share the edges. All others are joined by a shuffle.
    """
    hubs = F.col("n") > max(HUB_EDGES, total // BROADCAST_HUBS)
    own = edges.join(F.broadcast(least.where(hubs).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = own.where("hub IS NULL").select("u", "v").join(least.where(~hubs).select("u", "m"), "u")
    return own.where("hub IS NOT NULL").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge, but the smallest of its component, with that smallest node.

    ``edges`` has columns u and v in any direction; loops and repeats don't matter. A node's edges never meet in one
    place: minima are pre-aggregated, and brought back by broadcast where a node has very many edges.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
