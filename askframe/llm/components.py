"""Connected components of a distributed edge list: alternating large and small stars, checkpointed each round.

Labels move by one aggregation and one join a step; no neighbourhood is gathered in one place.  A hub (the centre of a star
with very many leaves) would put its edges on one key: keys with more rows than ``hot`` go through a broadcast join instead,
and by the choice of ``hot`` there are never more than 10,000 of them.

Large and small star alternation settles in O(log n) rounds in practice (a path of 2 ** 40 nodes would need some 60), so the
guard of 60 rounds is never met by data that fit on any disk.  Defined results: an empty list gives an empty table; loops,
repeated edges and edges with a null end are ignored; nodes without an edge are not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, collect_garbage

#: Rows of one key that one task takes in a join, at least; and how many keys can have more.
HUB = 100_000
HUBS = 10_000


def with_least(rows: DataFrame, key: str, value: str, name: str, total: int, hub: int = HUB) -> DataFrame:
    """``rows`` and, as ``name``, the least ``value`` of all rows with the same ``key``; the rows of a hot key stay where they are,
    those of others meet in a window, by one exchange."""
    hot, least = max(hub, total // HUBS), F.min(value).over(Window.partitionBy(key)).alias(name)
    if total <= hot:
        return rows.select("*", least)
    rows = checkpoint(rows)
    counts = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    hubs = F.broadcast(counts.where(F.col("_n") > hot).drop("_n"))  # total / hot at most, so 10,000 at most
    return rows.join(hubs, key, "left_anti").select("*", least).unionByName(rows.join(hubs, key))


def _large_star(edges: DataFrame, total: int, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = with_least(both, "u", "v", "m", 2 * total, hub)
    return rows.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int, hub: int) -> DataFrame:
    rows = with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "u", "v", "m", total, hub)
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return rows.select(moved.alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, label): label is the smallest node of the component.  ``edges`` has u and v, longs."""
    edges = checkpoint(edges.where("u <> v").select("u", "v").distinct())
    before = None
    for _ in range(rounds):
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sign[0] or sign == before:
            break
        before = sign
        edges = checkpoint(_small_star(_large_star(edges, sign[0], hub), sign[0], hub))
        collect_garbage(edges.sparkSession)  # the shuffle files of the rounds before
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
