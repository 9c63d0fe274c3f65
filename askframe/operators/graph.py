"""The foreign-key graph: edges, bounded reachability, all shortest paths, and what they add to a question's tables.

Graphs of catalogs are small, but there may be many: every step is a join over all databases and questions at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..sources.catalog import Catalog

GRAPH_SCORE = 0.9


def edges(catalog: Catalog, guess_below: int = 2) -> DataFrame:
    """(db_id, a, b), both ways, without loops.  Where a database has fewer than ``guess_below`` edges, tables that have a
    column with ``id`` in its name are all connected."""
    at = catalog.columns.select("db_id", "col_idx", "table_idx")
    src = at.select("db_id", F.col("col_idx").alias("src_col_idx"), F.col("table_idx").alias("a"))
    dst = at.select("db_id", F.col("col_idx").alias("dst_col_idx"), F.col("table_idx").alias("b"))
    given = catalog.fks.join(src, ["db_id", "src_col_idx"]).join(dst, ["db_id", "dst_col_idx"]).where("a <> b").select("db_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    counted = catalog.tables.select("db_id").distinct().join(given.groupBy("db_id").count(), "db_id", "left")
    poor = counted.where(F.coalesce("count", F.lit(0)) < guess_below).select("db_id")
    with_id = catalog.columns.where(F.lower("col_name").contains("id")).select("db_id", "table_idx").distinct().join(poor, "db_id", "left_semi")
    guessed = with_id.select("db_id", F.col("table_idx").alias("a")).join(with_id.select("db_id", F.col("table_idx").alias("b")), "db_id").where("a < b")
    one = given.unionByName(guessed).distinct()
    return one.unionByName(one.select("db_id", F.col("b").alias("a"), F.col("a").alias("b")))


def neighbors(graph: DataFrame) -> DataFrame:
    """(db_id, table_idx, neighbors)."""
    return graph.groupBy("db_id", F.col("a").alias("table_idx")).agg(F.array_sort(F.collect_set("b")).alias("neighbors"))


def reachable(graph: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(key columns of seeds, table_idx, hops): tables within ``hops`` edges of a seed.  seeds: db_id, table_idx, other keys."""
    keys = [c for c in seeds.columns if c != "table_idx"]
    known = seeds.distinct().withColumn("hops", F.lit(0))
    front = known
    for h in range(1, hops + 1):
        step = front.select(*keys, F.col("table_idx").alias("a")).join(graph, [*(k for k in keys if k == "db_id"), "a"]).select(*keys, F.col("b").alias("table_idx")).distinct()
        front = step.join(known, [*keys, "table_idx"], "left_anti").withColumn("hops", F.lit(h))
        known = known.unionByName(front)
    return known


def shortest_paths(graph: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """All shortest paths between pairs (db_id, src, dst): (db_id, src, dst, path, hops).  Pairs that are not connected, or
    farther apart than ``longest`` where one is given, have none.  A walk goes on only to tables that no shorter one reached."""
    pairs = settle(pairs.select("db_id", "src", "dst").distinct())
    graph = settle(graph)
    walks = pairs.where("src <> dst").select("db_id", "src", "dst", F.array("src").alias("path"))
    done = [pairs.where("src = dst").select("db_id", "src", "dst", F.array("src").alias("path"), F.lit(0).alias("hops"))]
    seen = [pairs.select("db_id", "src", F.col("src").alias("here"))]
    while longest is None or len(seen) <= longest:
        ahead = walks.withColumn("a", F.element_at("path", -1)).join(graph, ["db_id", "a"]).withColumnRenamed("b", "here")
        ahead = ahead.join(reduce(DataFrame.unionByName, seen), ["db_id", "src", "here"], "left_anti")
        ahead = settle(ahead.select("db_id", "src", "dst", F.concat("path", F.array("here")).alias("path"), "here"))
        there = ahead.where("here = dst").drop("here")
        done.append(there.withColumn("hops", F.lit(len(seen))))
        seen.append(ahead.select("db_id", "src", "here").distinct())
        walks = ahead.drop("here").join(there.select("db_id", "src", "dst").distinct(), ["db_id", "src", "dst"], "left_anti")
        if walks.isEmpty():  # every pair is done, or no table is left that no walk has seen
            break
    return reduce(DataFrame.unionByName, done)


def seeds(links: DataFrame) -> DataFrame:
    """(question_id, db_id, table_idx) of table links, exact column links and cell links."""
    strong = (F.col("kind") == "table") | ((F.col("kind") == "column") & (F.col("match_type") == "exact")) | (F.col("kind") == "cell")
    return links.where(strong).select("question_id", "db_id", "table_idx").distinct()


def enhance(questions: DataFrame, links: DataFrame, catalog: Catalog, fallback_hops: int = 1, longest: int | None = None, union_all: bool = True) -> DataFrame:
    """(question_id, db_id, table_idx, how): the tables a question needs with those between them.

    No seed: all tables.  One seed: what lies within ``fallback_hops``.  More: the union of all shortest paths between seeds
    (or, without ``union_all``, of the least one of each pair); where none connects them, the seeds and their
    neighbourhood.
    """
    graph, given = settle(edges(catalog)), settle(seeds(links))
    counts = questions.select("question_id", "db_id").join(given.groupBy("question_id", "db_id").count(), ["question_id", "db_id"], "left").withColumn("n", F.coalesce("count", F.lit(0))).drop("count")
    none = counts.where("n = 0").join(catalog.tables.select("db_id", "table_idx"), "db_id").select("question_id", "db_id", "table_idx", F.lit("all").alias("how"))
    counts = settle(counts)
    near = settle(reachable(graph, given, fallback_hops).select("question_id", "db_id", "table_idx"))
    single = near.join(counts.where("n = 1").select("question_id"), "question_id", "left_semi").withColumn("how", F.lit("near"))
    many = given.join(counts.where("n > 1").select("question_id"), "question_id", "left_semi")
    pairs = many.withColumnRenamed("table_idx", "src").join(many.withColumnRenamed("table_idx", "dst"), ["question_id", "db_id"]).where("src < dst")
    pairs = settle(pairs)
    paths = settle(pairs.join(shortest_paths(graph, pairs, longest), ["db_id", "src", "dst"]))
    if not union_all:
        paths = paths.groupBy("question_id", "db_id", "src", "dst").agg(F.min("path").alias("path"))
    between = paths.select("question_id", "db_id", F.explode("path").alias("table_idx")).unionByName(many.join(paths.select("question_id").distinct(), "question_id", "left_semi")).distinct().withColumn("how", F.lit("path"))
    apart = many.select("question_id").distinct().join(paths.select("question_id").distinct(), "question_id", "left_anti")
    alone = near.join(apart, "question_id", "left_semi").withColumn("how", F.lit("near"))
    return none.unionByName(single).unionByName(between).unionByName(alone).distinct()


def graph_links(enhanced: DataFrame, links: DataFrame) -> DataFrame:
    """Links of kind table for tables that only the graph brought in."""
    known = links.where("kind = 'table'").select("question_id", "db_id", "table_idx")
    new = enhanced.where("how <> 'all'").join(known, ["question_id", "db_id", "table_idx"], "left_anti")
    return new.select("question_id", "db_id", F.lit("table").alias("kind"), "table_idx", F.lit(None).cast("int").alias("col_idx"), F.lit("graph_path").alias("match_type"), F.lit(GRAPH_SCORE).alias("score"), F.lit(None).cast("string").alias("span"))
