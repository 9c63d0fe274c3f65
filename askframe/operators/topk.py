"""Top rows: by group, or a greedy prefix under a budget; and the places of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; a filter on row_number, for which Spark keeps only k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def budget_prefix(df: DataFrame, order: list[Column], size: Column, budget: int, bucket: Column | None = None) -> DataFrame:
    """Rows in order while their sizes add up to at most ``budget``.

    With ``bucket``, a non-decreasing function of the order, sums are taken within buckets and then over their totals,
    so that no task sees all rows; rows of one bucket only meet each other.  Without it the rows are sorted, and the sorted
    partitions are the buckets.
    """
    if bucket is None:
        df, names = settle(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())), df.columns
        return budget_prefix(df, [F.col("_place")], size, budget, F.shiftright("_place", 33)).select(*names, "used")
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum(size).alias("_n"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") <= budget)
    own = F.sum(size).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(totals.select("_bucket", "_before"), "_bucket").withColumn("used", own + F.col("_before")).where(F.col("used") <= budget).drop("_bucket", "_before")


def positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` with each row's place, from 0, in the order that ``df`` has (of an ``orderBy``).

    Rows are kept once, with a number that grows by partition and row; a partition's place comes from the sizes of those
    before it, so that no task sees all rows.
    """
    rows = settle(df.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = F.broadcast(sizes.select("_part", before.alias("_before")))  # a row for each partition
    return rows.withColumn("_part", part).join(ahead, "_part").withColumn(name, F.col("_before") + row).select(name, *df.columns)
