"""Stored values of a database's columns: distinct values in one pass, dumps under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.topk import top_k_per_group
from .catalog import Catalog, text_columns
from .tables import table


def cell_values(spark: SparkSession, folder: str, catalog: Catalog, most: int | None = 50, all_types: bool = False) -> DataFrame:
    """(db_id, table_name, col_name, value): distinct non-null values, at most ``most`` a column, the smallest ones first.

    Each table is scanned once: its columns are unpivoted, and distinct values are combined before the shuffle.
    """
    wanted: dict[str, list[str]] = {}
    cols = catalog.columns if all_types else text_columns(catalog.columns)
    db_id = catalog.tables.first()["db_id"]
    for r in cols.join(catalog.tables, ["db_id", "table_idx"]).orderBy("col_idx").collect():
        wanted.setdefault(r["table_name"], []).append(r["col_name"])
    parts = []
    for name, columns in wanted.items():
        t = table(spark, folder, name).select(*[F.col(c).cast("string").alias(c) for c in columns])
        parts.append(t.unpivot([], columns, "col_name", "value").where("value is not null").distinct().select(F.lit(db_id).alias("db_id"), F.lit(name).alias("table_name"), "col_name", "value"))
    out = parts[0] if parts else spark.createDataFrame([], "db_id string, table_name string, col_name string, value string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if most is None else top_k_per_group(out, ["db_id", "table_name", "col_name"], [F.col("value")], most, "_rank").drop("_rank")


def column_values(spark: SparkSession, folder: str, catalog: Catalog, column: str, most: int = 50) -> list[str]:
    """Values of the first table that has the column (its name in any case) and a value in it."""
    named = catalog.named().where(F.lower("col_name") == column.lower()).orderBy("table_idx")
    for r in named.collect():
        c = F.col(f"`{r['col_name']}`")
        found = [x[0] for x in table(spark, folder, r["table_name"]).select(c.cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most).collect()]
        if found:
            return found
    return []


def dump(values: DataFrame, per_column: int = 20, budget: int = 3000) -> DataFrame:
    """(db_id, table_name, col_name, line, used): a line of sample values for each column, as long as lines fit the budget."""
    some = top_k_per_group(values, ["db_id", "table_name", "col_name"], [F.col("value")], per_column, "_rank")
    lines = some.groupBy("db_id", "table_name", "col_name").agg(F.array_sort(F.collect_list("value")).alias("v"))
    lines = lines.select("db_id", "table_name", "col_name", F.concat("table_name", F.lit("."), "col_name", F.lit(": "), F.array_join("v", ", ")).alias("line"))
    used = F.sum(F.length("line").cast("long")).over(Window.partitionBy("db_id").orderBy("table_name", "col_name").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where(F.col("used") <= budget)
