"""Pruning a schema to what a question needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..sources.catalog import Catalog
from .graph import edges, reachable


def pruned_tables(links: DataFrame, catalog: Catalog, depth: int = 1) -> DataFrame:
    """(question_id, db_id, table_idx): tables of any link and those within ``depth`` foreign keys."""
    own = links.select("question_id", "db_id", "table_idx").distinct()
    return reachable(settle(edges(catalog, guess_below=0)), own, depth).select("question_id", "db_id", "table_idx").distinct()


def pruned_columns(links: DataFrame, catalog: Catalog, tables: DataFrame) -> DataFrame:
    """(question_id, db_id, col_idx): linked columns, primary keys of kept tables, and both ends of foreign keys between
    kept tables."""
    at = catalog.columns.select("db_id", "col_idx", "table_idx", "is_pk")
    linked = links.where("col_idx is not null").select("question_id", "db_id", "col_idx")
    keys = tables.join(at.where("is_pk"), ["db_id", "table_idx"]).select("question_id", "db_id", "col_idx")
    src = tables.join(at, ["db_id", "table_idx"]).select("question_id", "db_id", F.col("col_idx").alias("src_col_idx"))
    dst = tables.join(at, ["db_id", "table_idx"]).select("question_id", "db_id", F.col("col_idx").alias("dst_col_idx"))
    both = catalog.fks.join(src, ["db_id", "src_col_idx"]).join(dst, ["question_id", "db_id", "dst_col_idx"])
    ends = both.select("question_id", "db_id", F.explode(F.array("src_col_idx", "dst_col_idx")).alias("col_idx"))
    return linked.unionByName(keys).unionByName(ends).distinct()


def prune(links: DataFrame, catalog: Catalog, least: int = 1, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Kept tables and columns; a question with fewer than ``least`` tables keeps the whole schema."""
    tables = settle(pruned_tables(links, catalog, depth))
    few = links.select("question_id", "db_id").distinct().join(tables.groupBy("question_id").count().where(F.col("count") >= least), "question_id", "left_anti")
    whole = few.join(catalog.tables.select("db_id", "table_idx"), "db_id")
    kept = tables.join(few.select("question_id"), "question_id", "left_anti").unionByName(whole.select("question_id", "db_id", "table_idx"))
    kept = settle(kept)
    columns = pruned_columns(links, catalog, kept).unionByName(whole.join(catalog.columns.select("db_id", "table_idx", "col_idx"), ["db_id", "table_idx"]).select("question_id", "db_id", "col_idx"))
    return kept, columns.distinct()
