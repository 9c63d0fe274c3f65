"""Databases as folders of Parquet tables: path resolution, reading and registration as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def resolve(spark: SparkSession, root: str, db_id: str) -> str | None:
    """The folder of a database: ``root/db_id/db_id``, then ``root/db_id``; None if there is neither."""
    for path in (f"{root}/{db_id}/{db_id}", f"{root}/{db_id}"):
        if _exists(spark, path):
            return path
    return None


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[str]:
    """Register the Parquet tables of a folder as temporary views, and return their names."""
    found = [n.removesuffix(".parquet") for n in _children(spark, folder) if n.endswith(".parquet")]
    chosen = [n for n in found if names is None or n in names]
    for n in chosen:
        table(spark, folder, n).createOrReplaceTempView(n)
    return chosen


def table_names(spark: SparkSession) -> list[str]:
    """Tables and views of the session."""
    return sorted(t.name for t in spark.catalog.listTables())


def column_names(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(name, type) of a registered table's columns."""
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]
