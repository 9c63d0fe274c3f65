"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shared_folder, ship
from .tokens import encoder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder, by whatever file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what the operators need, so that extra columns of any name do no harm; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


#: Rows of (doc_id, text key) that are broadcast at most; larger tables are joined by a shuffle.
FEW = 250_000


def small(rows: DataFrame) -> DataFrame:
    """A table for the right side of a join: broadcast if a count shows that it is small, else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def text_key(docs: DataFrame) -> Column:
    """A hash of a row's whole text; with doc_id it tells rows apart, so that rows that repeat a doc_id with another text are rows
    of their own."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def one_of_each(docs: DataFrame, gone: DataFrame, twice: DataFrame, key: Column, order: Column | None = None) -> DataFrame:
    """The rows of ``docs`` without those in ``gone``, and of those in ``twice`` one each, the first by ``order``.  Both tables
    have columns id and key, which name rows by doc_id and ``key``; rows without a doc_id all stay."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), key.alias("key"), (F.lit(0) if order is None else order).alias("order"))
    rows = rows.join(small(gone), ["id", "key"], "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    twice = small(twice)
    again = rows.join(twice, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.max_by("row", "order").alias("row"))
    return rows.join(twice, ["id", "key"], "left_anti").select("row.*").unionByName(again.select("row.*"))


def partitions(spark: SparkSession) -> int:
    """How many tasks an exchange deals to: the session's setting, which the operator of a cluster sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; each partition is computed once."""
    return settle(df)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what it no longer holds; Spark's cleaner removes the files behind it, some time later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget() -> None:
    """Drop the encoders that a worker still holds from an earlier stage: some 100 MB each, beside which the memory of this stage
    would have to fit."""
    if encoder.cache_info().currsize:
        tidy()


def tidy(encoding: bool = False) -> None:
    """Give freed memory of a Python worker back, since workers live on between stages; encoders stay while a stage is ``encoding``."""
    if not encoding:
        encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more.  Its cleaner acts when the driver's garbage is
    collected, which a driver with little to do may put off until the disks are full."""
    for _ in range(2):  # first the driver's handles go, which happens in the background, then what they held
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/askframe-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Hadoop knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows (n + 1 of them), without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int, at: int = 1):
    """Cut a batch into runs of rows whose text column (number ``at``) holds about ``most`` bytes; one row may hold more."""
    n = batch.num_rows
    if n == 0:
        return
    column = batch.column(at)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1]
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, int(off[start]) + most, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start)
        start = end
