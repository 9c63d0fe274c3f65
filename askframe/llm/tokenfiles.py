"""Token ids in ORC files: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids.

Files are written in ascending doc_id order (one range of ids for each file), so a reader prunes files, stripes and row
groups by their statistics and Bloom filters and reads stripes in parallel.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; repeated rows are written each,
rows of one doc_id in the order of a hash of their texts (so that very many of one, or without one, are split among files);
an empty table gives files without rows and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, id_and_text, partitions, remove, scratch
from .tokens import encoder

END = 1
SCHEMA = "doc_id long, ids array<int>"


def encoded(docs: DataFrame, path: str, end: int = END, most: int = 1 << 20) -> DataFrame:
    """doc_id and ids, the end id included; batches hold about ``most`` ids."""

    def run(batches):
        e = encoder(path)
        last, width = end.to_bytes(e.dtype.itemsize, "little"), e.dtype.itemsize
        for batch in batches:
            start, ids, held = 0, [], 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids.append(e.raw(texts[i].as_py()) + last)
                held += len(ids[-1]) // width
                if held >= most or i == batch.num_rows - 1:
                    lengths = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) // width for x in ids], out=lengths[1:])
                    flat = np.frombuffer(b"".join(ids), e.dtype).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], ["doc_id", "ids"])
                    start, ids, held = i + 1, [], 0

    return docs.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, to: str, path: str, end: int = END, stride: int = 1000, stripe: str = "16777216") -> None:
    """Encode documents and write them to ``to`` in ascending doc_id order.  Texts are dealt out by range, ids are not moved."""
    order = ["doc_id", F.xxhash64("text")]
    ordered = id_and_text(docs).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": stripe, "compression": "zstd"}
    encoded(ordered, path, end).write.options(**options).orc(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id and ids; filters on doc_id reach stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(at)


def find(spark: SparkSession, at: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents, by metadata pruning."""
    return read(spark, at).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def offsets(spark: SparkSession, at: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""

    def digest(batches):
        seen = 0  # rows of a split come in the order of the file
        for batch in batches:
            n, crc = [], []
            ids = batch.column(1)
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(zero_copy_only=False)
            flat = flat.astype("<u4", copy=False)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n.append(b - a)
                crc.append(zlib.crc32(flat[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), batch.column(2), batch.column(3), pa.array(np.arange(seen, seen + len(n)))], ["doc_id", "n_tokens", "ids_crc32", "file", "split", "place"])
            seen += len(n)

    rows = read(spark, at).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = checkpoint(rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, file string, split long, place long"))
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(files, "file").select("doc_id", (F.col("ahead") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write the files, read them back and return their digest; the files are removed once the digest is kept."""
    spark, to = docs.sparkSession, scratch(docs.sparkSession)
    write(docs, to, path, end)
    out = offsets(spark, to)
    remove(spark, to)
    return out
