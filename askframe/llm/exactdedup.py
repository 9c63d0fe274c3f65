"""Exact deduplication by exchanging Golomb-coded fingerprints.

Every chunk of documents sends its sorted distinct 64-bit fingerprints, Golomb-Rice coded, to the owners of hash ranges.
Owners answer each chunk with a bitmap of those that another chunk sent too.  Only documents marked there, or twice in
their own chunk, are suspects; their texts alone are shuffled, and equality is decided on bytes.  A fingerprint goes out
once for each chunk and equal texts are combined before the shuffle, so that a text which a third of all rows share
burdens no task.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the
most code points stays, then the one with the smallest doc_id.  Defined results: a null text counts as empty, and all
empty texts form one group; repeated rows count each (``keep_one`` keeps one of them); rows of one
doc_id with different texts belong each to the group of its text; a row with a null doc_id is a group of its own with a null keep_id;
an empty table gives an empty table; of extra columns none matters.
"""

from __future__ import annotations

import hashlib
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_and_text, one_of_each, partitions

#: The white space that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"


def golomb(values: np.ndarray, span: int) -> bytes:
    """Rice code of sorted distinct unsigned integers below ``span``: a header, unary quotients, then remainders."""
    n = len(values)
    k = max(0, min(63, (max(1, span // max(1, n))).bit_length() - 1))
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    bits = np.packbits(unary)
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IBI", n, k, len(bits)) + bits.tobytes() + np.packbits(low).tobytes()


def ungolomb(blob: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", blob)
    if n == 0:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 9)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9 + size))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the normalised text, and its first 64 bits as fp."""
    drop = BLANKS.encode()

    def run(batches):
        for batch in batches:
            digests = [hashlib.sha256(t.encode("utf-8").translate(None, drop)) for t in batch.column(1).to_pylist()]
            fp = np.array([int.from_bytes(d.digest()[:8], "big") for d in digests], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.hexdigest() for d in digests], pa.string()), pa.array(fp)], ["doc_id", "text_sha256", "fp"])

    return docs.mapInArrow(run, "doc_id long, text_sha256 string, fp long")


def suspects(marks: DataFrame, owners: int) -> DataFrame:
    """doc_id of those rows of ``marks`` (doc_id, fp) whose fingerprint occurs more than once; by compressed exchange."""
    span = -(-(1 << 64) // owners)
    marks = marks.select(F.pmod(F.xxhash64("doc_id"), F.lit(owners)).cast("int").alias("chunk"), "doc_id", "fp")

    def distinct(table: pa.Table):
        fp, counts = np.unique(table.column("fp").to_numpy().view(np.uint64), return_counts=True)
        owner = (fp // np.uint64(span)).astype(np.int64)
        edges = np.searchsorted(owner, np.arange(owners + 1))
        return fp, counts, edges

    def send(key, table):
        fp, _, edges = distinct(table)
        rows = [(o, golomb(fp[edges[o] : edges[o + 1]] - np.uint64(o * span), span)) for o in range(owners) if edges[o + 1] > edges[o]]
        return pa.table({"owner": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def answer(key, table):
        parts = [ungolomb(b) for b in table.column("blob").to_pylist()]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[counts > 1]
        bits = [np.packbits(np.isin(p, twice, assume_unique=True)).tobytes() for p in parts]
        return pa.table({"owner": table.column("owner"), "chunk": table.column("chunk"), "bitmap": pa.array(bits, pa.binary())})

    def apply(key, rows, maps):
        fp, counts, edges = distinct(rows)
        marked = counts > 1
        for o, bits in zip(maps.column("owner").to_pylist(), maps.column("bitmap").to_pylist(), strict=True):
            a, b = edges[o], edges[o + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a].astype(bool)
        own = marked[np.searchsorted(fp, rows.column("fp").to_numpy().view(np.uint64))]
        return pa.table({"doc_id": rows.column("doc_id").filter(pa.array(own))})

    sent = marks.groupBy("chunk").applyInArrow(send, "owner int, chunk int, blob binary")
    maps = sent.groupBy("owner").applyInArrow(answer, "owner int, chunk int, bitmap binary")
    return marks.groupBy("chunk").cogroup(maps.groupBy("chunk")).applyInArrow(apply, "doc_id long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = id_and_text(docs, id_col, text_col)
    marks = checkpoint(fingerprints(docs))
    found = suspects(marks.where("doc_id is not null").select("doc_id", "fp"), partitions(docs.sparkSession)).distinct()
    texts = docs.join(found, "doc_id", "left_semi")
    # Longest original text first, then the smallest doc_id, as one number: hash aggregation combines it before the shuffle.
    shift, top = F.lit(Decimal(1 << 64)), F.lit(Decimal((1 << 63) - 1))
    order = F.char_length("text").cast("decimal(10,0)") * shift + (top - F.col("doc_id"))
    groups = texts.groupBy(F.translate("text", BLANKS, "").alias("body")).agg(F.max(order).alias("best"), F.count("*").alias("n"))
    groups = groups.select(F.sha2("body", 256).alias("text_sha256"), (top - F.col("best") % shift).cast("long").alias("best"), "n")
    rows = marks.select("doc_id", "text_sha256").join(groups, "text_sha256", "left")
    known = F.col("doc_id").isNotNull()
    rows = rows.select("doc_id", F.when(known, F.coalesce("best", "doc_id")).alias("keep_id"), F.when(known, F.coalesce("n", F.lit(1))).otherwise(1).cast("long").alias("group_size"), "text_sha256")
    return rows.withColumn("kept", F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns as they are.  Rows are told apart by doc_id and normalised text: a text stays
    though its doc_id also names a copy of another text, and of rows that repeat a doc_id with an equal text one stays, the
    longest; rows without a doc_id all stay."""
    out = checkpoint(exact_groups(docs).where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key"), "kept"))
    gone = out.where(~F.col("kept")).select("id", "key").distinct()
    twice = out.where("kept").groupBy("id", "key").count().where("count > 1").select("id", "key")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return one_of_each(docs, checkpoint(gone), checkpoint(twice), F.sha2(F.translate(text, BLANKS, ""), 256), F.char_length(text))


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM (
    SELECT doc_id, body, n, sha256(body) AS text_sha256
    FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
  )
)
"""
