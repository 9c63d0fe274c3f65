"""Best-fit packing of token sequences: minimum bin slack on the histogram of lengths.

A bin is filled by bitset subset-sum dynamic programming over the lengths still available: the largest one is seeded and
the fullest feasible combination is taken and removed.  As only lengths matter, the programme runs on the histogram (at
most ``capacity`` counters, whatever the corpus) and a combination is taken as many times at once as its lengths last.
Pieces then find their places by their rank among the pieces of their length; no group of pieces meets in one task.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed each by itself;
an empty table gives an empty table; a null document id stays null and is packed like any other row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, id_and_text, partitions, slices, tidy
from .tokens import encoder

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Encoded documents, each with the end id, cut only where longer than a sequence."""

    def run(batches):
        e = encoder(path)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            who, piece, start, length, crc = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(e(t).astype("<u4"), np.uint32(end)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    own = ids[s : s + capacity]
                    who.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy(encoding=True)  # the next task of this stage needs the same encoder

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``: bitset subset sums, longest first."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        steps.append((length, reach))
        most, step = min(counts[length], room // length), 1
        while most > 0:  # copies by powers of two
            step = min(step, most)
            reach |= (reach << (length * step)) & full
            most -= step
            step *= 2
        if reach >> room & 1:
            break
    total, took = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total -= length
            k += 1
        if k:
            took[length] = k
    return took


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, bins, offset): which ranks of a length go to which bins."""
    counts, used, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while longest := max((x for x, c in counts.items() if c), default=0):
        counts[longest] -= 1
        took = fullest(counts, capacity - longest)
        counts[longest] += 1
        took[longest] = took.get(longest, 0) + 1
        bins, offset = min(counts[x] // k for x, k in took.items()), 0
        for x in sorted(took, reverse=True):
            for _ in range(took[x]):
                rows.append((x, used[x], used[x] + bins, sequence, bins, offset))
                used[x] += bins
                counts[x] -= bins
                offset += x
        sequence += bins
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns doc_id, piece, length and any others) its sequence_id and offset."""
    spark = cut.sparkSession
    cut = checkpoint(cut)
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    first = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
    given = spark.sparkContext.broadcast((rows, first))  # bounded by the capacity, not by the corpus

    # Ranks within a length, in chunks: a length that a third of all rows share is counted by many tasks.  A row that says how many
    # come before a chunk is sorted ahead of its pieces, so that one exchange and one sort rank them.
    chunks = max(64, 4 * partitions(spark))
    cut = cut.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    own = cut.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("length", "_chunk", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    both = cut.withColumn("_ahead", F.lit(-1).cast("long")).unionByName(own, allowMissingColumns=True)
    both = both.repartition(partitions(spark), "length", "_chunk").sortWithinPartitions("length", "_chunk", F.col("_ahead") < 0, "doc_id", "piece", "ids_crc32")
    names = [c for c in cut.columns if c != "_chunk"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_chunk")

    def place(batches):
        (rows, first), come = given.value, 0  # how many pieces of its length come before the next row
        for batch in batches:
            length, ahead = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_ahead"))
            if not len(length):
                continue
            here = np.arange(len(length))
            head = np.maximum.accumulate(np.where(ahead >= 0, here, -1))
            rank = np.where(head < 0, come + here, ahead[head] + here - head - 1)
            come = int(rank[-1]) + 1
            own = np.flatnonzero(ahead < 0)
            length, rank, batch = length[own], rank[own], batch.take(pa.array(own))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = rows[first[x] : first[x + 1]]
                same = length == x
                at[same] = first[x] + np.searchsorted(mine[:, 1], rank[same], side="right") - 1
            found = rows[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 5])], [*names, "sequence_id", "offset"])
        tidy()

    return both.select(*names, "_ahead").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Encode, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, end), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
