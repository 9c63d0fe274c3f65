"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints are 64-bit majorities over the XXH64 of word shingles.  Distinct fingerprints meet in buckets: with the 64
bits cut in ``radius`` + 2 blocks, two fingerprints within the radius agree on at least two whole blocks.  Within buckets
they are compared bit-sliced: bit planes are stored vertically, one lane for each fingerprint; the lanes at distance s in
the order of the bucket are XORed plane by plane, eight planes at a time go into carry-save counters, and a block of lanes
is abandoned as soon as every lane of it exceeds the radius.

A bucket of more than ``most`` fingerprints is cut further: of the bits that its members do not agree on by the bucket's
key, again cut in ``radius`` + 1 blocks, two fingerprints within the radius agree on one block at least.  Fingerprints are
distinct, so a bucket with b bits left has 2 ** b members at most, and cutting ends at 10 bits.  No size of group brings in
another method, and any radius is allowed.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Defined results: a null or empty text, or one of blanks,
has fingerprint zero and is linked like any other; fewer words than a shingle form one shingle; repeated rows share
their component; rows of one doc_id with different texts each have their own fingerprint and component; a null doc_id has a
null component_id; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import checkpoint, id_and_text, one_of_each, partitions, text_bytes, text_key
from .components import HUBS, components, with_least

WIDTH = 3
SEED = 42
RADIUS = 2
MOST = 1024
#: Bits left in a bucket at which it is cut no further: it has 1,024 members at most.
LEFT = 10
LANES = 4096
#: Pairs held before they are folded into labels.
FOLD = 50_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of a text's UTF-8 bytes as an unsigned integer."""
    import xxhash

    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - width + 1)]).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8")
    half, ones = len(h) / 2, np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, and key, if ``docs`` (doc_id, text, maybe key) has it."""
    names = [*docs.columns[:1], *docs.columns[2:], "fp"]

    def run(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            data, off = data.tobytes(), off.tolist()
            fp = np.array([fingerprint(data[a:b], width, seed) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fp)], names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _number(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _add(a: int, b: int, c: int) -> tuple[int, int]:
    """Carry-save addition of three words of one-bit lanes: sums and carries."""
    u = a ^ b
    return u ^ c, a & b | u & c


def _exceeds(counter: list[int], radius: int, lanes: int) -> int:
    """The lanes in which a bit-sliced counter, least bits first, is over ``radius``."""
    over, equal = 0, lanes
    for k in range(max(len(counter), radius.bit_length()) - 1, -1, -1):
        c = counter[k] if k < len(counter) else 0
        if radius >> k & 1:
            equal &= c
        else:
            over |= equal & c
            equal &= ~c
    return over


def _alive(planes: list[int], s: int, lanes: int, radius: int) -> int:
    """Those of ``lanes`` that differ from the lane at distance ``s`` in at most ``radius`` planes."""
    ones = twos = fours = 0
    high: list[int] = []
    for k in range(0, len(planes), 8):
        d = [p ^ (p >> s) for p in planes[k : k + 8]]
        ones, a = _add(ones, d[0], d[1])
        ones, b = _add(ones, d[2], d[3])
        twos, c = _add(twos, a, b)
        ones, a = _add(ones, d[4], d[5])
        ones, b = _add(ones, d[6], d[7])
        twos, e = _add(twos, a, b)
        fours, carry = _add(fours, c, e)
        for i in range(len(high)):
            high[i], carry = high[i] ^ carry, high[i] & carry
        if carry:
            high.append(carry)
        lanes &= ~_exceeds([ones, twos, fours, *high], radius, lanes)
        if not lanes:
            break
    return lanes


def _sliced(keys: np.ndarray, fps: np.ndarray, radius: int):
    """``sliced_pairs`` by distance in the order of the lanes."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = [_number(bits[:, k]) for k in range(bits.shape[1])]
    near = _number(keys[:-1] == keys[1:])  # lane i: i and i + 1 share a bucket
    valid, s = near, 1
    while valid:
        alive = _alive(planes, s, valid, radius)
        if alive:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))
            yield at, at + s
        valid &= near >> s
        s += 1


def sliced_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of all pairs with equal keys (sorted) that differ in at most ``radius`` bits.  A fingerprint is a word of
    64 bits, or a row of such words."""
    none = np.zeros(0, np.int64)
    left, right = zip((none, none), *_sliced(keys, fps, radius), strict=True)
    return np.concatenate(left), np.concatenate(right)


def sliced_labels(keys: np.ndarray, fps: np.ndarray, radius: int, also=None) -> np.ndarray:
    """The smallest index that each lane reaches over such pairs, those only that ``also`` (i, j) lets through; pairs are
    folded into labels some at a time, so that no list of all pairs is held."""
    n = len(fps)
    label, left, right, held = np.arange(n), [], [], 0
    for i, j in _sliced(keys, fps, radius):
        if also is not None:
            ok = also(i, j)
            i, j = i[ok], j[ok]
        new = label[i] != label[j]
        left.append(label[i[new]])
        right.append(label[j[new]])
        held += int(new.sum())
        if held > FOLD:
            label = _stars(n, np.concatenate(left), np.concatenate(right))[label]
            left, right, held = [], [], 0
    return _stars(n, np.concatenate(left), np.concatenate(right))[label] if held else label


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indexes reaches over pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _compare(keys: np.ndarray, fps: np.ndarray, radius: int):
    """Star edges of the links within runs of equal keys, block of lanes by block of lanes."""
    edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    size = np.diff(edge)
    many = np.repeat(size > 1, size)
    keys, fps = keys[many], fps[many]
    size = size[size > 1]
    ends, start = np.cumsum(size), 0
    while start < len(keys):
        k = max(int(np.searchsorted(ends, start + LANES, side="right")) - 1, int(np.searchsorted(ends, start, side="right")))
        end = int(ends[k])
        label = sliced_labels(keys[start:end], fps[start:end], radius)
        own = np.flatnonzero(label != np.arange(end - start))
        if len(own):
            yield fps[start:end][own].view(np.int64), fps[start:end][label[own]].view(np.int64)
        start = end


def _cut(mask: int, parts: int) -> list[int]:
    """The bits of a mask, dealt in order to so many masks."""
    bits = [k for k in range(64) if mask >> k & 1]
    return [sum(1 << k for k in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """Star edges of the links within the buckets of ``rows`` (key, fp)."""

    def compare(batches):
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            values = np.concatenate((values, batch.column(1).to_numpy()))
            held = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on in the next batch
            for u, v in _compare(keys[:held], values[:held].view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
            keys, values = keys[held:], values[held:]
        for u, v in _compare(keys, values.view(np.uint64), radius):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(compare, "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (u, v) that connect just those of the distinct fingerprints ``fps`` (column fp) that a chain of links connects."""
    blocks = _cut((1 << 64) - 1, radius + 2)
    free = [((1 << 64) - 1) ^ a ^ b for a, b in combinations(blocks, 2)]  # by table: the bits not agreed on
    tables = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ m)))).alias("key")) for t, m in enumerate(free)]
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("row")).select("fp", "row.t", "row.key")
    edges = []
    while True:
        total = len(free) * fps.count() if not edges else rows.count()
        hot = max(most, total // HUBS)
        over = [t for t, m in enumerate(free) if m.bit_count() > LEFT]  # the others have small buckets
        hubs = checkpoint(rows.where(F.col("t").isin(over)).groupBy("key").count().where(F.col("count") > hot).select("key"))
        if hubs.isEmpty():
            edges.append(_compared(rows, radius))
            return reduce(DataFrame.unionByName, edges)
        hubs = F.broadcast(hubs)  # total / hot at most, so 10,000 at most
        edges.append(_compared(rows.join(hubs, "key", "left_anti"), radius))
        parts = [_cut(m, radius + 1) for m in free]
        choice = F.element_at(F.array(*[F.array(*[F.lit(_signed(p)) for p in own]) for own in parts]), F.col("t") + 1)
        rows = rows.join(hubs, "key").select("fp", "t", "key", F.posexplode(choice).alias("i", "own"))
        rows = checkpoint(rows.select("fp", (F.col("t") * (radius + 1) + F.col("i")).alias("t"), F.xxhash64("key", "i", F.col("fp").bitwiseAND(F.col("own"))).alias("key")))
        free = [m ^ p for m, own in zip(free, parts, strict=True) for p in own]


def _labelled(docs: DataFrame, radius: int, most: int) -> DataFrame:
    """``docs`` (doc_id, text, maybe key) without text, but with fp and ``best``, the least doc_id, or doc_id and key, of the
    row's component."""
    marks = checkpoint(fingerprints(docs))
    row = F.struct("doc_id", "key") if "key" in docs.columns else F.col("doc_id")
    first = checkpoint(marks.groupBy("fp").agg(F.min(row).alias("rep")))  # one row for each distinct fingerprint
    labels = components(links(first.select("fp"), radius, most))
    named = checkpoint(first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    return marks.join(with_least(named, "label", "rep", "best", named.count()).select("fp", "best"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id."""
    out = _labelled(id_and_text(docs, id_col, text_col), radius, most)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("best")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Of each component one row stays, with all its columns: the one with the smallest doc_id, of rows with that doc_id the one
    whose text has the smallest hash, of rows repeated with an equal text one.  Rows without a doc_id all stay."""
    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), text_key(docs).alias("key"))
    found = _labelled(rows.where("doc_id is not null"), radius, most)
    found = checkpoint(found.select(F.col("doc_id").alias("id"), "key", (F.struct("doc_id", "key") == F.col("best")).alias("stays")))
    twice = found.where("stays").groupBy("id", "key").count().where("count > 1").select("id", "key")
    return one_of_each(docs, found.where("not stays").select("id", "key").distinct(), twice, text_key(docs))
