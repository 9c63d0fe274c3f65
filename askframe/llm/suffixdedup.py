"""Removal of passages that repeat: suffixes sorted by the difference-cover method, dealt out so that equal prefixes meet.

A byte goes when a string of ``window`` bytes that covers it also starts earlier (at a smaller doc_id, or earlier in the
same document).  Only suffixes that can share such a prefix are sorted, and they are dealt out so that equal prefixes meet:

1. Every window has an anchor: of its ``gram``-byte grams the one with the least hash, the leftmost of equals.  Equal
   windows have equal anchors, so the suffixes fall into independent families.  Successive windows with one anchor make a
   segment; its anchor's hash and its content's fingerprint go to the owner of the anchor.
2. The owner drops segments whose anchor occurs once.  Of segments of equal content the first stays to be sorted, the others
   are repeats of it.  Where an anchor has several contents, these have to be sorted.
3. Their bytes are fetched and each family goes through the difference-cover algorithm: sampled triples are sorted and named,
   the names are sorted recursively, the remaining suffixes are merged in, and adjacent prefixes are compared byte by byte.
   Of equal prefixes all but the first are repeats.
4. Each document removes the bytes that its repeats cover.

Mappers combine equal segments before the exchange, and send only one of them to the owner of an anchor, the rest to any
task.  An anchor with more than ``most`` contents (a short passage between ever new neighbours) is not sorted in one
place: each window of its segments is sent by a 128-bit fingerprint of its whole bytes, and only equal windows meet.

So not all repeats come through the suffix array.  Of 168 million windows of the check tool's smaller table, 5.4 % are
sorted and compared byte by byte, 0.1 % are settled by their own fingerprints, and 19.6 % are repeats of a segment of equal
content, which 128 bits (of the anchor's and the content's fingerprints) tell and no comparison of bytes: of 10 ** 12 different
segments some two would be taken for equal with a probability of about 10 ** -15, were the fingerprints random.

Defined results: a null or empty text, or one shorter than the window, loses nothing; a row with a null doc_id has no
place in the order, neither loses bytes nor takes any; rows repeated whole are one document and do not count as each
other's copies; different texts of one doc_id are documents of their own, in the order of a hash; an empty table gives an empty table; of extra columns none matters.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import checkpoint, forget, id_and_text, partitions, release, slices, text_bytes, tidy

WINDOW = 100
GRAM = 32
MOST = 1000
SLICE = 1 << 19
BLOCK = 1 << 18
FLUSH = 400_000
FULL, SORT, SPREAD = 0, 1, 2
ENTRY = np.dtype([("start", "<u4"), ("run", "u1"), ("kind", "u1"), ("anchor", "<u8")])
PLACED = np.dtype([("doc", "<i8"), *((n, ENTRY[n]) for n in ENTRY.names)])
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    got = _tables.get(base)
    if got is None or len(got) < n + 1:
        got = np.full(max(n + 1, SLICE + 1), base & _MASK, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        _tables.clear() if len(_tables) > 4 else None
        _tables[base] = got
    return got[: n + 1]


def _done() -> None:
    """At the end of a task: what can be computed again goes too."""
    _tables.clear()
    tidy()


class Rolling:
    """Fingerprints of any stretch of some bytes, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int = _BASE) -> None:
        n = len(data)
        terms = _letters()[data]
        terms *= _powers(n, base)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.back = _powers(n, pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Those of all stretches of one width."""
        x = self.sums[width:] - self.sums[:-width]
        x *= self.back[: len(x)]
        return _mix(x)


def segments(data: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Segments of concatenated documents: document, start in it, windows, anchor's hash, content's fingerprint; and Rolling."""
    roll = Rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), roll
    hashes = roll.grams(gram)
    order = (hashes & np.uint64(_MASK ^ 0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = window - gram + 1, 1
    while reach * 2 <= span:
        order = np.minimum(order[:-reach], order[reach:])
        reach *= 2
    if span > reach:
        order = np.minimum(order[: len(order) - (span - reach)], order[span - reach :])
    anchor = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(off)
    windows = np.maximum(size - window + 1, 0)
    has = np.flatnonzero(windows)
    if not len(has):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), roll
    total = int(windows.sum())
    ahead = np.cumsum(windows[has]) - windows[has]
    at = np.arange(total) + np.repeat(off[:-1][has] - ahead, windows[has])  # starts of all windows that lie in one document
    own = anchor[at]
    cut = np.ones(total, bool)
    cut[1:] = own[1:] != own[:-1]
    cut[ahead] = True
    first = np.flatnonzero(cut)
    run = np.diff(np.append(first, total))
    start = at[first]
    doc = np.searchsorted(off, start, side="right") - 1
    return doc, start - off[doc], run, hashes[own[first]], roll.of(start, start + run + window - 1), roll


def _pack(doc: np.ndarray, start: np.ndarray, run: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> bytes:
    own, who = np.unique(doc, return_inverse=True)
    return struct.pack("<II", len(who), len(own)) + own.astype("<i8").tobytes() + who.astype("<u4").tobytes() + start.astype("<u4").tobytes() + run.astype("u1").tobytes() + anchor.astype("<u8").tobytes() + content.astype("<u8").tobytes()


def _unpack(blob: bytes):
    n, m = struct.unpack_from("<II", blob)
    at, out = 8, []
    for kind, k in (("<i8", m), ("<u4", n), ("<u4", n), ("u1", n), ("<u8", n), ("<u8", n)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += k * np.dtype(kind).itemsize
    own, who, *rest = out
    return own[who], *rest


def _deal(owners: int, doc, start, run, anchor, content):
    """(owner, blob) of entries: of equal ones the first goes to the owner of its anchor, the others to any, marked as
    repeats.  The same place given twice (of rows repeated whole) counts once."""
    order = np.lexsort((start, doc, content, anchor))
    doc = doc[order]  # one by one, so that no two are held twice
    start = start[order]
    run = run[order]
    anchor = anchor[order]
    content = content[order]
    equal = np.zeros(len(doc), bool)
    equal[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    twice = np.zeros(len(doc), bool)
    twice[1:] = equal[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    owner = np.where(equal, np.arange(len(doc)) % owners, (_mix(anchor) % np.uint64(owners)).astype(np.int64))
    marked = run.astype(np.uint8) | np.where(equal, 128, 0).astype(np.uint8)
    order = np.flatnonzero(~twice)
    order = order[np.argsort(owner[order], kind="stable")]
    edge = np.searchsorted(owner[order], np.arange(owners + 1))
    for o in np.flatnonzero(np.diff(edge)):
        i = order[edge[o] : edge[o + 1]]
        yield int(o), _pack(doc[i], start[i], marked[i], anchor[i], content[i])


def _parts(doc: np.ndarray, entries: np.ndarray, parts: int) -> pa.Table:
    """A row for each part of the documents: the entries of its documents."""
    placed = np.empty(len(doc), PLACED)
    placed["doc"] = doc
    for n in ENTRY.names:
        placed[n] = entries[n]
    part = (_mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((doc, part))
    placed, part = placed[order], part[order]
    edge = np.searchsorted(part, np.arange(parts + 1))
    own = np.flatnonzero(np.diff(edge))
    return pa.table({"part": pa.array(own, pa.int32()), "blob": pa.array([placed[edge[o] : edge[o + 1]].tobytes() for o in own], pa.binary())})


_PARTS = "part int, blob binary"


def _merge(table):
    """A row for each document of a part: its entries from everywhere, and whether any has to be fetched."""
    placed = np.concatenate([np.frombuffer(b, PLACED) for b in table.column("blob").to_pylist()])
    placed = placed[np.argsort(placed["doc"], kind="stable")]
    cut = np.flatnonzero(np.diff(placed["doc"])) + 1
    entries = np.empty(len(placed), ENTRY)
    for n in ENTRY.names:
        entries[n] = placed[n]
    fetch = np.logical_or.reduceat(placed["kind"] != FULL, np.concatenate(([0], cut)))
    return pa.table({"doc_id": placed["doc"][np.concatenate(([0], cut))], "entries": pa.array([x.tobytes() for x in np.split(entries, cut)], pa.binary()), "fetch": fetch})


_BY_DOC = "doc_id long, entries binary, fetch boolean"


def _decide(table: pa.Table, most: int, parts: int) -> pa.Table:
    """What the owner of some anchors finds: repeats in full, and segments to be sorted."""
    doc, start, run, anchor, content = (np.concatenate(x) for x in zip(*map(_unpack, table.column("blob").to_pylist()), strict=True))
    repeat = run >= 128
    run = run & 127
    left = np.flatnonzero(~repeat)
    order = np.argsort(anchor[left], kind="stable")
    a = anchor[left][order]
    twin = np.zeros(len(a), bool)
    twin[1:] = a[1:] == a[:-1]
    twin[:-1] |= twin[1:]
    i = left[order[twin]]
    i = i[np.lexsort((start[i], doc[i], content[i], anchor[i]))]
    new_anchor, new = np.ones(len(i), bool), np.ones(len(i), bool)
    new_anchor[1:] = anchor[i][1:] != anchor[i][:-1]
    new[1:] = new_anchor[1:] | (content[i][1:] != content[i][:-1])
    contents = np.bincount(np.cumsum(new_anchor) - 1, weights=new) if len(i) else np.zeros(0)
    contents = contents[np.cumsum(new_anchor) - 1] if len(i) else contents
    # Rows repeated whole give the same place twice; it is no repeat of itself.
    itself = np.zeros(len(i), bool)
    itself[1:] = ~new[1:] & (doc[i][1:] == doc[i][:-1]) & (start[i][1:] == start[i][:-1])
    leader = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    if len(i):
        itself |= ~new & (doc[i] == doc[i[leader]]) & (start[i] == start[i[leader]])
    kind = np.where(new, np.where(contents > most, SPREAD, SORT), FULL)
    use = (~new & ~itself) | (new & (contents > 1))
    i, kind = i[use], kind[use]
    rest = np.flatnonzero(repeat)
    out = np.zeros(len(i) + len(rest), ENTRY)
    every = np.concatenate((i, rest))
    out["start"], out["run"], out["anchor"] = start[every], run[every], anchor[every]
    out["kind"][: len(i)] = kind
    return _parts(doc[every], out, parts)


def _lex(*keys: np.ndarray) -> np.ndarray:
    """The order by non-negative keys, the first one counting most; packed into one word where they fit."""
    width = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(width) > 63:
        return np.lexsort(keys[::-1])
    word = keys[0].astype(np.int64)
    for k, w in zip(keys[1:], width[1:], strict=True):
        word = (word << w) | k
    return np.argsort(word, kind="stable")


def _pair(high: np.ndarray, low: np.ndarray, base: int) -> np.ndarray:
    return high.astype(np.int64) * base + low


def suffix_array(text: np.ndarray, depth: int, reached: int = 1) -> np.ndarray:
    """Starts of the suffixes of ``text`` (positive integers) in the order of their first ``depth`` letters of the outermost
    text, by the difference cover {1, 2} modulo 3; ``reached`` letters of that text make one letter here."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate((text, np.zeros(4, np.int32))).astype(np.int32, copy=False)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    order = _lex(s[sample], s[sample + 1], s[sample + 2])
    i = sample[order]
    new = np.ones(len(i), bool)
    new[1:] = (s[i[1:]] != s[i[:-1]]) | (s[i[1:] + 1] != s[i[:-1] + 1]) | (s[i[1:] + 2] != s[i[:-1] + 2])
    names = np.cumsum(new)
    if names[-1] < len(i) and 3 * reached < depth:
        named = np.empty(len(sample), np.int32)
        named[order] = names
        i = sample[suffix_array(named, depth, 3 * reached)]
    rank = np.zeros(n + 4, np.int32)
    rank[i] = np.arange(1, len(i) + 1)
    i = i[i < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[_lex(s[zeros], rank[zeros + 1])]
    # Where each remaining suffix falls among the sampled ones of either class.
    top = int(rank.max()) + 1
    first, second = i[i % 3 == 1], i[i % 3 == 2]
    ahead = np.searchsorted(_pair(s[first], rank[first + 1], top), _pair(s[zeros], rank[zeros + 1], top), side="right")
    letters = int(s.max()) + 1
    if letters * letters * top < 1 << 62:
        ahead = ahead + np.searchsorted(_pair(_pair(s[second], s[second + 1], letters), rank[second + 2], top), _pair(_pair(s[zeros], s[zeros + 1], letters), rank[zeros + 2], top), side="right")
    else:
        both = np.concatenate((second, zeros))
        o = np.lexsort((np.arange(len(both)), rank[both + 2], s[both + 1], s[both]))
        seen = np.cumsum(o < len(second))
        found = np.empty(len(both), np.int64)
        found[o] = seen
        ahead = ahead + np.sort(found[len(second) :])
    # Suffixes that agree on `depth` letters may come in any order; the maximum keeps places distinct then.
    place = np.arange(len(zeros)) + np.maximum.accumulate(ahead) if len(zeros) else zeros
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zeros
    out[~taken] = i
    return out


def equal_prefixes(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For neighbours in ``starts``: whether their prefixes of ``window`` bytes are equal; eight bytes at a time."""
    words = np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,)) if len(data) >= 8 else None
    left = np.arange(len(starts) - 1)
    for at in [*range(0, window - 7, 8), window - 8]:
        left = left[words[starts[left] + at] == words[starts[left + 1] + at]]
    out = np.zeros(max(0, len(starts) - 1), bool)
    out[left] = True
    return out


def _sort_family(doc, start, run, bodies: list[bytes], window: int):
    """Repeats among the windows of some segments: which segment and which of its windows."""
    size = np.array([len(b) for b in bodies], np.int64)
    raw = b"\0".join(bodies) + b"\0" * 8
    data = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(size + 1) - (size + 1)
    text = data[: len(data) - 8].astype(np.int32) + 1
    seg = np.repeat(np.arange(len(run)), run)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(run) - run, run)
    window_of = np.full(len(text) + 1, -1, np.int64)
    window_of[begin[seg] + off] = np.arange(len(seg))
    order = window_of[suffix_array(text, window)]
    order = order[order >= 0]
    same = equal_prefixes(data, begin[seg[order]] + off[order], window)
    group = np.concatenate(([0], np.cumsum(~same)))
    linked = np.zeros(len(order), bool)
    linked[1:] |= same
    linked[:-1] |= same
    order, group = order[linked], group[linked]
    place = start[seg[order]] + off[order]
    by = np.lexsort((place, doc[seg[order]], group))
    order, group, place = order[by], group[by], place[by]
    d = doc[seg[order]]
    repeat = np.zeros(len(order), bool)
    repeat[1:] = (group[1:] == group[:-1])
    lead = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))
    repeat &= (d != d[lead]) | (place != place[lead])
    return seg[order[repeat]], off[order[repeat]]


def _runs(doc: np.ndarray, start: np.ndarray, parts: int) -> pa.Table:
    """Entries of single windows, successive ones joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    long = np.diff(np.append(first, len(doc)))
    times = -(-long // 127)
    piece = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    out = np.zeros(len(piece), ENTRY)
    out["start"] = np.repeat(start[first], times) + 127 * piece
    out["run"] = np.minimum(127, np.repeat(long, times) - 127 * piece)
    return _parts(np.repeat(doc[first], times), out, parts)


def _ship(owners: int, window: int):
    """Fetch the bytes of segments to be sorted: (bucket, kind, head, body)."""

    def rows(held, spread):
        out, squeeze = [], zstandard.ZstdCompressor(level=1)
        if held:
            doc, start, run, anchor = (np.array(x) for x in zip(*((h[0], h[1], h[2], h[3]) for h in held), strict=True))
            bucket = (_mix(anchor.astype(np.uint64)) % np.uint64(owners)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(owners + 1))
            for o in np.flatnonzero(np.diff(edge)):
                i = order[edge[o] : edge[o + 1]]
                head = _pack(doc[i], start[i], run[i], anchor[i].astype(np.uint64), np.zeros(len(i), np.uint64))
                out.append((int(o), SORT, head, squeeze.compress(b"".join(held[k][4] for k in i.tolist()))))
        if spread:
            doc, start, anchor, content = (np.concatenate(x) for x in zip(*spread, strict=True))
            for o, blob in _deal(owners, doc, start, np.ones(len(doc), np.uint8), anchor, content):
                out.append((o, SPREAD, blob, b""))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.binary())], ["bucket", "kind", "head", "body"])

    def run(batches):
        forget()
        held, spread, size = [], [], 0
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            data, off = text_bytes(batch.column(1))
            data, off = data.tobytes(), off.tolist()
            for k, (d, lists) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = data[off[k] : off[k + 1]]
                entries = np.unique(np.frombuffer(b"".join(lists), ENTRY))
                for s, r, a in zip(*(entries[entries["kind"] == SORT][c].tolist() for c in ("start", "run", "anchor")), strict=True):
                    held.append((d, s, r, a, raw[s : s + r + window - 1]))
                    size += r + window
                apart = entries[entries["kind"] == SPREAD]
                if len(apart):
                    at = np.concatenate([np.arange(s, s + r) for s, r in zip(apart["start"].tolist(), apart["run"].tolist(), strict=True)])
                    octets = np.frombuffer(raw, np.uint8)
                    spread.append((np.full(len(at), d), at, Rolling(octets).of(at, at + window), Rolling(octets, _BASE ^ 0x5DEECE66C).of(at, at + window)))
                    size += 24 * len(at)
                if size > 8 << 20:
                    yield rows(held, spread)
                    held, spread, size = [], [], 0
        if held or spread:
            yield rows(held, spread)
        _done()

    return run


def _sort(window: int, parts: int, block: int = BLOCK):
    """Sort the families of a bucket, some at a time, and settle the windows that came by their fingerprints."""

    def run(key, table):
        kinds = np.array(table.column("kind").to_pylist())
        heads, bodies = table.column("head").to_pylist(), table.column("body").to_pylist()
        out_doc, out_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        chosen = np.flatnonzero(kinds == SORT).tolist()
        if chosen:
            meta = [_unpack(heads[k]) for k in chosen]
            doc, start, length, anchor, _ = (np.concatenate(x) for x in zip(*meta, strict=True))
            start, length = start.astype(np.int64), length.astype(np.int64)
            raw = b"".join(zstandard.ZstdDecompressor().decompress(bodies[k]) for k in chosen)
            end = np.cumsum(length + window - 1)
            begin = end - (length + window - 1)
            order = np.argsort(anchor, kind="stable")
            family = np.concatenate(([0], np.flatnonzero(np.diff(anchor[order])) + 1, [len(order)]))
            held = np.concatenate(([0], np.cumsum((length + window)[order])))[family]  # bytes ahead of each family
            f = 0
            while f < len(family) - 1:
                g = max(f + 1, int(np.searchsorted(held, held[f] + block, side="right")) - 1)
                i = order[family[f] : family[g]]
                seg, off = _sort_family(doc[i], start[i], length[i], [raw[a:b] for a, b in zip(begin[i].tolist(), end[i].tolist(), strict=True)], window)
                out_doc.append(doc[i][seg])
                out_start.append(start[i][seg] + off)
                f = g
        chosen = np.flatnonzero(kinds == SPREAD).tolist()
        if chosen:
            doc, start, length, anchor, content = (np.concatenate(x) for x in zip(*(_unpack(heads[k]) for k in chosen), strict=True))
            repeat = length >= 128
            left = np.flatnonzero(~repeat)
            left = left[np.lexsort((start[left], doc[left], content[left], anchor[left]))]
            more = np.zeros(len(left), bool)
            more[1:] = (anchor[left][1:] == anchor[left][:-1]) & (content[left][1:] == content[left][:-1])
            lead = np.maximum.accumulate(np.where(more, 0, np.arange(len(left)))) if len(left) else left
            more &= (doc[left] != doc[left[lead]]) | (start[left] != start[left[lead]])
            every = np.concatenate((left[more], np.flatnonzero(repeat)))
            out_doc.append(doc[every])
            out_start.append(start[every].astype(np.int64))
        found = _runs(np.concatenate(out_doc), np.concatenate(out_start), parts)
        tidy()
        return found

    return run


def _found(known: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """What the owners of anchors decide, a row for each document that has any entry."""
    owners = partitions(known.sparkSession)

    def anchors(batches):
        def flush(held):
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            found = list(_deal(owners, *columns))
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["owner", "blob"])

        forget()
        held, count = [], 0
        for part in (part for batch in batches for part in slices(batch, SLICE)):
            doc, start, run, anchor, content, _ = segments(*text_bytes(part.column(1)), window, gram)
            held.append((part.column(0).to_numpy()[doc], start.astype(np.uint32), run.astype(np.uint8), anchor, content))
            count += len(doc)
            if count > FLUSH:
                yield flush(held)
                count = 0
        if count:
            yield flush(held)
        _done()

    sent = known.mapInArrow(anchors, "owner int, blob binary")
    decided = sent.groupBy("owner").applyInArrow(lambda table: _decide(table, most, owners), _PARTS)
    return checkpoint(decided.groupBy("part").applyInArrow(_merge, _BY_DOC))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """For documents (doc_id, text) that repeat something: doc_id and lists of entries, the starts of repeating windows."""
    if not 8 <= gram <= window <= gram + 126:
        raise ValueError("a window must be longer than its grams by 126 bytes at most")
    owners = partitions(docs.sparkSession)
    known = docs.where("doc_id is not null")
    found = _found(known, window, gram, most)
    release(docs.sparkSession)  # the anchors' exchange is over
    fetched = known.join(found.where("fetch"), "doc_id").select("doc_id", "text", F.array("entries").alias("lists"), *known.columns[2:]).mapInArrow(_ship(owners, window), "bucket int, kind int, head binary, body binary")
    settled = fetched.groupBy("bucket").applyInArrow(_sort(window, owners), _PARTS).groupBy("part").applyInArrow(_merge, _BY_DOC)
    return found.unionByName(settled).groupBy("doc_id").agg(F.collect_list("entries").alias("lists"))


def _removed(size: int, lists, window: int) -> np.ndarray:
    """Which bytes go."""
    entries = np.frombuffer(b"".join(lists), ENTRY)
    entries = entries[entries["kind"] == FULL]
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, entries["start"].astype(np.int64), 1)
    np.add.at(step, entries["start"].astype(np.int64) + entries["run"] + window - 1, -1)
    return np.cumsum(step[:-1], out=step[:-1]) > 0


def _places(known: DataFrame) -> DataFrame | None:
    """Where one doc_id names different texts: (doc_id, key, place), by which each text has a place of its own in the order of
    doc_id, then of a hash of the text; else nothing."""
    names = known.select("doc_id", F.xxhash64("text").alias("key")).distinct()
    if names.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return checkpoint(checkpoint(names.orderBy("doc_id", "key")).withColumn("place", F.monotonically_increasing_id()))


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` kept_text too, in which a
    character that lost some of its bytes is left out, and ``row``, a struct of all columns of ``docs`` but the text."""
    ship(docs.sparkSession)
    others = [docs[c] for c in docs.columns if c != "text"] if texts else []
    docs = id_and_text(docs) if not texts else docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.struct(*others).alias("row"))
    places = _places(docs.where("doc_id is not null"))
    if places is None:
        return _removals(docs, window, gram, most, texts)
    named = docs.withColumn("key", F.xxhash64("text")).join(places, ["doc_id", "key"], "left")  # null ids stay null
    out = _removals(named.select(F.col("place").alias("doc_id"), *docs.columns[1:]), window, gram, most, texts)
    back = out.withColumnRenamed("doc_id", "place").join(places.select("place", "doc_id"), "place", "left")
    return back.select(*out.columns)


def _removals(docs: DataFrame, window: int, gram: int, most: int, texts: bool) -> DataFrame:
    """``removals`` of prepared documents whose doc_id names one text each."""
    # Texts are dealt out by doc_id twice, here and where segments are fetched; both exchanges together are about twice the input.
    joined = docs.where("doc_id is not null").join(repeats(docs, window, gram, most), "doc_id", "left").select("doc_id", "text", "lists", *docs.columns[2:])
    joined = joined.unionByName(docs.where("doc_id is null").withColumn("lists", F.lit(None).cast("array<binary>")))

    def run(batches):
        forget()
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            data, off = text_bytes(batch.column(1))
            data, off = data.tobytes(), off.tolist()
            cols: list[list] = [[], [], [], [], []]
            for k, lists in enumerate(batch.column(2).to_pylist()):
                raw, removed, spans = data[off[k] : off[k + 1]], 0, 0
                if lists:
                    gone = _removed(len(raw), lists, window)
                    removed, spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for c, v in zip(cols, (off[k + 1] - off[k], removed, spans, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "ignore") if texts else None), strict=True):
                    c.append(v)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays, names = [*arrays, pa.array(cols[4], pa.string()), batch.column(3)], [*names, "kept_text", "row"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        _done()

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, f"{kinds}, kept_text string, row {docs.schema['row'].dataType.simpleString()}" if texts else kinds)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages removed from text, and n_chars, where there is one, counted anew."""
    out = removals(docs, texts=True)
    length = F.char_length("kept_text").cast("long")
    picked = [F.col("kept_text").alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*picked)


#: The same by all windows at once, each by its MD5: for small tables.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS size FROM d),
w AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, size - 99)) AS pos FROM n WHERE size >= 100)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
s AS (SELECT doc_id, pos, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL AS new FROM r),
g AS (SELECT doc_id, pos, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM s),
i AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, lag(b, 1, 0) OVER o AS a, a AS b FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
p AS (SELECT * FROM k UNION ALL SELECT n.doc_id, coalesce(max(i.b), 0), n.size FROM n LEFT JOIN i ON i.doc_id = n.doc_id GROUP BY n.doc_id, n.size),
t AS (SELECT n.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM n JOIN p ON p.doc_id = n.doc_id GROUP BY n.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM i GROUP BY doc_id)
SELECT n.doc_id, n.size AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM n JOIN t ON t.doc_id = n.doc_id LEFT JOIN c ON c.doc_id = n.doc_id
"""
