"""BPE encoding and decoding, without a tokenizer library.

Merging takes the lowest merge rank first from a priority queue over a doubly linked list of symbols; queue entries whose
pair has changed meanwhile are stale and skipped.  Decoding concatenates vocabulary strings with the vocabulary's joiner.

Defined results: a null or empty text has no ids and decodes to the empty string; rows, also repeated ones, are
independent of each other, so that ties and extra columns do not matter; a null document id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .tokens import BEYOND, PIECE, byte_alphabet

#: The code points with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Bpe:
    """A vocabulary of word-end BPE, read from its JSON file: ``encode`` and ``decode`` for texts."""

    def __init__(self, path: str, most: int = 150_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.piece = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.alphabet = byte_alphabet()
        self.most, self.young, self.old = most, {}, {}

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece."""
        symbols: list[str | None] = [self.alphabet[b] for b in piece.encode("utf-8")]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = left + right, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [self.vocab[s] for s in symbols if s is not None and s in self.vocab]

    def known(self, piece: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits) and decoded string of a piece, from a cache of two generations."""
        if (got := self.young.get(piece)) is None:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            if (got := self.old.get(piece)) is None:
                ids = self.merge(piece)
                got = (np.array(ids, "<u4").tobytes(), self.decode(ids))
            self.young[piece] = got
        return got

    def pieces(self, text: str):
        """Pieces of a text in order; special tokens come as ids."""
        if self.split_added and any(s in text for s in self.added):
            for k, part in enumerate(self.split_added.split(text)):
                if k % 2:
                    yield self.added[part]
                elif part:
                    yield from self.pieces(part)
        elif text.isascii() or not BEYOND.search(text):
            yield from PIECE.findall(text.lower())
        else:
            yield from self.piece.findall("".join(c.lower() for c in unicodedata.normalize("NFC", text)))

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text they decode to."""
        got = [self.known(p) if type(p) is str else (p.to_bytes(4, "little"), self.strings[p]) for p in self.pieces(text)]
        return b"".join(x[0] for x in got), " ".join([x[1] for x in got if x[0]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in order, joined by a space as for vocabularies without a decoder; unknown ids give nothing."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, ids (array of int) and decoded text."""

    def run(batches):
        b = bpe(path)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            ids, out = [], []
            for t in batch.column(1).to_pylist():
                raw, text = b.both(t)
                ids.append(np.frombuffer(raw, "<u4"))
                out.append(text)
            lengths = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), flat), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, made batch by batch without moving ids or texts."""

    def run(batches):
        b = bpe(path)
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            n, ids, out = [], [], []
            for t in batch.column(1).to_pylist():
                raw, text = b.both(t)
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                out.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
