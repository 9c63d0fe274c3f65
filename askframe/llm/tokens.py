"""Encoding with the tokenizers library, fast enough for whole corpora.

A text is cut where the tokenizer's own pre-tokenizer cuts it, and each distinct piece goes through the library's model
once, then comes from a bounded cache.  Texts with characters beyond U+0239 or with a special token's string take
the library's whole pipeline instead, so ids never differ from ``Tokenizer.encode(text, add_special_tokens=False).ids``.

Defined results: an empty text has no ids; callers turn null texts into empty ones.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: The letters, digits and white space that characters up to U+0239 and their lower case (up to U+02AF) have
#: in the tokenizer's Unicode classes.
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
BEYOND = re.compile("[^\x00-\u0239]")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: printable Latin-1 stays, the rest follows from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Encoder(dict):
    """Piece -> its ids as little-endian bytes; pieces not yet seen are encoded by the library's model."""

    def __init__(self, path: str, most: int = 250_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes_of = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.whole.get_vocab_size())]
        self.alphabet = byte_alphabet()
        self.most, self.older = most, {}

    def pack(self, *ids: int) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:  # two generations: pieces in use move over, the rest go
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            ids = self.pack(*[t.id for t in self.model.tokenize(symbols)])
        self[piece] = ids
        return ids

    def raw(self, text: str) -> bytes:
        """The ids of a text as little-endian integers of ``dtype``."""
        if (not text.isascii() and BEYOND.search(text)) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.__getitem__, PIECE.findall(text.lower())))

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(self.raw(text), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
