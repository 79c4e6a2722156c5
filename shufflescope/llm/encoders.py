"""Exact encoders with pre-token caches around the public tokenizers.

A text is cut where the tokenizer itself never merges across, each piece is encoded once by the library and kept in a
bounded cache of the Python worker.  Texts with characters whose classes Python's ``re`` and the library could see
differently, or with special strings, go to the library whole, so results always equal the library's.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Entries of a worker's caches of pre-tokens and of space-delimited chunks; a full cache is begun anew.
PRE_ENTRIES, CHUNK_ENTRIES = 250_000, 120_000
#: Longer pieces are encoded each time, so that a cache stays small.
LONGEST_KEY = 48
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-įı-ſ"
#: Characters outside of this set send the whole text to the library.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ſ‐-‧‰-⁞€]")


def path_of(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """A bounded cache of ``make``; looked up by ``map(memo.__getitem__, ...)`` without a Python call for each hit."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.entries:
                self.clear()
            self[key] = got
        return got


_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_MARKS = frozenset(".,;:!?")


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes."""

    cut: re.Pattern
    lead = ""
    entries = PRE_ENTRIES, CHUNK_ENTRIES

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pre, self.chunks = (Memo(make, n) for make, n in zip((self.merge, self.chunk), self.entries, strict=True))
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level BPE
        self.table = {b: chr(b) for b in chars}
        for b in range(256):
            if b not in self.table:
                self.table[b] = chr(256 + len(self.table) - len(chars))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        return not (_CONTROL if text.isascii() else _ODD).search(text) and not any(s in text for s in self.special)

    def merge(self, pre: str) -> bytes:
        """One pre-token, by the library's model."""
        return array("I", [t.id for t in self.model.tokenize(pre.encode().decode("latin-1").translate(self.table))]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """What stands between two spaces: mostly a word, with or without a mark after it."""
        if chunk.isalpha():
            return self.pre[self.lead + chunk]
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.pre[self.lead + chunk[:-1]] + self.pre[chunk[-1]]
        return b"".join(map(self.pre.__getitem__, self.cut.findall(self.lead + chunk)))


class ByteEncoder(Encoder):
    """Byte-level BPE: pre-tokens keep the one space before them."""

    cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
    lead = " "
    entries = 4 * PRE_ENTRIES, 4 * CHUNK_ENTRIES  # nothing else runs beside it that needs the memory
    spaced = re.compile(r" (?:\s|\Z)")

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return self.whole(text)
        if self.spaced.search(text):  # a space that doesn't belong to the word after it
            return b"".join(map(self.pre.__getitem__, self.cut.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.pre.__getitem__, self.cut.findall(first))) + b"".join(map(self.chunks.__getitem__, rest))


class WordEncoder(Encoder):
    """BPE with word ends: lower case, white space dropped."""

    cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


class PieceCounter:
    """Token counts of a SentencePiece BPE model: ``frequent`` is the broadcast table, misses go to the worker's cache."""

    def __init__(self, file: str, frequent: dict[str, int] | None = None):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=file)
        vocabulary = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        #: Marks that no piece joins to a letter before them: "word," has one token more than "word".
        self.marks = frozenset(m for m in _MARKS if m in vocabulary and not any(a.isalpha() and b == m for p in vocabulary for a, b in zip(p, p[1:], strict=False)))
        if any(a != "▁" and b == "▁" for p in vocabulary for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("this model has pieces that reach over a space; counts by pre-token would not be exact")
        self.lengths = Memo(self.miss, PRE_ENTRIES)
        self.frequent = frequent or {}

    def miss(self, piece: str) -> int:
        if (n := self.frequent.get(piece)) is not None:
            return n
        if piece[-1:] in self.marks and piece[:-1].isalpha():
            return self.lengths[piece[:-1]] + 1
        return len(self.library.encode(piece, num_threads=1)) if piece else 1  # alone, the space is a token

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """Pre-tokens without the space before each; a run of spaces stays with the word after it.  None: not separable."""
        if "▁" in text or "\0" in text:
            return None
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in re.findall(r" +[^ ]*", f" {text}")]

    def count(self, text: str) -> int:
        pieces = self.pieces(text)
        if pieces is None:
            return len(self.library.encode(text, num_threads=1))
        return sum(map(self.lengths.__getitem__, pieces))


@functools.cache
def byte_encoder(file: str) -> ByteEncoder:
    return ByteEncoder(file)


@functools.cache
def word_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)
