"""Vectorised 64-bit hashes of words and word n-grams over many documents at once (numpy only)."""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: As _SEP, with ASCII punctuation, so that "word," is "word".
_MARKED = _SEP.copy()
_MARKED[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Weights of the words of an n-gram, in order; odd, so no word is lost, and without sums in common: a b b a is not b a a b.
_WEIGHTS = mix((np.arange(16, dtype=U64) + U64(501)) * U64(_RADIX)) | U64(1)


@functools.cache
def _byte_table() -> np.ndarray:
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(_RADIX))


_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 1 << 16)
        _pow = np.full(m, _RADIX, U64)
        _inv = np.full(m, pow(_RADIX, -1, 2**64), U64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.multiply.accumulate(_pow), np.multiply.accumulate(_inv)
    return _pow, _inv


def words(texts: list[str], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts and each text's word count.

    A-Z are lower-cased; words end at the space and at the characters 9 to 13, with ``marks`` at punctuation too.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(buf):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    sep = (_MARKED if marks else _SEP)[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]  # the buffer ends in a separator, so each word has an end
    power, inverse = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_byte_table()[_LOWER[buf]] * power[: len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0)


def ngrams(hashes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the words at the given offsets for each position at which all of them exist (ignoring document ends)."""
    n = max(0, len(hashes) - max(offsets))
    out = np.full(n, len(offsets) * 0x51ED2701 + sum(o << (4 * i) for i, o in enumerate(offsets)) & (2**63 - 1), U64)
    for i, o in enumerate(offsets):
        out += hashes[o : o + n] * _WEIGHTS[i]
    return mix(out)


def shingles(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; fewer than k words: the whole sequence as one; none: empty."""
    hashes, counts = words(texts)
    grams = ngrams(hashes, list(range(k)))
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        elif n:
            whole = ngrams(hashes[at : at + n], list(range(n)))
            out.append(whole[:1])
        else:
            out.append(np.empty(0, U64))
        at += n
    return out
