"""Merging Burrows-Wheeler transforms of shards by iterative interleave refinement (Holt and McMillan 2014).

A shard's transform comes from its own suffix array.  Two transforms are merged without sorting their suffixes again:
an interleave says from which of them each row comes; starting from all of the first before all of the second, each
pass refines it by one more symbol, a stable sort of the rows by the symbol before them.  Rows that a pass tells apart
have the pass's number less one as longest common prefix, and rows still together after ``length`` passes repeat.

Exact, but a pass moves every row once, so ``length`` passes cost ``length`` moves a byte of text whatever repeats; it
serves for single shards and as a check of ``repeated_bytes``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Transform(NamedTuple):
    """Rows in suffix order: the symbol before each suffix (0: the string's end mark) and the suffix's place."""

    before: np.ndarray
    string: np.ndarray
    start: np.ndarray
    n_strings: int


def transform(strings: list[bytes], first_string: int = 0) -> Transform:
    """Of one shard, by prefix doubling; end marks are smaller than all bytes and ordered by string."""
    lengths = np.array([len(s) + 1 for s in strings])
    symbols = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + len(strings) + 1
    ends = np.cumsum(lengths) - 1
    symbols[ends] = np.arange(len(strings))
    string = np.repeat(np.arange(len(strings)), lengths)
    last = ends[string]
    rank, step, at = symbols, 1, np.arange(len(symbols))
    while True:
        after = np.where(at + step <= last, rank[np.minimum(at + step, len(symbols) - 1)], -1)
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0))))
        rank = np.empty_like(new)
        rank[order] = new
        if new[-1] == len(symbols) - 1:
            break
        step *= 2
    start = at - (ends - lengths + 1)[string]
    before = np.where(start[order] > 0, symbols[order - 1] - len(strings), 0).astype(np.uint16)
    return Transform(before, string[order] + first_string, start[order], len(strings))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The merged transform, right to ``depth`` symbols, and each row's common prefix with the row above, ``depth`` at most."""
    n = len(a.before) + len(b.before)
    marks = a.n_strings + b.n_strings
    of_b = np.zeros(n, bool)
    of_b[len(a.before) :] = True
    common = np.full(n, depth)
    common[0] = 0
    block = np.zeros(n, np.int64)
    before = np.empty(n, np.uint16)
    for passed in range(depth):
        before[~of_b], before[of_b] = a.before, b.before
        order = np.argsort(before, kind="stable")
        symbol, source = before[order], block[order]
        of_b = of_b[order]
        of_b[:marks] = np.arange(marks) >= a.n_strings  # end marks: those of the first transform come first
        apart = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])))
        apart[:marks] = True
        common = np.where(apart & (common > passed), passed, common)
        block = np.cumsum(apart)
    before[~of_b], before[of_b] = a.before, b.before
    string, start = np.empty(n, np.int64), np.empty(n, np.int64)
    for mine, t in ((~of_b, a), (of_b, b)):
        string[mine], start[mine] = t.string, t.start
    return Transform(before, string, start, marks), common


def repeated_starts(shards: list[list[bytes]], length: int) -> set[tuple[int, int]]:
    """(string, start) of each string of ``length`` bytes that also starts elsewhere in any shard."""
    merged, common, n = None, None, 0
    for shard in shards:
        t = transform(shard, n)
        n += len(shard)
        merged, common = (t, None) if merged is None else merge(merged, t, length)
    if merged is None:
        return set()
    if common is None:
        merged, common = merge(merged, Transform(*(x[:0] for x in merged[:3]), 0), length)
    deep = common >= length
    rows = np.flatnonzero(deep | np.append(deep[1:], False))
    return set(zip(merged.string[rows].tolist(), merged.start[rows].tolist(), strict=True))
