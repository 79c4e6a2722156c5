"""Packing into fixed windows by best-fit decreasing.

A document's ids (and an end id) are cut into full windows first; what remains of each document is packed.  Pieces are
dealt by a hash of their document into bins of about ``BIN_PIECES`` pieces, so no task grows with the corpus; of pieces
that are equal in all of doc_id, start and checksum more than that are dealt one by one.  In a bin
the pieces come longest first, and a segment tree indexed by remaining capacity finds the tightest open window that
still holds the piece: O(log window) each.  Bins of this size already leave well under a percent of padding.
sequence_id is the bin's number times 2^32 plus the sequence's number in the bin: unique without a global count.

Null texts count as empty (the end id alone).  Repeated rows and null ids are packed like any other; an empty table
gives an empty result; extra columns are ignored.  Ties in length are broken by doc_id, start and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_batches, documents, materialize, record_batch, text_rows
from .encoders import path_of, word_encoder

WINDOW, END_ID, BIN_PIECES = 4096, 2, 4096
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """How many open windows have each remaining capacity, as a segment tree; finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least ``length``, and that capacity."""
        counts, at = self.counts, length + self.size
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):  # climb until something lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; the lengths must be in falling order and at most ``window``."""
    tree, out, n = CapacityTree(window), [], 0
    for length in lengths:
        if (found := tree.take(length)) is None:
            found, n = (n, window), n + 1
        sequence, capacity = found
        out.append((sequence, window - capacity))
        if capacity > length:
            tree.put(capacity - length, sequence)
    return out


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows and the remainder of each document, with the checksum of their ids."""
    file = vocabulary or path_of("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = word_encoder(file)
        for ids, texts in doc_batches(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                got = encoder.encode(t) + end
                for a in range(0, len(got), 4 * window):
                    part = got[a : a + 4 * window]
                    rows.append((i, a // 4, len(part) // 4, zlib.crc32(part), len(got) // 4))
            yield record_batch(_PIECES, *zip(*rows, strict=True))

    return text_rows(docs).mapInArrow(cut, _PIECE_DDL)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset in it."""
    rows = pieces(docs, vocabulary, window, end_id).withColumn("_row", F.monotonically_increasing_id())
    cut = materialize(rows, "pieces")  # so that texts are encoded once and a row keeps its number
    n_bins = max(1, -(-cut.count() // bin_pieces))

    def fill(table: pa.Table) -> pa.Table:
        rows = table.select(_PIECES.names).to_pylist()
        first = int(table["_bin"][0].as_py()) << 32
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
        for r, (s, o) in zip(rows, best_fit_decreasing([r["length"] for r in rows], window), strict=True):
            r |= {"sequence_id": first + s, "offset": o}
        return pa.Table.from_pylist(rows, schema=_PACKED)

    # the checksum deals repeated ids and null ids over several bins, the row's number what is equal
    name = ["doc_id", "start", "ids_crc32"]
    many = cut.groupBy(*name).agg(F.count("*").alias("c")).where(F.col("c") > bin_pieces).withColumnsRenamed({n: f"_{n}" for n in name})
    if many.isEmpty():
        salt = F.lit(None).cast("long")
    else:
        same = F.lit(True)
        for n in name:
            same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
        cut, salt = cut.join(many, same, "left"), F.when(F.col("c").isNotNull(), F.col("_row"))
    dealt = cut.withColumn("_bin", F.pmod(F.xxhash64(*name, salt), F.lit(n_bins))).select(*_PIECES.names, "_bin")
    return dealt.groupBy("_bin").applyInArrow(fill, f"{_PIECE_DDL}, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
