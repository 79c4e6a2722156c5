"""Exact substring dedup: every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes.

Of all suffixes only anchors are compared.  For each start s the anchor is the place of the least 32-byte hash among
the ``SPREAD`` places from s (the last, if tied), so equal strings have their anchor at equal distance, and neighbouring
starts mostly share one: some 64 bytes lie between anchors.  The starts of an anchor form an interval.

- key: hash of the bytes from the anchor that all strings of its starts hold.  A key seen once rules them all out.
- context: 64-bit hash of everything that the strings of its starts hold.  Seen twice under a key, all its starts
  repeat; key and context are 128 bits together, as one key may have a context for each document.
- Where a key has several contexts (at the ends of repeated passages), one anchor of each context and every anchor
  whose context is unique name the hash of each of their starts' strings; a hash under two contexts repeats.

So the intervals of the suffix order that matter, those at least ``LENGTH`` deep with two members, are found by three
groupings, each by a hash with partial sums, instead of one pass a byte of depth; README says why shard
Burrows-Wheeler transforms are not merged on the main path, and ``bwt`` has them.

Null texts count as empty.  Each input row is a document of its own, so repeated rows repeat each other's strings.
Texts under ``LENGTH`` bytes lose nothing.  A null doc_id is a value of its own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_dedup import gear
from .common import documents, materialize, record_batch, small_batches

LENGTH, SPREAD = 400, 128
_NULL = np.iinfo(np.int64).max
#: doc keys of 16 bytes that may be broadcast: some 10 MB.
BROADCAST_KEYS = 500_000
_ANCHORS = pa.schema([("k", pa.int64()), ("e", pa.int64()), ("doc", pa.int64()), ("th", pa.int32()), ("idx", pa.int32())])
_STARTS = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("e", pa.int64()), ("doc", pa.int64()), ("th", pa.int32()), ("s", pa.int32()), ("ask", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("spans", pa.string())])


def anchors(raw: bytes, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and last of the starts of each; ``spread`` is a power of two."""
    starts = len(raw) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    h = gear(np.frombuffer(raw, np.uint8))[31 : starts + spread + 30].astype(np.uint64)
    least = h << np.uint64(32) | (np.uint64(2**32 - 1) - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span < spread:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    place = 2**32 - 1 - (least & np.uint64(2**32 - 1)).astype(np.int64)
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate(([0], change))
    return place[first], first, np.concatenate((change - 1, [starts - 1]))


def _names(raw: bytes, a: int, lo: int, hi: int) -> tuple[int, int]:
    """key and context of an anchor."""
    key = xxhash.xxh3_64_intdigest(raw[a : a + LENGTH - SPREAD + 1])
    return key, xxhash.xxh3_64_intdigest(raw[lo : hi + LENGTH], seed=(a - lo) << 16 | (hi - a))


def _slices(batches, rows: int = 256):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _raw(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _anchor_rows(batches):
    for b in _slices(batches):
        ks, es, docs, ths, idx = [], [], [], [], []
        for doc, raw, th in zip(b.column(0).to_pylist(), _raw(b.column(1)), b.column(2).to_pylist(), strict=True):
            found = list(zip(*(x.tolist() for x in anchors(raw)), strict=True))
            for i, (a, lo, hi) in enumerate(found):
                k, e = _names(raw, a, lo, hi)
                ks.append(k)
                es.append(e)
                idx.append(i)
            docs += [doc] * len(found)
            ths += [th] * len(found)
        if ks:
            yield record_batch(_ANCHORS, *(np.array(x, np.uint64).view(np.int64) for x in (ks, es)), docs, ths, idx)


def _start_rows(batches):
    """Hashes of the strings of the asked anchors (column 3) and of the representatives (column 4)."""
    for b in _slices(batches, 32):
        h, es, docs, ths, ss, asked = [], [], [], [], [], []
        for doc, raw, th, ask, rep in zip(b.column(0).to_pylist(), _raw(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            places = [x.tolist() for x in anchors(raw)]
            for i, own in [*((i, True) for i in ask), *((i, False) for i in rep)]:
                a, lo, hi = (x[i] for x in places)
                k, e = _names(raw, a, lo, hi)
                n = hi - lo + 1
                h += [xxhash.xxh3_128_digest(raw[s : s + LENGTH]) for s in range(lo, hi + 1)]
                es += [(k ^ e) >> 1] * n
                docs += [doc] * n
                ths += [th] * n
                ss += range(lo, hi + 1)
                asked += [own] * n
        if h:
            digests = np.frombuffer(b"".join(h), np.dtype([("h1", "<i8"), ("h2", "<i4"), ("unused", "<i4")]))
            yield record_batch(_STARTS, digests["h1"], digests["h2"], es, docs, ths, ss, asked)


def covered(n: int, starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the given intervals (first, last)."""
    if not starts:
        return []
    edge = np.zeros(n + 1, np.int64)
    lo, hi = np.array(starts).T
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(change[0::2], change[1::2], strict=True))


def _result(batches):
    for b in _slices(batches):
        rows = []
        for doc, raw, whole, single in zip(b.column(0).to_pylist(), _raw(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            starts = [(s, s) for s in single or ()]
            if whole:
                _, lo, hi = (x.tolist() for x in anchors(raw))
                starts += [(lo[i], hi[i]) for i in whole]
            runs, digest, upto = covered(len(raw), starts), hashlib.sha256(), 0
            for x, y in runs:
                digest.update(raw[upto:x])
                upto = y
            digest.update(raw[upto:])
            rows.append((None if doc == _NULL else doc, len(raw), sum(y - x for x, y in runs), len(runs), digest.hexdigest(), ",".join(f"{x}:{y}" for x, y in runs)))
        yield record_batch(_OUT, *zip(*rows, strict=True))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start:end in bytes) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NULL))).alias("doc"), text.alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)).cast("int"))

    found = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchor_rows, "k long, e long, doc long, th int, idx int")
    # what is grouped is written before it is joined, so that the rows of a hot key can be split in the join
    keys = found.groupBy("k").agg(F.count("*").alias("n"), F.min("e").alias("least"), F.max("e").alias("most")).where("n > 1")
    keys = materialize(keys.select("k", (F.col("least") < F.col("most")).alias("several")), "keys")
    shared = materialize(found.join(keys, "k"), "shared-anchors")
    place = F.xxhash64("doc", "th", "idx")
    contexts = materialize(shared.groupBy("k", "e").agg(F.count("*").alias("c"), F.min(place).alias("first")), "contexts")
    alone, several = F.col("c") == 1, F.col("several")
    flags = shared.join(contexts, ["k", "e"]).select(
        "doc", "th", "idx", (~alone).alias("whole"), (alone & several).alias("ask"), (~alone & several & (F.col("first") == place)).alias("rep")
    )
    pick = lambda c: F.collect_set(F.when(F.col(c), F.col("idx"))).alias(c)
    flags = materialize(flags.groupBy("doc", "th").agg(pick("whole"), pick("ask"), pick("rep")), "anchor-flags")  # at most a document's own anchors

    fine = flags.where("size(ask) > 0 or size(rep) > 0").select("doc", "th", "ask", "rep")
    if fine.count() <= BROADCAST_KEYS:
        rows_fine = rows.join(F.broadcast(fine.select("doc", "th")), ["doc", "th"], "left_semi").join(fine, ["doc", "th"])
    else:
        rows_fine = rows.join(fine, ["doc", "th"])
    starts = rows_fine.select("doc", "text", "th", "ask", "rep").mapInArrow(_start_rows, "h1 long, h2 int, e long, doc long, th int, s int, ask boolean")
    starts = materialize(starts, "starts")
    twice = starts.groupBy("h1", "h2").agg(F.min("e").alias("least"), F.max("e").alias("most")).where("least != most").select("h1", "h2")
    twice = materialize(twice, "repeated-strings")
    single = starts.where("ask").join(twice, ["h1", "h2"]).groupBy("doc", "th").agg(F.collect_set("s").alias("single"))

    marks = materialize(flags.where("size(whole) > 0").select("doc", "th", "whole").join(single, ["doc", "th"], "full"), "marks")
    out = rows.join(marks, ["doc", "th"], "left").select("doc", "text", "whole", "single")
    return out.mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir)).drop("spans")
