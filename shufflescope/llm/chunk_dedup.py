"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last 16 bytes is the least of any ``MOST`` neighbouring places (the last, if
tied), so chunks have ``LEAST`` to ``MOST`` bytes, some 28 on average.  A cut depends on the bytes around it alone: an
insertion shifts chunks only next to it, and a shared passage has the same cuts but for its first MOST + 15 and last
MOST - 1 bytes at most, whatever surrounds it.  Only where a short period repeats, ties are thinned out to some
``THIN`` bytes from its start (a chunk beside them may be longer by as much).  Chunks are deduplicated by a 96-bit digest: the first occurrence stays (smallest
doc_id, then position), later ones are repeats.  Only runs of neighbouring repeats of ``RUN`` bytes or more are
removed, as short chunks of common words recur by chance, and documents of which every chunk repeats.

All places of a digest but the first are known to repeat within a slice of documents already, and go anywhere; so a
passage in a third of all documents sends one row a slice to the task that finds the first of all.

Null texts count as empty.  Rows with equal doc_id and text are one document with repeated output; rows of one doc_id
with different texts are told apart by a hash of the text.  A null doc_id comes after all others.  Each input row gives
one row; an empty table gives an empty result; extra columns are ignored, and kept by ``dedup_texts``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import doc_batches, documents, record_batch, text_rows

LEAST, MOST, THIN, RUN = 1, 64, 24, 128
_NULL = np.iinfo(np.int64).max
_CHUNKS = pa.schema([("d1", pa.int64()), ("d2", pa.int32()), ("doc", pa.int64()), ("text_hash", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("n_bytes", pa.int32()), ("again", pa.bool_())])


_DIGEST = np.dtype([("d1", "<i8"), ("d2", "<i4"), ("unused", "<i4")])


def text_hash(raw: bytes) -> int:
    """31 bits that tell texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(raw) >> 33


@functools.cache
def _gear() -> np.ndarray:
    return (wordhash.mix(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray, spans: tuple[int, ...] = (1, 2, 4, 8, 16)) -> np.ndarray:
    """Gear hash after each byte: the sum of the table's entries of the last 32 bytes, shifted by their distance.

    With fewer ``spans`` it is that of fewer bytes: their sum and one.
    """
    h = _gear()[data]
    for span in spans:
        h[span:] += h[:-span] << np.uint32(span)
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks."""
    if len(text) < MOST:
        return [len(text)] if text else []
    h = gear(np.frombuffer(text, np.uint8), (1, 2, 4, 8))
    least = h.astype(np.uint64) << np.uint64(32) | (np.uint64(2**32 - 1) - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span < MOST:  # a power of two
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    place = 2**32 - 1 - (least & np.uint64(2**32 - 1)).astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))]
    tied = np.concatenate(([False], (h[place[1:]] == h[place[:-1]]) & (np.diff(place) < THIN)))
    if tied.any():
        step = (place - np.maximum.accumulate(np.where(tied, 0, place))) // THIN
        place = place[~tied | np.concatenate(([True], step[1:] != step[:-1]))]
    ends = (place + 1).tolist()
    return ends if ends[-1] == len(text) else [*ends, len(text)]


def _again(d1, d2, docs, hashes, starts) -> np.ndarray:
    """Which of the chunks come after another place of their digest in these arrays."""
    again = np.zeros(len(d1), bool)
    order = np.argsort(d1, kind="stable")
    same = d1[order[1:]] == d1[order[:-1]]
    some = order[np.append(same, False) | np.append(False, same)]
    if len(some):
        some = some[np.lexsort([x[some] for x in (starts, hashes, docs, d2, d1)])]
        new = np.append(True, (d1[some[1:]] != d1[some[:-1]]) | (d2[some[1:]] != d2[some[:-1]]))
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        again[some] = (docs[some] != docs[first]) | (hashes[some] != hashes[first]) | (starts[some] != starts[first])
    return again


def _chunks(batches):
    for ids, texts in doc_batches(batches):
        d1, d2, docs, hashes, starts, lengths, sizes = [], [], [], [], [], [], []
        for i, t in zip(ids, texts, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            ends = cuts(raw)
            at = [0, *ends[:-1]]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at, ends, strict=False)), _DIGEST)
            d1.append(digests["d1"])
            d2.append(digests["d2"])
            docs.append(np.full(len(ends), _NULL if i is None else i))
            hashes.append(np.full(len(ends), text_hash(raw), np.int32))
            starts += at[: len(ends)]
            lengths += (np.diff(ends, prepend=0)).tolist()
            sizes.append(np.full(len(ends), len(raw), np.int32))
        if starts:
            keys = [*(np.concatenate(x) for x in (d1, d2, docs, hashes)), np.array(starts, np.int32)]
            yield record_batch(_CHUNKS, *keys, lengths, np.concatenate(sizes), _again(*keys))


def _sizes(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int32()), ("n_bytes", pa.int64())])
    for ids, texts in doc_batches(batches):
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        yield record_batch(schema, ids, [text_hash(r) for r in raws], [len(r) for r in raws])


def _runs(spans, n_bytes):
    """Neighbouring (start, length) repeats merged, only runs of RUN bytes or more or of all the document's bytes.

    ``spans`` are sorted and apart, so a run begins where the span before ends earlier, and ends where the next begins
    later: the k-th begin and the k-th end make a run, without a fold over the spans.
    """
    begins = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["start"] + F.get(spans, i - 1)["length"] != s["start"]))
    ends = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] != s["start"] + s["length"]))
    runs = F.zip_with(begins, ends, lambda b, e: F.struct(b["start"].alias("start"), (e["start"] + e["length"]).alias("end")))
    return F.filter(runs, lambda r: (r["end"] - r["start"] >= RUN) | (r["end"] - r["start"] == n_bytes))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc (the largest long: null), text_hash, runs (start, end in bytes) of each document with something to remove."""
    chunks = text_rows(docs).mapInArrow(_chunks, "d1 long, d2 int, doc long, text_hash int, start int, length int, n_bytes int, again boolean")
    place = F.struct("doc", "text_hash", "start")
    # what is known to repeat goes anywhere
    overall = Window.partitionBy("d1", "d2", F.when(F.col("again"), F.xxhash64("doc", "start"))).orderBy(place)
    chunks = chunks.withColumn("again", F.col("again") | (place != F.first(place).over(overall))).where("again")
    # a document's repeats are at most its own chunks
    spans = chunks.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.first("n_bytes").alias("n_bytes"))
    return spans.select("doc", "text_hash", _runs("spans", F.col("n_bytes")).alias("runs")).where(F.size("runs") > 0)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and spans (start:end in bytes, comma-joined) of each row of ``docs``."""
    sizes = text_rows(docs).mapInArrow(_sizes, "doc_id long, text_hash int, n_bytes long").withColumn("doc", F.coalesce("doc_id", F.lit(_NULL)))
    out = sizes.join(repeated_runs(docs), ["doc", "text_hash"], "left")
    runs = F.coalesce("runs", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    said = F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(runs).cast("long").alias("n_spans"), said.alias("spans"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; bytes of a character that a run splits go with the run."""
    runs = repeated_runs(docs).withColumnsRenamed({"doc": "_ss_doc", "text_hash": "_ss_hash", "runs": "_ss_runs"})
    at, names = docs.columns.index("text"), docs.columns

    def hashed(batches):
        for b in batches:
            hashes = [text_hash((t or "").encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.int32())], names=[*names, "_ss_hash"])

    def cut(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, found in enumerate(b.column(len(names)).to_pylist()):
                if found:
                    raw, upto, kept = texts[i].encode("utf-8", "surrogatepass"), 0, []
                    for r in found:
                        kept.append(raw[upto : r["start"]])
                        upto = r["end"]
                    texts[i] = b"".join([*kept, raw[upto:]]).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(names)])], names=names)

    keyed = docs.mapInArrow(hashed, T.StructType([*docs.schema, T.StructField("_ss_hash", T.IntegerType())]))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)) == F.col("_ss_doc")) & (keyed["_ss_hash"] == runs["_ss_hash"])
    met = keyed.join(runs, same, "left").select(*(keyed[c] for c in names), "_ss_runs")
    return met.mapInArrow(cut, docs.schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir))
