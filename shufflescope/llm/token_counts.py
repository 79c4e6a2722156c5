"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a broadcast table of the lengths of frequent pre-tokens.  It is found over all documents: each task keeps
a lossy count of its own pre-tokens and hands on its most frequent ``PER_TASK``; those few rows are summed, and the
``TABLE`` most frequent make the table, whose size is thereby bounded.  Tier two is a bounded cache in each Python
worker, filled by the library itself.  The table only saves time: counts are the library's whatever it holds.

Null texts count as empty (0 bytes, 0 tokens).  Each input row gives one row, repeated rows and null ids included; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_batches, documents, record_batch, text_rows
from .encoders import LONGEST_KEY, PieceCounter, path_of

#: Rows that a task hands on, entries of its count at most, and entries of the broadcast table.
PER_TASK, KEPT, TABLE = 2048, 200_000, 16_384
_COUNTS = pa.schema([("piece", pa.string()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _frequent(batches):
    seen: Counter[str] = Counter()
    for _, texts in doc_batches(batches):
        for t in texts:
            seen.update(PieceCounter.pieces(t) or ())
        if len(seen) > KEPT:  # lossy counting: what is rare so far goes
            seen = Counter(dict(seen.most_common(KEPT // 4)))
    top = [(p, n) for p, n in seen.most_common(PER_TASK) if len(p) <= LONGEST_KEY and n > 1]
    if top:
        yield record_batch(_COUNTS, *zip(*top, strict=True))


def frequent_pieces(docs: DataFrame, table: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of the whole corpus, ``table`` at most."""
    rows = text_rows(docs).select("doc_id", "text").mapInArrow(_frequent, "piece string, n long")
    top = rows.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table)
    return [r.piece for r in top.collect()]


@functools.lru_cache(2)
def _counter(file: str, key: int) -> PieceCounter:
    """The worker's library and caches outlive a task."""
    return PieceCounter(file)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each row of ``docs``."""
    spark = docs.sparkSession
    file = model or path_of("piece_bpe_32k.model")
    pieces = frequent_pieces(docs)
    counter = PieceCounter(file)
    lengths = spark.sparkContext.broadcast({p: counter.miss(p) for p in pieces})
    key = hash(tuple(pieces[:64]))

    def count(batches):
        counter = _counter(file, key)
        counter.frequent = lengths.value
        for ids, texts in doc_batches(batches):
            yield record_batch(_OUT, ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], [counter.count(t) for t in texts])

    out = text_rows(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
