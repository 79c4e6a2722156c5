"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the 32-bit hashes of its words, word pairs and pairs that skip a word (case and punctuation
aside); each counts once.  Training follows McMahan et al. (2013): per-coordinate rates and L1, so nearly all weights
are exactly zero.  The others make two short sorted arrays that are broadcast; their number is bounded by what the
bounded training sample holds.  Scoring is one map over the documents, without a shuffle.

Learning: rows with a label whose crc32(doc_id as text) mod ``FOLDS`` is not 0; of these the ``TRAIN_DOCS`` with the
smallest hash of their id, and of those in the order of another hash as many as have ``TRAIN_FEATURES`` features
together: a sample bounded in rows and bytes.  One task learns from it and hands on the weights that are not zero;
the driver sees no feature of a text.  labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no features and get the bias alone.  A null doc_id is never learned from and is not held
out.  Labels that are null, name no document or repeat are harmless: a repeated label counts once, and contradicting
ones as toxic.  Without any usable label every score is 0.5 less a hair, so predicted is 0.  Each input row gives one
row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import doc_batches, documents, record_batch, small_batches, text_rows

FOLDS, TRAIN_DOCS, EPOCHS = 5, 6000, 4
#: Features (4 bytes) of all documents learned from.
TRAIN_FEATURES = 25_000_000
ALPHA, BETA, L2 = 1.0, 1.0, 1.0
#: L1 is this times the root of the number of documents, as the noise in a coordinate grows; weight of a toxic document.
L1_RATE, POSITIVE = 0.2, 4.0
#: Offsets of the words of a feature: words, pairs, pairs that skip one.
GRAMS = ((0,), (0, 1), (0, 2))
_FEATURES = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])
_MODEL = pa.schema([("columns", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 32-bit feature) of all texts, unsorted, repeats included."""
    hashes, counts = wordhash.words(texts, marks=True)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    docs, found = [], []
    for offsets in GRAMS:
        grams = wordhash.ngrams(hashes, list(offsets))
        inside = of[: len(grams)] == of[offsets[-1] :]
        docs.append(of[: len(grams)][inside])
        found.append((grams[inside] >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(docs), np.concatenate(found)


class Ftrl:
    """FTRL-proximal with a bias that carries no penalty; ``columns`` are the features it has seen, sorted."""

    def __init__(self, columns: np.ndarray, l1: float):
        self.columns, self.l1 = columns, l1
        self.z, self.n = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1, l2 = np.where(at == len(self.columns), 0.0, self.l1), np.where(at == len(self.columns), 0.0, L2)
        rate = (BETA + np.sqrt(n)) / ALPHA + l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        error = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1.0)
        square = error * error
        n = self.n[at]
        self.z[at] += error - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + square

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Features with weights that are not zero, their weights, the bias."""
        w = self.weights(np.arange(len(self.columns) + 1))
        keep = np.flatnonzero(w[:-1])
        return self.columns[keep], w[keep], float(w[-1])


def train(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """From (distinct features, label) of each document, in the order given."""
    if not rows:
        return np.empty(0, np.uint32), np.empty(0), -1e-9
    columns, counts = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True)
    columns = columns[counts > 1]  # a feature of one document teaches nothing about others
    model = Ftrl(columns, L1_RATE * len(rows) ** 0.5)
    inputs = []
    for f, label in rows:
        at = np.minimum(np.searchsorted(columns, f), max(0, len(columns) - 1))
        inputs.append((np.append(at[columns[at] == f] if len(columns) else [], len(columns)).astype(np.int32), label))
    for _ in range(EPOCHS):
        for at, label in inputs:
            model.learn(at, label)
    return model.sparse()


def fold(doc_id):
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("_toxic"))
    known = known.where("_id is not null and _toxic is not null").where(fold("_id") != 0).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(train_docs)  # at most train_docs rows of two numbers, so it may be broadcast

    def extract(batches):
        for ids, texts in doc_batches(batches):
            of, found = features(texts)
            for k, i in enumerate(ids):
                yield record_batch(_FEATURES, [i], [np.unique(found[of == k]).tobytes()])

    taught = text_rows(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = taught.select("doc_id", "text").mapInArrow(extract, "doc_id long, features binary")

    def learn(batches):
        got, n = [], 0
        for b in batches:
            for doc, label, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                got.append((doc * 0x9E3779B97F4A7C15 % 2**64, doc, np.frombuffer(f.as_buffer(), np.uint32).copy(), label))
        rows = []
        for _, _, f, label in sorted(got, key=lambda r: (r[0], r[1], r[2].tobytes())):
            n += len(f)
            if n > TRAIN_FEATURES:
                break
            rows.append((f, label))
        columns, weights, bias = train(rows)
        yield record_batch(_MODEL, [columns.tobytes()], [weights.tobytes()], [bias])

    labelled = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "_toxic", "features")
    # at most train_docs rows, dealt to one task; a sparse model comes back
    model = labelled.repartition(1).mapInArrow(learn, "columns binary, weights binary, bias double").first()
    if model is None:
        return train([])
    return np.frombuffer(model.columns, np.uint32), np.frombuffer(model.weights), model.bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        columns, weights, bias = shared.value
        for ids, texts in doc_batches(batches):
            yield record_batch(_SCORES, ids, scores(texts, columns, weights, bias))

    return text_rows(docs).mapInArrow(run, "doc_id long, score double")


def scores(texts: list[str], columns: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    if len(columns):
        of, found = features(texts)
        at = np.minimum(np.searchsorted(columns, found), len(columns) - 1)
        hit = columns[at] == found
        pairs = np.unique(of[hit] * len(columns) + at[hit])
        np.add.at(total, pairs // len(columns), weights[pairs % len(columns)])
    return 1 / (1 + np.exp(-total))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], column: str = "text") -> DataFrame:
    """The rows that the model does not take for toxic, with all their columns; null and empty texts have the bias alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(column)

    def keep(batches):
        columns, weights, bias = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                said = scores([t or "" for t in part.column(at).to_pylist()], columns, weights, bias)
                yield part.filter(pa.array(said < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
