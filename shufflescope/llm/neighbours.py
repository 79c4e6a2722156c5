"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more component that makes them all equally long (Bachrach et al. 2014), so that the largest inner
product is the nearest vector.  Trees split at the median along the difference of two vectors; they are fitted on a
bounded sample, and then every vector is put into its leaf of every tree.  A query searches all trees through one
priority queue: a leaf's priority is the largest distance to a hyperplane that its path crosses on the far side, and
the ``leaves`` nearest leaves are opened.  As a child never comes before its parent, this order is a sort of the leaves
by priority, which numpy does for many queries at once.  Candidates of opened leaves are then ranked exactly.

How many leaves are opened is calibrated: the fewest that find ``TARGET`` of the true neighbours of ``PROBES`` sampled
queries among the sample.  Data without any structure need about half of all leaves, clustered data a few.

Equal vectors are searched once; of each only the ``k`` + 1 smallest vec_ids can be among k nearest, so no more are
kept and a vector that a third of all rows share costs as much as any other.  Leaves are dealt into blocks of one tree
with about ``PART_BYTES`` of vectors, and a block that has more is cut into parts.  A task holds the vectors of one part at a
time and the queries that open one of its leaves stream past them: a vector travels once for each tree, a query once
for each part that it opens, and neither number of a part's queries nor that of the table bounds what a task holds.

Null vec_ids, vectors that are null, zero, hold null or non-finite components, or are not of the most frequent
dimension (the smallest, if tied) take no part.  Of rows with equal vec_id and vector one counts.  Ties go to the
smaller vec_id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE, TREES, LEAF, TARGET, PROBES = 32_768, 8, 128, 0.96, 64
#: Bytes of a part's vectors in double precision, and queries that are ranked at a time.
PART_BYTES, CHUNK = 1 << 25, 1024


class Forest:
    """Trees of equal depth over the sample, in arrays: node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample) / leaf)))))
        inner = (1 << self.depth) - 1
        self.planes = np.zeros((trees, inner, sample.shape[1]))
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for node in range(inner):
                part = parts[node]
                if len(part) > 1:
                    a, b = sample[rng.choice(part, 2, replace=False)]
                    self.planes[t, node] = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                along = sample[part] @ self.planes[t, node]
                self.cuts[t, node] = np.median(along) if len(part) else 0.0
                parts += [part[along <= self.cuts[t, node]], part[along > self.cuts[t, node]]]

    @property
    def n_leaves(self) -> int:
        return 1 << self.depth

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered over all trees."""
        out = np.empty((len(vectors), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", vectors, self.planes[t][node])
                node = 2 * node + 1 + (along > self.cuts[t][node])
            out[:, t] = node - (self.n_leaves - 1) + t * self.n_leaves
        return out

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """Distance at which the shared queue reaches each leaf of all trees."""
        out = []
        for planes, cuts in zip(self.planes, self.cuts, strict=True):
            margin = queries @ planes.T - cuts
            cost = np.zeros((len(queries), 1))
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                nxt = np.empty((len(queries), 2 << level))
                nxt[:, 0::2] = np.where(m > 0, np.maximum(cost, np.abs(m)), cost)
                nxt[:, 1::2] = np.where(m > 0, cost, np.maximum(cost, np.abs(m)))
                cost = nxt
            out.append(cost)
        return np.concatenate(out, axis=1)

    def order(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(self.priorities(queries), axis=1, kind="stable")


def calibrate(forest: Forest, sample: np.ndarray, raw: np.ndarray, k: int, target: float) -> int:
    """Leaves to open so that ``target`` of the true neighbours among the sample are candidates."""
    if len(sample) <= k + 1:
        return forest.n_leaves * len(forest.planes)
    probes = np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int)
    scores = raw[probes] @ raw.T
    scores[np.arange(len(probes)), probes] = -np.inf
    nearest = np.argpartition(-scores, k, axis=1)[:, :k]
    queries = np.concatenate([raw[probes], np.zeros((len(probes), 1))], axis=1)
    place = np.argsort(forest.order(queries), axis=1)
    leaves = forest.leaf(sample)
    first = np.stack([place[i][leaves[nearest[i]]].min(axis=1) for i in range(len(probes))])
    return int(np.sort(first, axis=None)[min(first.size - 1, int(np.ceil(target * first.size)))]) + 1


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _kind(vectors: DataFrame) -> str:
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


class Part:
    """The vectors of a part by leaf; ``parts`` are (ids, vectors, leaves)."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        ids, vectors, leaves = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(leaves, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.leaves, self.starts = np.unique(leaves[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))

    def best(self, queries: np.ndarray, opened: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of each query among the leaves that it opens: ``opened`` of query ``of``."""
        score, who = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64)
        order = np.argsort(opened, kind="stable")
        opened, of = opened[order], of[order]
        for leaf, a, z in zip(self.leaves.tolist(), self.starts.tolist(), self.ends.tolist(), strict=True):
            at = of[slice(*np.searchsorted(opened, [leaf, leaf + 1]))]
            if len(at):
                s = np.concatenate([score[at], queries[at] @ self.vectors[a:z].T], axis=1)
                w = np.concatenate([who[at], np.broadcast_to(self.ids[a:z], (len(at), z - a))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                score[at], who[at] = np.take_along_axis(s, top, 1), np.take_along_axis(w, top, 1)
        i, j = np.nonzero(np.isfinite(score))
        return i, who[i, j], score[i, j]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (single precision, if it is given so, else double) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{_kind(vectors)}>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0].d if sizes else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row for which ``is_query`` (a Column) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("query", F.coalesce(is_query, F.lit(False))).dropDuplicates(["vec_id", "vector"])
    rows = materialize(rows.withColumn("key", F.xxhash64("vector")), "vectors")
    by_vector = Window.partitionBy("key", "vector").orderBy("vec_id")
    copies = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    copies = materialize(copies.select("key", "vector", "vec_id", "n"), "vector-copies")
    distinct = copies.where("n = 1").select(F.col("vec_id").alias("rep"), "vector")
    asked = rows.where("query")
    # of the copies of a query's vector the smallest vec_id names the search
    search = asked.select("key", "vector").distinct().join(copies.where("n = 1").select("key", "vector", F.col("vec_id").alias("asker")), ["key", "vector"])
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most")).first()
    n_search = search.count()
    if not stats.n or not n_search:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = float(stats.most)
    lengthen = lambda m: np.concatenate([m, np.sqrt(np.maximum(0, longest - (m * m).sum(axis=1)))[:, None]], axis=1)

    sample = np.array([r.vector for r in distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()])
    forest = Forest(lengthen(sample))
    opened = calibrate(forest, lengthen(sample), sample, k, target)
    most = max(1, PART_BYTES // (8 * sample.shape[1]))
    per_tree = max(1, min(forest.n_leaves, stats.n // most))  # blocks of a tree
    shared = spark.sparkContext.broadcast(forest)  # at most 2 * SAMPLE / LEAF planes a tree
    kind = _kind(vectors)
    form = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("asks", pa.bool_()), ("id", pa.int64()), ("vector", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("leaves", pa.list_(pa.int64()))])
    ddl = f"block long, part long, asks boolean, id long, vector array<{kind}>, leaves array<long>"

    def block(leaves):
        return leaves // forest.n_leaves * per_tree + leaves % forest.n_leaves * per_tree // forest.n_leaves

    def blocks_of(batches):
        for b in batches:
            found, n = np.unique(block(shared.value.leaf(lengthen(_matrix(b.column(0))))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["block", "n"])

    # at most TREES * n_leaves rows
    sizes = distinct.select("vector").mapInArrow(blocks_of, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(len(forest.planes) * per_tree, np.int64)
    for r in sizes:
        parts[r.block] = -(-r.n // most)

    def place(batches):
        for b in batches:
            leaves = shared.value.leaf(lengthen(_matrix(b.column(1)))).ravel()
            take = np.repeat(np.arange(b.num_rows), len(forest.planes))
            ids, of = b.column(0).to_numpy()[take], block(leaves)
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[of]
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32)), pa.array(leaves))
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(part), pa.array(np.zeros(len(of), bool)), pa.array(ids), b.column(1).take(pa.array(take)), each], schema=form)

    def ask(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                m = _matrix(b.column(1))
                first = np.sort(shared.value.order(np.concatenate([m, np.zeros((len(m), 1))], axis=1))[:, :opened], axis=1)
                take, of, part, leaves = [], [], [], []
                for i, mine in enumerate(first):
                    found, starts = np.unique(block(mine), return_index=True)  # blocks rise with leaves
                    for j, own in zip(found.tolist(), np.split(mine, starts[1:]), strict=True):
                        for p in range(parts[j]):
                            take.append(i)
                            of.append(j)
                            part.append(p)
                            leaves.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(part, pa.int64()), pa.array([True] * len(of)), b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array(leaves, pa.list_(pa.int64()))], schema=form)

    def rank(batches):
        """Of each part first the vectors, which are kept, then the queries, as many as there are."""
        at, held, now = None, [], None
        for b in batches:
            of, part, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero((of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                if (of[a], part[a]) != at:
                    at, held, now = (of[a], part[a]), [], None
                if not asks[a]:
                    some = b.slice(a, z - a)
                    held.append((some.column(3).to_numpy(), _matrix(some.column(4)), some.column(5).flatten().to_numpy()))
                    continue
                now = now or (Part(held) if held else None)
                for c in range(a, z, CHUNK) if now else ():
                    some = b.slice(c, min(CHUNK, z - c))
                    lists = some.column(5)
                    i, who, score = now.best(_matrix(some.column(4)), lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), k + 1)
                    yield pa.RecordBatch.from_arrays([some.column(3).take(pa.array(i)), pa.array(who), pa.array(score)], names=["asker", "rep", "score"])

    asked_leaves = search.select("asker", "vector").repartition(max(1, min(n_search // 512, 512)), "asker").mapInArrow(ask, ddl)
    met = distinct.mapInArrow(place, ddl).union(asked_leaves).repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    ranked = met.mapInArrow(rank, "asker long, rep long, score double")
    ranked = ranked.groupBy("asker", "rep").agg(F.max("score").alias("score"))  # one vector, from several trees
    first = Window.partitionBy("asker").orderBy(F.desc("score"), "rep")
    found = ranked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")

    names = copies.select("key", "vector", F.col("vec_id").alias("copy"))
    rep_of = copies.where("n = 1").select("key", "vector", F.col("vec_id").alias("rep"))
    members = names.join(rep_of, ["key", "vector"]).select("rep", "copy")
    best = found.join(members, "rep").select("asker", "copy", "score")
    # every query looks through the k + 2 best of its vector, itself among them or not
    top = Window.partitionBy("asker").orderBy(F.desc("score"), "copy")
    best = best.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    queries = asked.join(rep_of.withColumnRenamed("rep", "asker"), ["key", "vector"]).select(F.col("vec_id").alias("query_id"), "asker")
    out = queries.join(best, "asker").where("copy != query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "copy")
    out = out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("copy").alias("vec_id"), "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
