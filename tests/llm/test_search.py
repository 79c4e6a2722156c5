"""Nearest neighbours, decontamination and the pipeline against brute force."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shufflescope.llm import decontamination as dc
from shufflescope.llm import neighbours as nn
from shufflescope.llm.components import components
from shufflescope.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score double, query_id int"
DOCS = "doc_id long, text string, lang string, item_id string, n_windows string"


def brute_nearest(rows, k=20):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.asarray(v, np.float32).astype(float)
    sizes = Counter(map(len, usable.values()))
    if not sizes:
        return {}
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    usable = {i: v for i, v in usable.items() if len(v) == dim}
    out = {}
    for q, v in usable.items():
        if q % 20 == 0:
            found = sorted(((-float(v @ w), i) for i, w in usable.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def test_recall_and_edges_of_neighbours(spark):
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(1200, 16))
    vectors[300:700] = vectors[300]  # a third of all rows share one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [float("inf")] * 16), (5100, [1.0] * 3), (None, [1.0] * 16), rows[40]]
    frame = spark.createDataFrame([(i, v, 1, 0.0, 7) for i, v in rows], VECTORS)
    got = {}
    for r in nn.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = []
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {i for _, i, _ in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.float32(rows[q][1]).astype(float) @ np.float32(rows[i][1]).astype(float)), abs=1e-9)
        hits.append(len({i for _, i, _ in found} & {i for i, _ in want[q]}) / 20)
    assert np.mean(hits) >= 0.9
    few = spark.createDataFrame([(i, [float(i + 1), 1.0], 1, 0.0, 7) for i in range(0, 60, 20)], VECTORS)
    assert nn.nearest(few, F.col("vec_id") % 20 == 0).count() == 6
    assert nn.nearest(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op7_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want) and np.mean([len(got[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_priorities_are_those_of_a_shared_queue():
    import heapq

    rnd = np.random.default_rng(2)
    sample = rnd.normal(size=(512, 8))
    forest = nn.Forest(sample, trees=3, leaf=32)
    for q in rnd.normal(size=(5, 8)):
        heap, order = [(0.0, t, 0) for t in range(3)], []
        while heap:
            cost, t, node = heapq.heappop(heap)
            if node >= forest.n_leaves - 1:
                order.append(cost)
                continue
            m = q @ forest.planes[t, node] - forest.cuts[t, node]
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(heap, (cost, t, near))
            heapq.heappush(heap, (max(cost, abs(m)), t, far))
        p = forest.priorities(q[None])[0]
        assert np.allclose(np.sort(p), order)
        assert (forest.priorities(q[None])[0][forest.leaf(q[None])[0]] == 0).all()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(100) * 7, rnd.randrange(100) * 7) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_decontamination_finds_copies_and_new_parameters(spark):
    rnd = random.Random(5)
    plain = prose(rnd, 30)
    question = "If Anna has 12 apples and gives 5 to Tom while Anna walks 3 km each day how many apples does Anna keep at the end"
    changed = question.replace("Anna", "Maria").replace("Tom", "Igor").replace("12", "1,200.5").replace("3 km", "9 miles")
    mixed = question.replace("Anna has", "Maria has").replace("5", "7")
    items = [(1, plain), (2, question), (3, "too short to match"), (4, None), (None, prose(rnd, 20)), (1, plain), (5, "1 2 3 4 5 6 7 8 9 10 11 12")]
    rows = [(10, f"{prose(rnd, 40)}. {plain.upper().capitalize()} {prose(rnd, 5)}"), (11, f"{prose(rnd, 9)} {changed}"), (12, f"{prose(rnd, 9)} {mixed}"), (13, prose(rnd, 200)), (14, None), (15, ""), (None, plain), (16, "1 2 3 4 5 6 7 8 9 10 11 12"), (17, plain), (17, plain)]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in dc.contaminated(docs, bench).collect()}
    assert got.keys() == {(10, 1), (11, 2), (None, 1), (17, 1)} and got[11, 2] >= 4 and got[10, 1] == 0
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["12", "13", "14", "15", "16"]
    assert dc.contaminated(docs.where("false"), bench).count() == 0 and dc.contaminated(docs, bench.where("false")).count() == 0


def test_copies_of_short_and_number_heavy_items_are_found(spark):
    rnd = random.Random(6)
    items = {
        1: "What is 48 divided by 6?",
        2: "Who wrote Hamlet?",
        3: "法国的首都是哪里？",
        4: "Compute 12 + 7 * 3 - 4 / 2 + 9 when x = 5 and y = 8.",
        5: "Solve for x: 3x + 7 = 22, 5x - 4 = 21, 2x + 9 = 19.",
        6: "Convert 72 km/h, 36 km/h and 18 km/h to m/s.",
        7: "How many days are in 3 weeks?",
        8: "Albert Einstein",
    }
    other = {1: "What is 49 divided by 6?", 2: "Who wrote Macbeth?", 3: "德国的首都是哪里？", 4: items[4].replace("12", "13").replace("5", "6").replace("8", "9"), 5: "Solve for x: 3x - 9 = 12, 4x + 1 = 25, 6x + 2 = 18.", 8: "Albert Camus"}
    rows = [(i, f"{prose(rnd, 9)} {t} {prose(rnd, 9)}") for i, t in items.items()]
    rows += [(100 + i, f"{prose(rnd, 9)} {t} {prose(rnd, 9)}") for i, t in other.items()]
    rows += [(207, "How many days are in 5 weeks?"), (208, items[2]), (209, prose(rnd, 200))]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in dc.contaminated(docs, bench).collect()}
    assert got.keys() == {*((i, i) for i in items), (207, 7), (208, 2)}
    assert got[207, 7] == 1 and not any(got[i, i] for i in items)


def test_decontamination_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(dc, "BROADCAST_KEYS", 0)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(ORACLES["op6_decontamination"]).fetchall())
    got = sorted(tuple(r) for r in dc.contaminated(docs, bench).drop("text_hash").collect())
    assert got == want and got
    assert dc.drop_contaminated(docs, bench).count() == docs.count() - len({r[0] for r in got})


def test_pipeline_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "packing"]
    before = {r.doc_id for r in docs.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF)
        assert current.schema.names == docs.schema.names, name
        after = {r.doc_id for r in current.collect()}
        assert after <= before and after, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    assert {r.doc_id for r in packed.collect()} == before


def test_pipeline_stages_take_any_rows(spark):
    """No rows at all; and nulls, empty texts, repeated rows and a column whose name an operator uses."""
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    odd = spark.createDataFrame([(None, None, "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (6, "one two three", "x"), (6, "one two three", "x"), (7, "word " * 3000, "x")], "doc_id long, text string, score string")
    for docs, left in ((empty, set()), (odd, {None, 4, 5, 6, 7})):
        names = docs.schema.names
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.schema.names == names
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == left
        assert sum(r.doc_id == 6 for r in packed) == (1 if left else 0)


def test_decontamination_without_broadcasts_gives_the_same(spark, monkeypatch):
    """Large benchmarks are joined by a shuffle of keys and positions; one very long text, repeated rows, null ids."""
    rnd = random.Random(8)
    item = "If Anna buys 3 apples for 2 dollars each day how many apples does Anna keep at the end of 5 days"
    long = prose(rnd, 20_000)
    docs = [(1, long + " " + item + " " + long), (None, item.replace("Anna", "Maria").replace("3", "17")), (2, item), (2, item), (3, None), (4, "who wrote hamlet today"), (5, long)]
    bench = [(7, item), (8, "Who wrote Hamlet?"), (9, None), (None, prose(rnd, 30))]
    docs = spark.createDataFrame([(i, x, "en", "", "") for i, x in docs], DOCS)
    bench = spark.createDataFrame(bench, "item_id long, text string")
    find = lambda: sorted(map(repr, dc.contaminated(docs, bench).collect()))
    want = find()
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert find() == want and len(want) == 4
