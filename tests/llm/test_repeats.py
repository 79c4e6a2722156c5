"""Substring dedup operators against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from shufflescope.llm import chunk_dedup, repeated_bytes

DDL = "doc_id long, text string, lang string, n_bytes string, spans string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DDL)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéfgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def corpus(seed):
    """Exact copies, near copies, a passage in many documents, periodic text, short and null texts, repeated rows."""
    rnd = random.Random(seed)
    passage, rows = prose(rnd, 110), []
    for i in range(25):
        rows.append((i, f"{prose(rnd, rnd.randint(0, 60))} {passage} {prose(rnd, rnd.randint(0, 60))}"))
    base = prose(rnd, 400)
    for i in range(25, 40):
        at = rnd.randrange(len(base))
        rows.append((i, base[:at] + prose(rnd, 2) + base[at + 5 :]))
    rows += [(i, prose(rnd, 150)) for i in range(40, 50)]
    rows += [(50, rows[40][1]), (51, rows[40][1])]
    rows += [(60, "Wher. " * 200), (61, "x" * 900), (62, None), (63, ""), (64, "short"), (None, rows[45][1]), (65, prose(rnd, 130)), (66, base[100:499]), (67, base[100:500])]
    return [*rows, rows[-3], (65, "other text of the same id")]


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        out.append((i is not None, i or 0, len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_repeated_bytes_equal_brute_force(spark, monkeypatch):
    for seed, keys in ((1, 500_000), (2, 0)):
        monkeypatch.setattr(repeated_bytes, "BROADCAST_KEYS", keys)
        rows = corpus(seed)
        got = repeated_bytes.repeated_bytes(docs_of(spark, rows)).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 400)
    assert repeated_bytes.repeated_bytes(docs_of(spark, [])).count() == 0


def test_contexts_that_agree_in_31_bits_are_told_apart(spark):
    """Found by search: under one key, at the start of the passage, the contexts of these two rows have equal upper 31 bits."""
    rnd = random.Random(11)
    before, passage = prose(rnd, 70), prose(rnd, 110)
    rows = [(i, f"{before} {i:08d} {passage} {i}") for i in (80413, 83968)]
    names = []
    for _, t in rows:
        raw = t.encode()
        found = [x.tolist() for x in repeated_bytes.anchors(raw)]
        names.append({repeated_bytes._names(raw, *(x[i] for x in found)) for i in range(len(found[0]))})
    assert any(k == j and d != e and d >> 33 == e >> 33 for k, d in names[0] for j, e in names[1])
    got = repeated_bytes.repeated_bytes(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 400)


def test_anchors_depend_on_the_string_alone():
    rnd = random.Random(5)
    for text in (prose(rnd, 300), "ab" * 600, "x" * 700):
        raw = text.encode()
        place, lo, hi = repeated_bytes.anchors(raw)
        assert lo[0] == 0 and hi[-1] == len(raw) - 400 and (lo[1:] == hi[:-1] + 1).all()
        of = {}
        for a, x, y in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for s in range(x, y + 1):
                assert 0 <= a - s < 128 and of.setdefault(raw[s : s + 400], a - s) == a - s


def test_chunks_resist_insertions():
    rnd = random.Random(6)
    raw = prose(rnd, 3000).encode()
    ends = chunk_dedup.cuts(raw)
    assert ends[-1] == len(raw) and all(chunk_dedup.LEAST <= b - a <= chunk_dedup.MOST for a, b in zip(ends, ends[1:-1], strict=False))
    parts = lambda r: {r[a:b] for e in [chunk_dedup.cuts(r)] for a, b in zip([0, *e], e, strict=False)}
    assert len(parts(raw) - parts(raw[:5000] + b"inserted" + raw[5000:])) <= 12
    assert chunk_dedup.cuts(b"") == [] and chunk_dedup.cuts(b"ab") == [2]


def brute_chunks(rows):
    docs = {}
    for i, t in rows:
        raw = (t or "").encode()
        ends = chunk_dedup.cuts(raw)
        docs[(i is None, i or 0, raw)] = list(zip([0, *ends], ends, strict=False))
    seen, out = set(), {}
    order = sorted(docs, key=lambda d: (d[0], d[1], _text_hash(d[2])))
    for d in order:
        runs = []
        for a, b in docs[d]:
            if d[2][a:b] in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(d[2][a:b])
        out[d] = [r for r in runs if r[1] - r[0] >= chunk_dedup.RUN]
    return out


def _text_hash(raw):
    return chunk_dedup.text_hash(raw)


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(3)
    want = brute_chunks(rows)
    got = chunk_dedup.removals(docs_of(spark, rows)).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.spans))
    for i, found in by_id.items():
        expected = []
        for j, t in rows:
            if j == i:
                runs = want[(i is None, i or 0, (t or "").encode())]
                expected.append((len((t or "").encode()), sum(b - a for a, b in runs), len(runs), ",".join(f"{a}:{b}" for a, b in runs)))
        assert sorted(found) == sorted(expected), i
    assert len(got) == len(rows)
    removed = {r.doc_id: r.n_removed for r in got}
    assert all(removed[i] > 0 for i in range(1, 25)) and removed[0] == 0  # the passage goes but for its first copy
    assert all(removed[i] == 0 for i in range(40, 50))  # clean documents stay whole
    texts = chunk_dedup.dedup_texts(docs_of(spark, rows))
    assert texts.columns == docs_of(spark, []).columns
    kept = {r.doc_id: r.text for r in texts.collect()}
    assert len(kept[0].encode()) == len(rows[0][1].encode()) and len(kept[1].encode()) <= len(rows[1][1].encode()) - removed[1] and kept[62] is None
    assert chunk_dedup.removals(docs_of(spark, [])).count() == 0


def test_merged_transforms_find_what_brute_force_finds():
    from shufflescope.llm import bwt

    rnd = random.Random(7)
    for trial in range(30):
        length = rnd.choice([3, 8, 20])
        base = "".join(rnd.choice("ab") for _ in range(60)).encode()
        strings = [b"", b"a", base, base[5:50], b"ab" * 20] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).encode() for _ in range(6)]
        rnd.shuffle(strings)
        cut = sorted(rnd.sample(range(1, len(strings)), trial % 4))
        shards = [strings[a:b] for a, b in zip([0, *cut], [*cut, len(strings)], strict=True)]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}
        assert bwt.repeated_starts(shards, length) == want


def test_merged_transform_is_the_whole_ones():
    from shufflescope.llm import bwt

    rnd = random.Random(8)
    strings = ["".join(rnd.choice("abc") for _ in range(30)).encode() for _ in range(6)]
    merged, _ = bwt.merge(bwt.transform(strings[:2]), bwt.transform(strings[2:], 2), 40)
    whole = bwt.transform(strings)
    assert all((x == y).all() for x, y in zip(merged[:3], whole[:3], strict=True))


def test_passages_of_51_words_and_short_exact_copies_go(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.choice([2, 3, 4, 5, 6, 7, 8])))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for n in (51, 55, 60):
        for _ in range(200):
            passages.append(some(n))
            rows += [(len(rows) + k, f"{some(30)} {passages[-1]} {some(30)}") for k in range(2)]
    removed = {r.doc_id: r.n_removed for r in chunk_dedup.removals(docs_of(spark, rows)).collect()}
    share = [removed[2 * i + 1] / len(p) for i, p in enumerate(passages)]
    assert min(share) >= 0.45 and np.mean(share) >= 0.7 and not any(removed[2 * i] for i in range(len(passages)))
    short = [(0, "A short line."), (1, "A short line."), (2, some(15)), (4, "x" * 40), (4, "x" * 40), (5, "Another."), (None, "Another.")]
    short += [(3, short[2][1]), (6, short[2][1] + " and more")]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in chunk_dedup.removals(docs_of(spark, short)).collect()}
    assert {i for i, (n, gone) in got.items() if gone} == {1, 3, None} and all(got[i][0] == got[i][1] for i in (1, 3, None))
    assert {r.doc_id: r.text for r in chunk_dedup.dedup_texts(docs_of(spark, short)).collect()}[3] == ""


def test_chunks_of_periodic_text_are_not_bytes():
    for period in ("x", "ab", "Wher. "):
        assert len(chunk_dedup.cuts((period * 3000).encode())) <= len(period) * 3000 / chunk_dedup.THIN + 8
