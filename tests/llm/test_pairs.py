import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import brute_components, brute_sets
from docloom.llm import ann, components, dedup
from docloom.llm.common import Scratch
from docloom.llm.textkit import Words, shingle_sets

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_words_and_shingles():
    words = Words([b"One two\x0bthree", b"", b" one "])
    assert words.first.tolist() == [0, 3, 3, 4] and words.hashes()[0] == words.hashes()[3]
    a, b, c, d = shingle_sets([b"a b c d", b"a b c", b"A  b\nc D", b""])
    assert len(a) == 1 and a[0] != b[0] and a[0] == c[0] and len(d) == 0


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    s = dedup.Sketcher()
    for n in (4, 60, 3000):
        common = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 4, np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s.sketch(a) == s.sketch(b)).mean() - true) < 0.13


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    docs = [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "a b c d e"), (1007, "a b c d e")]
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 90, 200]))]
        docs += [(base * 100 + i, " ".join(edited(rng, words, rng.randrange(0, 1 + len(words) // 25)))) for i in range(30)]
        chain = words
        for i in range(15):  # each like the last, the ends unlike
            chain = edited(rng, chain, 1)
            docs.append((base * 100 + 50 + i, " ".join(chain)))
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(2000 + i, passage + " " + " ".join(f"q{i}x{k}" for k in range(40 + i))) for i in range(40)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()}
    want = brute_components(docs)
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}


def template_pages(rng, n):
    """Pages of one template and one of ten sections, a word or two of their own."""
    template, sections = [f"t{i}" for i in range(60)], [[f"s{k}x{i}" for i in range(60)] for k in range(10)]
    out = []
    for i in range(n):
        words = edited(rng, template + sections[i % 10], 1 + rng.randrange(2))
        out.append((i, " ".join(words)))
    return out


def test_pairs_of_template_pages_grow_with_their_number(spark, monkeypatch):
    sent = []
    whole = dedup.confirm

    def counted(pairs, *rest):
        sent[-1] += pairs.count()
        return whole(pairs, *rest)

    monkeypatch.setattr(dedup, "confirm", counted)
    for n in (400, 1600):
        sent.append(0)
        docs = template_pages(random.Random(n), n)
        got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == {i: i % 10 for i in range(n)}
    assert sent[0] <= 5 * 400 and sent[1] <= 5 * 1600, sent  # all pairs would be 80 thousand and 1.3 million


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(12)
    texts = [" ".join(edited(rng, [f"b{b}w{i}" for i in range(80)], rng.randrange(3))) for b in range(12) for _ in range(6)]
    docs = [(i // 2 if i % 5 else i, t) for i, t in enumerate(texts)] + [(7, None), (500, "alone here"), (500, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets, label = [(d, brute_sets(t)) for d, t in docs], {d: d for d, _ in docs}
    for _ in range(len(label)):  # ids linked by any of their texts
        for d, x in sets:
            for e, y in sets:
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[d] = label[e] = min(label[d], label[e])
    assert got == {(d, len(x), label[d] if x else d, d == (label[d] if x else d)) for d, x in sets}


def test_dedup_edges(spark, odd, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(odd).collect())
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False), (7, 1, 7, True)]
    assert dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.label for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}


def brute_nearest(rows, queries, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        top = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), d[i]) for i in top if np.isfinite(d[i])]
    return out


def test_search_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in ann.op8_anisotropic_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want]
    assert np.mean(hit) >= 0.95
    assert all(dict(want[q]).get(i, s) == pytest.approx(s, abs=1e-12) for q in want for i, s in got[q])


def test_search_in_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(0, 1e-3, 16) if i % 3 else rng.normal(size=16)).tolist()) for i in range(9000)] + [(9000 + i, centre.tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, Scratch(spark, "t"), cell_rows=500)
    assert len(index.cells.centres) == 19
    found = ann.search(index, index.rows.where("vec_id in (1, 3, 9200)"))
    got = {q: [r.vec_id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 3, 9200)}
    want = brute_nearest(rows, [1, 3, 9200])
    assert got[9200] == list(range(9000, 9010))
    assert all(len(set(got[q]) & {i for i, _ in want[q]}) >= 9 for q in want)


def test_cells_save_work_where_vectors_cluster(spark, monkeypatch):
    """Far clusters: few cells are searched, parts and shares are small, recall stays."""
    monkeypatch.setattr(ann, "SHARE_QUERIES", 40)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.3, 24)).tolist()) for i in range(12_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, Scratch(spark, "t"), cell_rows=200)
    assert len(index.cells.centres) == 60 and index.cells.probes <= 15
    found = ann.search(index, index.rows.where("vec_id % 100 = 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, range(0, 12_000, 100))
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.95
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quantiser_prefers_small_parallel_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = ann.Codebook(64).fit(x)
    assert book.eta > 2
    e, u = book._parts(x)

    def parallel(codes):
        r = e - book.centres[np.arange(book.parts), codes]
        return (np.einsum("nmi,nmi->n", r, u) ** 2).mean()

    plain = book._nearest(e)
    assert parallel(book._assign(e, u, plain.copy())) < parallel(plain)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, code double")
    index = ann.build_index(df, Scratch(spark, "t"))
    got = ann.search(index, index.rows.where("vec_id % 6 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (6, 1, 7, 0.0), (6, 2, 0, 1.0)]
    none = ann.build_index(df.where("false"), Scratch(spark, "t"))
    assert ann.search(none, none.rows).count() == 0
