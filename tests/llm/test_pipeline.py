"""The pipeline against the same decisions made row by row."""

import os

import corpus_pipeline as P
from brute import brute_components
from docloom.llm import langid, quality
from docloom.llm.common import Scratch

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DATA = DATA if DATA.endswith("sf0.001") else "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, columns = Scratch(spark, "t"), docs.columns
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, DATA))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    machine = quality.fit_machine(before, labels.where(quality.remainder("doc_id", 4) != 2))
    rows = before.collect()
    good = {r.doc_id for r, s in zip(rows, machine.scores([(r.text or "").encode() for r in rows]), strict=True) if s >= 0.7}
    assert {r.doc_id for r in after.collect()} == good and after.count() < before.count()
    before, after = kept["language"]
    chain = langid.fit_chain(before.select("doc_id", "text", "lang").where(quality.remainder("doc_id", 5) != 0))
    rows = before.collect()
    names, scores = chain.predict([(r.text or "").encode() for r in rows])
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r, x, y in zip(rows, names, scores, strict=True) if x != "und" and y >= P.LEAST_SCORE}
    before, after = kept["near_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in groups.items() if d == c}
    before, after = kept["personal_data"]
    assert before.count() == after.count() and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["packing"]
    want = {r.doc_id: len((r.text or "").split()) for r in before.collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_language_stage_rejects_other_languages_and_mixtures(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 200").limit(150)
    texts = {r.lang: r.text.split() for r in docs.collect()}
    mixed = " ".join(w for k in range(0, 200, 2) for x in sorted(texts) for w in (texts[x] * 20)[k : k + 2])
    more = spark.createDataFrame([(10**9, mixed, None, "s", len(mixed)), (10**9 + 1, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(more)
    all_kept = P.language(spark, docs, DATA).collect()
    assert not {10**9, 10**9 + 1} & {r.doc_id for r in all_kept} and len(all_kept) >= 0.95 * (docs.count() - 2)
    english = P.language(spark, docs, DATA, wanted=("en",)).collect()
    assert {r.lang for r in english} == {"en"} and len(english) >= 0.95 * docs.where("lang = 'en'").count() - 1


def test_run(spark):
    assert P.run(spark, DATA).count() > 0
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_dedup", "personal_data", "packing"]


def test_dedup_stage_keeps_one_row_of_each_id_and_text(spark, odd):
    docs = odd.select("doc_id", "text")
    got = sorted((r.doc_id or 0) for r in P.near_dedup(spark, docs, DATA).collect())
    assert got == [0, 1, 2, 3, 4, 5, 7]
    clash = spark.createDataFrame([(1, "the first of two texts"), (1, "another text under that id"), (1, "another text under that id"), (2, "the first of two texts")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.near_dedup(spark, clash, DATA).collect()) == [(1, "another text under that id"), (1, "the first of two texts")]
