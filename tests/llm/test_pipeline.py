import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, pseudonyms, setsketch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 80])))
        if i % 6 == 1:
            text = rows[-1][1] + " ago.00@mail4.example.com"
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text), 0.5))
    rows += [(100, None, None, None, None, None), (101, "", "en", "a", 0, 1.0), rows[2], rows[2], (102, "word " * 30_000, "en", "b", 1, 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stages_in_turn(spark, sf, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pseudonyms", "mix", "encode"]
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, at = at, spark.read.parquet(path)
        if k < 4:
            assert at.columns == docs.columns
        if name == "near_dedup":
            keep = {r.doc_id for r in setsketch.near_duplicates(before, 5).where("kept").collect()}
            assert ids(at) == sorted(keep)
        if name == "pseudonyms":
            want = {r.doc_id: r.text for r in pseudonyms.pseudonymised(before, corpus_pipeline.PSEUDONYM_KEY).collect()}
            assert {r.doc_id: r.text for r in at.collect()} == want
            assert at.where(F.col("text").contains("ago.00@")).count() == 0
        if name == "mix":
            sizes = {r.doc_id: len(common.words(r.text)) for r in before.collect()}
            assert all(len(common.words(r.text)) <= sizes[r.doc_id] for r in at.collect())
        if name == "encode":
            assert at.count() == before.count() and at.where("ids[0] <> 1 or element_at(ids, -1) <> 2").count() == 0


def test_stages_on_empty_documents(spark, sf, docs):
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        assert at.count() == 0


def test_clean_documents_pass_the_quality_stage(spark, sf):
    texts, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality_filter(spark, texts, sf).select("doc_id").join(labels, "doc_id")
    good = labels.where("quality = 1").count()
    assert kept.where("quality = 1").count() >= 0.97 * good
    assert kept.where("quality = 0").count() <= 0.2 * labels.where("quality = 0").count()
