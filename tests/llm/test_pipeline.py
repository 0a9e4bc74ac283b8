import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.common import stored


def test_stages_keep_the_columns_and_act(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
    assert docs.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("taken <> size * repeats or repeats > 3").count() == 0
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.k) <= r.m for r in per)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated rows, and columns named like those of the operators."""
    long = " ".join(f"w{i % 997}x{i % 613}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [
        (1, long, "en", "a", len(long), 1, "x", 0), (2, long, "en", "a", len(long), 1, "x", 0), (3, None, None, None, None, None, None, None), (4, "", "en", "a", 0, 1, "x", 0),
        (5, "  \n", "de", "b", 3, 1, "x", 0), (None, "text without an id", "en", "b", 18, 1, "x", 0), (6, "same row", "en", None, 8, 1, "x", 0), (6, "same row", "en", None, 8, 1, "x", 0),
        (7, "first words then " + passage, "en", "b", 400, 1, "x", 0), (8, "quite other words before it " + passage + " and others after it too", "en", "c", 400, 1, "x", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id int, __gone string, id int")


@pytest.mark.parametrize("n, gone", [(0, []), (1, [2, 8]), (2, []), (3, [])])
def test_stages_on_odd_rows(spark, sf, odd, n, gone):
    out = corpus_pipeline.STAGES[n][1](spark, odd, sf)
    assert out.columns == odd.columns
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in gone)
    same = {r.doc_id: r.text for r in odd.collect()}
    changed = {r.doc_id for r in got if r.text != same[r.doc_id]}
    assert changed == ({2, 8} if n == 2 else set())


def test_last_stage_on_odd_rows(spark, sf, odd):
    out = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    assert len(out) == odd.count() and all(r.taken == r.size * r.repeats for r in out)
