import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size string, slope int"


def test_targets_stay_below_limits_and_are_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_sources(docs).groupBy("source").agg(F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") / F.col("size")).alias("r")).collect()
    assert sum(r.t for r in rows) == pytest.approx(sum(r.s for r in rows))
    for r in rows:
        assert r.t <= 3 * r.s + 1e-6 and r.r <= 3
        assert abs(r.k - r.t) <= 0.05 * r.t


def test_edge_rows(spark):
    rows = [(1, None, "a", "x", 1), (2, "", None, "x", 1), (None, "one two", "b", "x", 1), (3, "w " * 5000, "b", None, None), (3, "w " * 5000, "b", None, None)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    assert sum(r.source_size == 0 and r.taken == 0 for r in out) == 2
    assert {r.repeats for r in out if r.doc_id == 3} <= {0, 1, 2, 3} and len({r.repeats for r in out if r.doc_id == 3}) == 1
    assert all(r.slope == 1 or r.slope is None for r in out)


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_hot_source_and_small_ones(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"), F.expr("if(id % 3 > 0, 'hot', concat('s', id % 5))").alias("source"))
    a = mix_sources(rows)
    got = {r.source: r for r in a.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()}
    assert all(abs(r.k - r.t) <= 37 for r in got.values())
    again = mix_sources(rows.repartition(7))
    assert a.exceptAll(again).count() == 0
