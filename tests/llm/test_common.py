"""Batches between the JVM and Python stay small, whatever the session's settings are."""

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import common as C


def test_batches_are_bounded_by_bytes(spark):
    before = spark.conf.get(C._BATCH_SETTING)
    try:
        spark.conf.set(C._BATCH_SETTING, "64m")
        rows = spark.range(4000).select("id", F.repeat(F.lit("x"), 5000).alias("t")).coalesce(1)
        seen = C.map_arrow(rows, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long", 1 << 30)
        counts = [r["n"] for r in seen.collect()]
        assert sum(counts) == 4000 and max(counts) * 5000 < 2 * C.BATCH_BYTES
        spark.conf.set(C._BATCH_SETTING, "1m")
        C.small_batches(spark)
        assert spark.conf.get(C._BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(C._BATCH_SETTING, before)
