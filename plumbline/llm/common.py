"""Helpers shared by the corpus operators: words, scratch tables, size-checked broadcasts, task-side batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.plans.runtime import stored  # noqa: F401

#: Bytes of one Arrow batch between the JVM and Python; the session's default of 64 MB is held several times over by each task.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A word is a run of characters other than ASCII white space; `bytes.split()` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when a count proves the bound; beyond it the optimiser picks a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n. A null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, in whatever case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by `BATCH_BYTES`, unless it has a lower bound of its own.

    The setting is read when a job runs, so it stays. It changes how rows are packed, never which rows there are.
    """
    now = spark.conf.get(_BATCH_SETTING)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Apply `fn` to Arrow batches, each cut to about `max_bytes` so that a task's memory doesn't follow batch sizes.

    A single row beyond `max_bytes` forms a batch of its own.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, step = batch.num_rows, max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
            todo = [(i, min(step, n - i)) for i in range(0, n, step)][::-1]
            while todo:
                start, size = todo.pop()
                part = batch.slice(start, size)
                if size > 1 and part.nbytes > 2 * max_bytes:
                    todo += [(start + size // 2, size - size // 2), (start, size // 2)]
                    continue
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
