"""Sinks: JSON lines per split, reports, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, split: str | None = "split") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(split) if split else w).json(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A small aggregated table as JSON lines in one file."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_event_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_prom_text(lines: DataFrame, path: str) -> None:
    """Exposition lines (line_no, line) in order, in one file."""
    lines.coalesce(1).sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
