"""Random draws keyed by row id: the same on every layout, retry and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(row_id: Column, op: str | Column, i: int | Column = 0, seed: int = 42) -> Column:
    """Double in [0,1) from (row id, operation, draw number, seed)."""
    op = F.lit(op) if isinstance(op, str) else op
    i = F.lit(i) if isinstance(i, int) else i
    text = F.concat_ws("|", row_id.cast("string"), op, i.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(row_id: Column, op: str | Column, n: int | Column, i: int | Column = 0, seed: int = 42) -> Column:
    """Uniform integer in 0..n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(row_id, op, i, seed) * n).cast("int")
