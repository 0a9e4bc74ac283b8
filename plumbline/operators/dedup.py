"""Keep-first deduplication: exact, by digest, by word-set similarity; links of near copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.ordering import first_per_key
from plumbline.plans.similarity import similar_leaders, similar_links


def dedup_exact(df: DataFrame, fields: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Key is the fields joined with |||; rows are grouped on its digest."""
    key = F.concat_ws("|||", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return first_per_key(df, [*[F.col(w) for w in within], F.sha2(key, 256)], order)


def dedup_md5(
    df: DataFrame, order: Sequence[str], fields: Sequence[str] = ("instruction", "input", "output"), within: Sequence[str] = ()
) -> DataFrame:
    """Key is md5 of the fields without a separator, so ('ab','c') equals ('a','bc')."""
    key = F.md5(F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    return first_per_key(df, [*[F.col(w) for w in within], key], order)


def fuzzy_leaders(df: DataFrame, row_id: str, text: str, threshold: float = 0.9) -> DataFrame:
    t = df.select(row_id, X.word_set(text).alias("__t"))
    return similar_leaders(t, row_id, "__t", threshold)


def fuzzy_links(df: DataFrame, row_id: str, text: str, threshold: float = 0.9) -> DataFrame:
    """(a, b): links that connect all rows whose word sets are more similar than the threshold, dropped rows included."""
    t = df.select(row_id, X.word_set(text).alias("__t"))
    return similar_links(t, row_id, "__t", threshold)


def dedup_fuzzy(df: DataFrame, row_id: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Drop a row when its word set is more similar than the threshold to an earlier kept row."""
    lead = fuzzy_leaders(df, row_id, text, threshold)
    return df.join(lead.where(F.col("leader") == F.col(row_id)).select(row_id), row_id, "left_semi")
