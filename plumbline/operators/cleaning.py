"""Text cleaning and row filters, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X

# Patterns removed from text.
URL = f"https?://{X.INK}+|www\\.{X.INK}+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TAG = r"<[^>]+>"
# Phrases that mark an output as a refusal.
REFUSALS = ["i cannot", "i can't", "i'm unable", "as an ai", "i don't have access", "sorry, but"]
TEXT_FIELDS = ("instruction", "input", "output")

# Characters NFC can change: marks, jamo, and blocks holding singletons or excluded compositions.
MAY_CHANGE = (
    r"[\p{M}ʹ;·क़-य़ড়-য়ਲ਼-ਫ਼ଡ଼ଢ଼གྷ-ྐྵᄀ-ᇿ"
    r"ά-´  ΩKÅ〈〉⫝̸豈-﫿יִ-פֿ"
    r"\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC has no built-in. Only text holding a character NFC may change crosses to Python."""
    suspect = (F.octet_length(text) > F.length(text)) & text.rlike(MAY_CHANGE)
    return F.coalesce(_nfc(F.when(suspect, text)), text)


def clean_text(
    text: Column | str, urls: bool = True, emails: bool = True, spaces: bool = True, max_length: int | None = None
) -> Column:
    t = nfc(F.coalesce(X.col(text), F.lit("")))
    # a plain substring test spares most rows the pattern
    if urls:
        t = F.when(t.contains("http") | t.contains("www."), F.regexp_replace(t, URL, "")).otherwise(t)
    if emails:
        t = F.when(t.contains("@"), F.regexp_replace(t, EMAIL, "")).otherwise(t)
    if spaces:
        t = X.collapse_space(t)
    return F.substring(t, 1, max_length) if max_length else t


def clean_example(df: DataFrame, fields: Sequence[str] = TEXT_FIELDS, **options) -> DataFrame:
    return df.withColumns({c: clean_text(c, **options) for c in fields if c in df.columns})


def strip_html(text: Column | str, lower: bool = False, drop_invalid: bool = True) -> Column:
    t = X.col(text)
    if drop_invalid:
        t = F.when(F.is_valid_utf8(t), t).otherwise(F.regexp_replace(F.make_valid_utf8(t), "\uFFFD", ""))
    t = X.collapse_space(F.regexp_replace(t, TAG, ""))
    return F.lower(t) if lower else t


def strip_html_example(df: DataFrame, lower_instruction: bool = False) -> DataFrame:
    return df.withColumns(
        {c: strip_html(c, lower=lower_instruction and c == "instruction") for c in TEXT_FIELDS if c in df.columns}
    )


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def filter_examples(
    df: DataFrame, min_length: int = 10, max_length: int | None = 2048,
    required: Sequence[str] = ("instruction", "output"), custom: Column | None = None,
) -> DataFrame:
    keep = F.length("output") >= (min_length or 10)
    if max_length:
        keep = keep & (F.length("output") <= max_length)
    for c in required:
        keep = keep & present(c)
    return df.where(keep if custom is None else keep & custom)


def special_ratio(text: Column) -> Column:
    special = F.length(F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{X.SPACE}]+", ""))
    return F.coalesce(F.try_divide(special, F.length(text)), F.lit(0.0))


def content_ok(text: Column | str, blocked: Sequence[str] = (), max_special: float = 0.3, min_words: int = 3) -> Column:
    t = X.col(text)
    ok = (X.word_count(t) >= min_words) & (special_ratio(t) <= max_special)
    for p in blocked:
        ok = ok & ~t.rlike(p)
    return ok


def reject_reason(
    limits: tuple[int, int, int, int] = (10, 1000, 20, 5000),
    by_adapter: Mapping[str, tuple[int, int, int, int]] | None = None,
) -> Column:
    """First failing check, or null. Limits are (min, max) of instruction and output; a mapping
    overrides them per adapter and becomes part of the expression."""

    def bound(i: int) -> Column:
        c = F.lit(limits[i])
        for a, lim in (by_adapter or {}).items():
            c = F.when(F.col("adapter") == a, lim[i]).otherwise(c)
        return c

    n_in, n_out = F.length("instruction"), F.length("output")
    bad_length = (n_in < bound(0)) | (n_in > bound(1)) | (n_out < bound(2)) | (n_out > bound(3))
    low = X.any_phrase(F.lower("output"), REFUSALS) | (X.word_count("output") < 5)
    return (
        F.when(~present("instruction") | ~present("output"), "missing_fields")
        .when(bad_length, "invalid_length")
        .when(low, "low_quality")
    )


def validation_stats(df: DataFrame, reason: Column) -> DataFrame:
    r = df.select(reason.alias("r"))
    return r.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("r").isNull()).alias("valid"),
        *[F.count_if(F.col("r") == k).alias(k) for k in ("missing_fields", "invalid_length", "low_quality")],
    )
