"""Checks as an array of messages per row, and verdicts over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vectors as V


def messages(*checks: tuple[Column, str]) -> Column:
    """Messages of the failed checks, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for bad, m in checks]))


def length_outside(c: str, low: int, high: int) -> Column:
    return F.col(c).isNull() | ~F.length(c).between(low, high)


def blank(c: str) -> Column:
    return F.length(X.collapse_space(F.col(c))) == 0


def check_training_sample() -> Column:
    return messages(
        (length_outside("instruction", 1, 10000), "instruction length"),
        (blank("instruction"), "instruction blank"),
        (F.length("input") > 50000, "input length"),
        (length_outside("output", 1, 50000), "output length"),
        (blank("output"), "output blank"),
    )


def check_router_sample() -> Column:
    total = V.total(F.col("adapter_weights"))
    return messages(
        (length_outside("query", 1, 10000), "query length"),
        (F.col("optimal_adapter").isNull() | (F.col("optimal_adapter") < 0), "adapter index"),
        (F.abs(total - 1.0) > 0.01, "weights sum"),
        (F.exists("adapter_weights", lambda w: w < 0), "weight negative"),
        (~F.col("complexity").isin("easy", "medium", "hard"), "complexity"),
    )


def check_eval_sample() -> Column:
    return messages(
        (F.col("query").isNull() | (F.length("query") < 1), "query empty"),
        (F.col("response").isNull() | (F.length("response") < 1), "response empty"),
        (~F.col("quality_score").between(0.0, 1.0), "score range"),
    )


# Fixed value: adapter names a request may ask for.
REQUEST_ADAPTERS = ["reasoning", "code", "creative", "analysis"]


def check_request() -> Column:
    return messages(
        (length_outside("prompt", 1, 4096) | blank("prompt"), "prompt"),
        (~F.col("adapter").isin(REQUEST_ADAPTERS), "adapter"),
        (~F.col("max_tokens").between(1, 512), "max_tokens"),
        (~F.col("temperature").between(0.1, 2.0), "temperature"),
        (~F.col("top_p").between(0.1, 1.0), "top_p"),
    )


def clamp(c: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))


def schema_verdict(df: DataFrame, errors: Column) -> DataFrame:
    bad = F.size(errors) > 0
    s = df.select(bad.alias("bad")).agg(F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("invalid"))
    quality = (
        F.when(F.col("invalid") == 0, "high").when(F.col("valid") == 0, "invalid").otherwise("low")
    )
    return s.select("valid", "invalid", quality.alias("quality"), (F.col("invalid") == 0).alias("is_valid"))


def ngram_repetition(text: Column | str, n: int = 3) -> Column:
    """1 - distinct/total of lower-cased word n-grams; 0 below five words."""

    def of_grams(g: Column) -> Column:
        return F.coalesce(1.0 - F.try_divide(F.size(F.array_distinct(g)), F.size(g)), F.lit(0.0))

    def of_words(ws: Column) -> Column:
        return F.when(F.size(ws) < 5, 0.0).otherwise(X.let(X.ngrams(ws, n), of_grams))

    return X.let(X.words(F.lower(X.col(text))), of_words)


def text_quality(df: DataFrame, text: str, low: int = 10, high: int = 50000, limit: float = 0.3) -> DataFrame:
    r = df.withColumn("repetition", ngram_repetition(text))
    n = F.length(text)
    errors = messages((n < low, "too short"), (n > high, "too long"))
    warnings = messages((F.col(text).contains("\uFFFD"), "replacement characters"), (F.col("repetition") > limit, "repetition"))
    r = r.withColumns({"errors": errors, "warnings": warnings})
    quality = F.when(F.size("errors") > 0, "invalid").when(F.size("warnings") > 0, "medium").otherwise("high")
    return r.withColumn("quality", quality)


def row_digest(columns: Sequence[str]) -> Column:
    """md5 over the named values in name order; null and '' stay apart."""
    parts = []
    for c in sorted(columns):
        v = F.col(c).cast("string")
        parts += [F.lit(c), F.coalesce(F.concat(F.lit("="), v), F.lit("!"))]
    return F.md5(F.concat_ws("\u0001", *parts))


def duplicate_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows minus distinct rows. Copies are counted per digest with map-side combine."""
    d = df.groupBy(row_digest(columns or df.columns).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    s = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))
    ratio = F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0))
    return s.select("total", "duplicates", ratio.alias("ratio"), (ratio > 0.05).alias("warn"))


def dataset_verdict(
    df: DataFrame, row_id: str, errors: Column, fields: Sequence[str] = ("instruction", "output"), min_rows: int = 10,
    data_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One-row report: sizes, validity, duplicates, missing fields, first ten errors, quality."""
    e = df.withColumn("__e", errors)
    cols = list(data_columns or [c for c in df.columns if c != row_id])
    missing = [F.count_if(F.col(f).isNull() | (F.col(f) == "")).alias(f"missing_{f}") for f in fields]
    base = e.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("__e") == 0).alias("valid"),
        F.count_if(F.size("__e") > 0).alias("invalid"), *missing,
    )
    dup = duplicate_ratio(df, cols)
    shown = e.where(F.size("__e") > 0).orderBy(row_id).limit(10)
    shown = shown.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(row_id, F.element_at("__e", 1).alias("m")))),
                                              lambda s: F.concat(s[row_id].cast("string"), F.lit(": "), s["m"])), "; ").alias("t"))
    r = base.select("*", dup.select("duplicates").scalar().alias("duplicates"), shown.scalar().alias("first_errors"))
    warn = F.coalesce(F.try_divide("duplicates", "total"), F.lit(0.0)) > 0.05
    for f in fields:
        warn = warn | (F.col(f"missing_{f}") > 0)
    err = (F.col("total") < min_rows) | (F.col("invalid") > 0)
    quality = F.when(err & (F.col("invalid") > F.col("total") * 0.5), "invalid").when(err, "low").when(warn, "medium").otherwise("high")
    return r.withColumn("quality", quality)
