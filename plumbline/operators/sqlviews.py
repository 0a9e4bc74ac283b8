"""Analytics views over requests, evaluations, users and feedback; sets, top-k, versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ordering import first_per_key, ranked, top_n_per_group


def rounded_avg(c: str, digits: int) -> Column:
    """Average in exact decimals, rounded half up as a database NUMERIC would; sums of doubles
    depend on row order and can land on either side of a tie."""
    return F.round(F.avg(F.col(c).cast("decimal(18,6)")), digits).cast("double")


def daily_metrics(requests: DataFrame) -> DataFrame:
    return requests.groupBy(F.to_date("ts").alias("date"), "user_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("cached").alias("cached_requests"),
        rounded_avg("latency_ms", 0).cast("bigint").alias("avg_latency_ms"),
        F.sum("tokens_out").alias("total_tokens"),
        F.count_if(~F.col("success")).alias("error_count"),
    )


def refresh_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in `rows`; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def request_summary(requests: DataFrame, evaluations: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("user_id", F.col("email").alias("user_email"))
    e = evaluations.select("request_id", "overall_score", "is_failure")
    return requests.join(e, "request_id", "left").join(u, "user_id", "left").select(
        "request_id", "adapter", "latency_ms", "cached", "overall_score", "is_failure", "user_email"
    )


def adapter_performance(requests: DataFrame, evaluations: DataFrame, one_per_request: bool = False) -> DataFrame:
    """Several evaluations of one request repeat its row, as the view does, unless reduced first."""
    if one_per_request:
        evaluations = first_per_key(evaluations, [F.col("request_id")], [F.desc("eval_no")])
    e = evaluations.select("request_id", "overall_score", "is_failure")
    return requests.join(e, "request_id", "left").groupBy("adapter").agg(
        F.count(F.lit(1)).alias("total_requests"),
        rounded_avg("latency_ms", 0).cast("bigint").alias("avg_latency"),
        rounded_avg("overall_score", 3).alias("avg_quality"),
        F.count_if("is_failure").alias("failures"),
        F.count_if("cached").alias("cache_hits"),
    )


def adapter_daily_rollup(requests: DataFrame, evaluations: DataFrame) -> DataFrame:
    # scores are reduced to one row per request first, so counts are not multiplied
    e = evaluations.groupBy("request_id").agg(F.sum(F.col("overall_score").cast("decimal(18,6)")).alias("s"), F.count("overall_score").alias("c"))
    return requests.join(e, "request_id", "left").groupBy("adapter", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        rounded_avg("latency_ms", 2).alias("avg_latency_ms"),
        F.round(F.sum("s") / F.sum("c"), 3).cast("double").alias("avg_quality_score"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.count_if("cached").alias("cache_hits"),
    )


def rate_limit_counts(requests: DataFrame, width: str = "1 minute") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), width)
    return requests.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("request_count")).select(
        "user_id", F.col("w.start").alias("window_start"), "request_count"
    )


def cache_key(prompt: Column, adapter: Column) -> Column:
    return F.substring(F.sha2(F.concat(prompt, F.lit(":"), adapter), 256), 1, 16)


def cache_hit_stats(requests: DataFrame, prompt: Column, ttl: int = 3600) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return requests.groupBy(cache_key(prompt, F.col("adapter")).alias("cache_key"), "adapter").agg(
        (F.count(F.lit(1)) - 1).alias("hit_count"),
        F.max(at).alias("last_accessed"),
        (F.max(at) + ttl).alias("expires_at"),
        F.min(at).alias("created_at"),
    )


def purge_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def purge_old_windows(windows: DataFrame, now: Column, keep_seconds: int = 3600) -> DataFrame:
    return windows.where(F.unix_seconds("window_start") >= now - keep_seconds)


def feedback_by_adapter(requests: DataFrame, feedback: DataFrame) -> DataFrame:
    return requests.join(feedback, "request_id", "left").groupBy("adapter").agg(
        F.count(F.lit(1)).alias("rows"), F.count("rating").alias("rated"), F.avg("rating").alias("avg_rating"),
        F.avg(F.col("thumbs_up").cast("double")).alias("thumbs_up_share"),
    )


def router_training_extract(rows: DataFrame, source: str = "production", validated_from: float = 0.8) -> DataFrame:
    return rows.select(
        "id", F.col("instruction").alias("query"), F.col("adapter").alias("adapter_label"),
        F.col("complexity").alias("complexity_label"), "confidence", F.lit(source).alias("source"),
        (F.col("confidence") >= validated_from).alias("is_validated"),
    )


def latest_version(versions: DataFrame, metric_low_is_best: bool = True) -> DataFrame:
    """Newest version, best metric and its version, per model."""
    best = F.min_by if metric_low_is_best else F.max_by
    return versions.groupBy("model").agg(
        F.max("version").alias("latest"), F.count(F.lit(1)).alias("n_versions"),
        best("version", F.struct("metric", "version")).alias("best"),
    )


def keep_last_n(versions: DataFrame, n: int = 5) -> DataFrame:
    """Every version with a flag whether retention keeps it (the n newest of its model)."""
    newest = top_n_per_group(versions, ["model"], [F.desc("version")], n, ["version"])
    floor = newest.groupBy("model").agg(F.min("version").alias("__floor"))
    return versions.join(floor, "model").select("model", "version", (F.col("version") >= F.col("__floor")).alias("keep"))


def constraint_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """Violation counts: name -> rows that break the constraint."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")
        out = one if out is None else out.union(one)
    return out


def not_in(df: DataFrame, c: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def top_k(df: DataFrame, score: str, row_id: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), row_id).limit(k)


def chunk(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Consecutive chunks of fixed size in a total order."""
    return ranked(df, order).withColumn("chunk", F.floor((F.col("rank") - 1) / size)).drop("rank")
