"""Request-log statistics: latency, success, cost, histograms, health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keyed import uniform
from plumbline.plans.ordering import group_quantiles, null_safe_join, ranked, rolling_rows

# Histogram bounds in seconds.
LATENCY_BOUNDS = ["0.01", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0"]


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def tokens_per_second(tokens_out: Column, latency_ms: Column) -> Column:
    return F.when(latency_ms > 0, tokens_out * 1000.0 / latency_ms).otherwise(0.0)


def recent_requests(requests: DataFrame, last: int | None = None, seconds: float | None = None) -> DataFrame:
    """The last n requests, or those in the last `seconds` before the newest one."""
    if seconds is not None:
        newest = requests.agg(F.max("ts").alias("m"))
        cut = newest.select(F.col("m") - F.make_dt_interval(secs=F.lit(seconds))).scalar()
        requests = requests.where(F.col("ts") >= cut)
    if last is not None:
        requests = requests.orderBy(F.desc("ts"), F.desc("request_id")).limit(last)
    return requests


def performance_stats(requests: DataFrame, keys: Sequence[str] = (), **quantile_args) -> DataFrame:
    tps = tokens_per_second(F.col("tokens_out"), F.col("latency_ms"))
    aggs = [
        F.count(F.lit(1)).alias("total_requests"),
        share(F.col("success")).alias("success_rate"),
        F.avg("latency_ms").alias("mean_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.coalesce(F.avg(F.when(tps > 0, tps)), F.lit(0.0)).alias("mean_tokens_per_sec"),
        F.sum("tokens_in").alias("total_tokens_in"),
        F.sum("tokens_out").alias("total_tokens_out"),
    ]
    probs = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return group_quantiles(requests, keys, "latency_ms", probs, aggs, **quantile_args)


def adapter_breakdown(requests: DataFrame, **quantile_args) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("requests"),
        share(F.col("success")).alias("success_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    ]
    return group_quantiles(requests, ["adapter"], "latency_ms", {"p95_latency_ms": 0.95}, aggs, **quantile_args)


def cost_estimate(requests: DataFrame, per_1k_in: float = 0.001, per_1k_out: float = 0.002) -> DataFrame:
    t = requests.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    cost_in, cost_out = F.col("tokens_in") / 1000 * per_1k_in, F.col("tokens_out") / 1000 * per_1k_out
    return t.select(
        (cost_in + cost_out).alias("total_cost"), cost_in.alias("input_cost"), cost_out.alias("output_cost"),
        "tokens_in", "tokens_out",
    )


def request_alerts(
    requests: DataFrame, latency_limit: float = 5000.0, error_limit: float = 0.1, window: int = 100, block: int = 8192
) -> DataFrame:
    """High-latency alerts per row and error-rate alerts over the last `window` rows, whole log."""
    r = ranked(requests.select("request_id", "ts", "latency_ms", "success"), ["ts", "request_id"])
    failed = (~F.col("success")).cast("double")
    r = rolling_rows(r, {"error_rate": F.avg(failed)}, window - 1, block=block)
    hot = F.when(
        F.col("latency_ms") > latency_limit,
        F.struct(F.lit("high_latency").alias("type"), F.col("latency_ms").alias("value"), F.lit(latency_limit).alias("threshold")),
    )
    err = F.when(
        F.col("error_rate") > error_limit,
        F.struct(F.lit("high_error_rate").alias("type"), F.col("error_rate").alias("value"), F.lit(error_limit).alias("threshold")),
    )
    alerts = F.explode(F.array_compact(F.array(hot, err)))
    return r.select("request_id", alerts.alias("a")).select("request_id", "a.type", "a.value", "a.threshold")


def latency_histogram(requests: DataFrame) -> DataFrame:
    """Cumulative `le` buckets per adapter: one pass, then unpivoted."""
    sec = F.col("latency_ms") / 1000
    wide = requests.groupBy("adapter").agg(
        *[F.count_if(sec <= float(b)).alias(b) for b in LATENCY_BOUNDS], F.count(F.lit(1)).alias("+Inf")
    )
    return wide.unpivot(["adapter"], [f"`{b}`" for b in [*LATENCY_BOUNDS, "+Inf"]], "le", "cumulative_count")


def request_counters(requests: DataFrame) -> DataFrame:
    """Counters by (adapter, status) and by token direction, as (metric, label, sublabel, value)."""
    status = F.when(F.col("success"), "success").otherwise("error")
    base = requests.groupBy("adapter", status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("tin"), F.sum("tokens_out").alias("tout")
    )
    rows = base.select(F.lit("requests_total").alias("metric"), F.col("adapter").alias("label"), F.col("status").alias("sublabel"), F.col("n").alias("value"))
    toks = base.agg(F.sum("tin").alias("in"), F.sum("tout").alias("out")).unpivot([], ["in", "out"], "label", "value")
    return rows.union(toks.select(F.lit("tokens_total"), "label", F.lit(""), "value"))


def resource_summary(samples: DataFrame, last: int = 60, shown: int = 10) -> DataFrame:
    """Means over the newest samples (ts, cpu, memory) and the newest few as a list."""
    top = samples.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    newest = F.slice(F.sort_array(F.collect_list(F.struct("ts", "id", "cpu")), asc=False), 1, shown)
    return top.agg(
        F.avg("cpu").alias("cpu_avg"), F.avg("memory").alias("memory_avg"),
        F.array_join(F.transform(newest, lambda s: s["id"].cast("string")), ",").alias("newest_ids"),
    )


def dashboard_summary(requests: DataFrame) -> DataFrame:
    # adapters active: distinct values through a count per adapter, not a distinct set in one buffer
    active = requests.groupBy("adapter").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    s = performance_stats(requests)
    c = cost_estimate(requests).select("total_cost")
    return s.select(
        "total_requests", "success_rate", F.col("mean_ms").alias("avg_latency_ms"), F.col("p95_ms").alias("p95_latency_ms")
    ).select(
        "*", active.scalar().alias("adapters_active"), c.scalar().alias("total_cost"),
        F.when(F.col("success_rate") > 0.95, "healthy").otherwise("degraded").alias("health"),
    )


def gateway_stats(requests: DataFrame) -> DataFrame:
    ok = F.count_if("success")
    return requests.agg(
        F.count(F.lit(1)).alias("requests_total"),
        ok.alias("requests_success"),
        F.count_if(~F.col("success")).alias("requests_failed"),
        F.count_if("cached").alias("cache_hits"),
        (ok / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"),
        (F.sum(F.when(F.col("success"), F.col("latency_ms"))) / F.greatest(ok, F.lit(1))).alias("avg_latency_success_ms"),
        (F.sum("latency_ms") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_latency_all_ms"),
        F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1000000 - F.unix_micros(F.min("ts").cast("timestamp")) / 1000000).alias("uptime_seconds"),
    )


def bench_summary(runs: DataFrame, keys: Sequence[str], value: str = "latency_ms", **quantile_args) -> DataFrame:
    """Sample std and nearest-rank percentiles per configuration."""
    aggs = [
        F.avg(value).alias("mean_ms"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_ms"),
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) * 1000.0 / F.sum(value)).alias("throughput"),
    ]
    near = group_quantiles(runs, keys, value, {"p95_ms": 0.95, "p99_ms": 0.99}, aggs, method="nearest", **quantile_args)
    med = group_quantiles(runs, keys, value, {"median_ms": 0.5}, **quantile_args)
    return null_safe_join(near, med, list(keys))


def system_eval_latency(requests: DataFrame, **quantile_args) -> DataFrame:
    aggs = [
        F.avg("latency_ms").alias("mean_ms"), F.stddev_pop("latency_ms").alias("std_ms"),
        (F.count(F.lit(1)) / (F.sum("latency_ms") / 1000)).alias("throughput_qps"),
    ]
    return group_quantiles(requests, [], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, aggs, **quantile_args)


def best_variant(results: DataFrame, study: str, variant: str, score: str, lower_is_better: bool = False) -> DataFrame:
    """Best variant per study; ties go to the smallest variant name."""
    s = -F.col(score) if lower_is_better else F.col(score)
    best = F.max_by(F.struct(variant, score), F.struct(s, -F.col(variant)))
    return results.groupBy(study).agg(best.alias("b")).select(study, f"b.{variant}", f"b.{score}")


def weighted_mean_meter(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(key).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("avg"), F.sum(weight).alias("count")
    )


def slow_requests(requests: DataFrame, limit_ms: float = 1000.0, sample_rate: float = 0.01) -> DataFrame:
    profiled = uniform(F.col("request_id"), "profile") < F.lit(sample_rate)
    slow = F.col("latency_ms") > limit_ms
    return requests.where(slow | profiled).select("request_id", "latency_ms", slow.alias("slow"), profiled.alias("profiled"))


def prom_text(values: DataFrame, specs: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Exposition text lines from a one-row table: name -> (help, type, printf format)."""
    parts = []
    for name, (help_text, kind, fmt) in specs.items():
        parts.append(F.lit(f"# HELP {name} {help_text}"))
        parts.append(F.lit(f"# TYPE {name} {kind}"))
        parts.append(F.format_string(f"{name} {fmt}", F.col(name)))
    return values.select(F.posexplode(F.array(*parts)).alias("line_no", "line"))


# Exported gateway metrics.
GATEWAY_METRICS = {
    "requests_total": ("Total requests", "counter", "%d"),
    "requests_success": ("Successful requests", "counter", "%d"),
    "requests_failed": ("Failed requests", "counter", "%d"),
    "cache_hits": ("Cache hit count", "counter", "%d"),
    "success_rate": ("Request success rate", "gauge", "%.4f"),
    "avg_latency_ms": ("Average latency in ms", "gauge", "%.2f"),
    "uptime_seconds": ("API uptime", "counter", "%d"),
}
