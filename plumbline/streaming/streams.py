"""Structured Streaming forms: windowed statistics, deduplication, budgets, quality, alerts."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.alerts import Rule
from plumbline.plans.folds import fold_stream
from plumbline.plans.runtime import scratch_path
from plumbline.streaming.limits import ORDER, TIER_TOKENS


def table_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int = 100) -> DataFrame:
    """The files of a folder that match a glob, as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder)
    )


def run_to_files(sdf: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process what is available, append to Parquet below the checkpoint root and read it back."""
    spark = sdf.sparkSession
    out = path or scratch_path(spark, label)
    q = (
        sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state")
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def run_counted(sdf: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Like `run_to_files`, with the number of rows that came behind the watermark and were dropped."""
    spark, out = sdf.sparkSession, scratch_path(sdf.sparkSession, label)
    q = sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"])
    return spark.read.schema(sdf.schema).parquet(out), late


def for_each_batch(sdf: DataFrame, fn: Callable[[DataFrame, int], None], label: str, mode: str = "append"):
    """Hand each micro-batch to a callback: the hook for alert delivery and upserts."""
    state = scratch_path(sdf.sparkSession, label + "-state")
    return sdf.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()


def timed(requests: DataFrame, delay: str) -> DataFrame:
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_request_stats(requests: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts, error ratio, mean and p95 latency per adapter and window; closed windows only.

    The p95 is a mergeable sketch, so the state per window is bounded.
    """
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = timed(requests, delay).groupBy(w.alias("w"), "adapter").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((~F.col("success")).cast("double")).alias("error_ratio"),
        F.avg("latency_ms").alias("mean_ms"),
        F.percentile_approx("latency_ms", 0.95, 10000).alias("p95_ms"),
    )
    return g.select(F.unix_seconds("w.start").alias("window_start"), "adapter", "requests", "error_ratio", "mean_ms", "p95_ms")


def stream_downsample(points: DataFrame, interval: str, delay: str = "10 minutes") -> DataFrame:
    g = timed(points, delay).groupBy("name", F.window("ts", interval).alias("w")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return g.select("name", F.unix_seconds("w.start").alias("bucket"), "value", "n")


def stream_dedup(rows: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    return timed(rows, delay).dropDuplicatesWithinWatermark([key])


def token_budget(requests: DataFrame, tiers: DataFrame, limits: Mapping[str, int] = TIER_TOKENS, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tokens per user and window against the user's tier; works on batch and stream input."""
    t = F.coalesce(F.col("tier"), F.lit("free"))
    budget = F.lit(limits["free"])
    for name, n in limits.items():
        budget = F.when(t == name, n).otherwise(budget)
    r = timed(requests, delay) if requests.isStreaming else requests.withColumn("ts", F.col("ts").cast("timestamp"))
    tokens = F.col("tokens_in") + F.col("tokens_out")
    r = r.join(tiers.select("user_id", "tier"), "user_id", "left")
    g = r.groupBy("user_id", "tier", F.window("ts", width).alias("w")).agg(F.sum(tokens).alias("tokens"))
    return g.select("user_id", F.unix_seconds("w.start").alias("window_start"), "tokens", (F.col("tokens") > budget).alias("over"))


# --- custom state


def quality_start() -> dict:
    return {"base": [0.0, 0], "last": [], "rows": 0}


def quality_step(baseline_rows: int, window: int, min_rows: int, threshold: float):
    """Mean of the first rows against the mean of the last ones; the ring is bounded by `window`."""

    def step(st, row):
        total, n = st["base"]
        if n < baseline_rows:
            total, n = total + row.score, n + 1
        last = [*st["last"], row.score][-window:]
        degradation = round(total / n - sum(last) / len(last), 9)
        # the baseline is known once its rows have been seen
        alert = n >= baseline_rows and len(last) >= min_rows and degradation > threshold
        rows = st["rows"] + 1
        return {"base": [total, n], "last": last, "rows": rows}, (degradation, alert, rows)

    return step


def stream_quality(scores: DataFrame, key: str = "adapter", baseline_rows: int = 500, window: int = 500, min_rows: int = 50, threshold: float = 0.1, delay: str = "10 minutes") -> DataFrame:
    """`rows` counts the rows of a key so far, from 1; before the baseline is complete there is no alert. In event time; the
    baseline belongs to the key, so its state stays."""
    step = quality_step(baseline_rows, window, min_rows, threshold)
    return fold_stream(scores, [key], ORDER, quality_start, step, "degradation double, alert boolean, rows bigint", delay)


def drift_start() -> dict:
    return {"n": 0, "s": None, "q": None}


def drift_step(row_stats: Mapping[str, list[float]], min_rows: int):
    """Running per-dimension sums against a fixed baseline (mean, std per dimension)."""
    import math

    mean, std = row_stats["mean"], row_stats["std"]

    def step(st, row):
        v = [float(x) for x in row.v]
        n = st["n"] + 1
        s = v if st["s"] is None else [a + b for a, b in zip(st["s"], v)]
        q = [x * x for x in v] if st["q"] is None else [a + x * x for a, x in zip(st["q"], v)]
        score = None
        if n >= min_rows:
            mu = [a / n for a in s]
            sd = [math.sqrt(max(b / n - m * m, 0.0)) + 1e-10 for b, m in zip(q, mu)]
            a = sum(abs((m - bm) / bs) for m, bm, bs in zip(mu, mean, std)) / len(mean)
            b = sum(abs(math.log(x / bs)) for x, bs in zip(sd, std)) / len(mean)
            score = 0.7 * a + 0.3 * b
        return {"n": n, "s": s, "q": q}, (score,)

    return step


def stream_drift(vectors: DataFrame, key: str, baseline: Mapping[str, list[float]], min_rows: int = 100, delay: str = "10 minutes") -> DataFrame:
    """Drift score after every vector of a key, against per-dimension baseline statistics. In event time; the running sums
    belong to the key, so its state stays."""
    return fold_stream(vectors, [key], ORDER, drift_start, drift_step(baseline, min_rows), "drift_score double", delay)


def alert_start() -> dict:
    return {"since": None, "sent": None}


def alert_step(window: float):
    """Rows are evaluated rule outcomes: pending, firing and deduplication in one state."""

    def step(st, row):
        if not row.met:
            return {"since": None, "sent": st["sent"]}, (False, False)
        since = row.sec if st["since"] is None else st["since"]
        firing = row.sec - since >= row.for_seconds
        send = firing and (st["sent"] is None or row.sec - st["sent"] >= window)
        return {"since": since, "sent": row.sec if send else st["sent"]}, (firing, send)

    return step


def stream_alerts(points: DataFrame, rules: list[Rule], key: str = "fingerprint", window: float = 300.0, delay: str = "10 minutes") -> DataFrame:
    """Metric points (metric, sec, seq, value, fingerprint) to firing and sent alerts, in event time. The state
    of a series that is not pending goes once the window after its last sent alert is over."""
    from plumbline.operators.alerts import rule_eval

    e = rule_eval(points, rules)
    quiet = lambda state: window if state["since"] is None else None
    return fold_stream(e, ["rule", key], ORDER, alert_start, alert_step(window), "firing boolean, sent boolean", delay, quiet)
