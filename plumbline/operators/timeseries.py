"""Metric store queries: selection, downsampling, rates, quantiles from histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import glob_match
from plumbline.plans.ordering import group_quantiles, ranked, rolling_rows


def seconds(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def series_key(name: Column, labels: Column) -> Column:
    parts = F.transform(F.sort_array(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def metric_query(
    metrics: DataFrame, pattern: str, labels: Mapping[str, str] | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Points whose name matches the glob and whose labels contain the required ones."""
    keep = glob_match("name", pattern)
    for k, v in (labels or {}).items():
        keep = keep & (F.try_element_at("labels", F.lit(k)) == v)
    if start is not None:
        keep = keep & (F.col("ts") >= start)
    if end is not None:
        keep = keep & (F.col("ts") <= end)
    return metrics.where(keep).withColumn("series", series_key(F.col("name"), F.col("labels")))


def downsample(points: DataFrame, keys: Sequence[str], interval: float) -> DataFrame:
    """Mean per bucket of `interval` seconds; the point is stamped with the bucket start."""
    b = F.floor(seconds("ts") / F.lit(float(interval)))
    return points.groupBy(*keys, (b * F.lit(int(interval))).alias("bucket")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")
    )


def retention(points: DataFrame, hours: int = 24) -> DataFrame:
    newest = points.agg(F.max("ts").alias("m")).select(F.col("m") - F.make_dt_interval(hours=F.lit(hours)))
    return points.where(F.col("ts") >= newest.scalar())


def metric_summary(points: DataFrame, keys: Sequence[str], **quantile_args) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    ]
    return group_quantiles(points, keys, "value", {"median": 0.5}, aggs, **quantile_args)


def metric_percentiles(points: DataFrame, keys: Sequence[str], percents: Sequence[int], **quantile_args) -> DataFrame:
    """Nearest rank: sorted[min(int(n*p/100), n-1)]."""
    probs = {f"p{p}": p / 100 for p in percents}
    return group_quantiles(points, keys, "value", probs, method="nearest", **quantile_args)


def metric_rate(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(last - first) / elapsed per series; 0 for a single point. No window, one aggregation."""
    at = F.struct("ts", "event_id")
    g = points.groupBy(*keys).agg(
        F.min_by("value", at).alias("v0"), F.max_by("value", at).alias("v1"),
        F.min(seconds("ts")).alias("t0"), F.max(seconds("ts")).alias("t1"),
    )
    dt = F.col("t1") - F.col("t0")
    return g.select(*keys, F.when(dt > 0, (F.col("v1") - F.col("v0")) / dt).otherwise(0.0).alias("rate"))


def counter_rate(points: DataFrame, keys: Sequence[str], block: int = 8192) -> DataFrame:
    """Reset-aware increase per second: a drop counts as a restart from zero. No extrapolation."""
    r = ranked(points.select(*keys, "ts", "event_id", "value"), ["ts", "event_id"], keys)
    r = rolling_rows(r, {"prev": F.first("value"), "k": F.count(F.lit(1))}, 1, keys=keys, block=block)
    step = F.when(F.col("k") < 2, 0.0).when(F.col("value") >= F.col("prev"), F.col("value") - F.col("prev")).otherwise(F.col("value"))
    g = r.groupBy(*keys).agg(F.sum(step).alias("inc"), F.min(seconds("ts")).alias("t0"), F.max(seconds("ts")).alias("t1"))
    dt = F.col("t1") - F.col("t0")
    return g.select(*keys, "inc", F.when(dt > 0, F.col("inc") / dt).otherwise(0.0).alias("rate"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], phi: float) -> DataFrame:
    """Quantile from cumulative buckets (le as text), linear inside the bucket that holds it.

    The windows run over one histogram: as many rows as it has bounds.
    """
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
    w = Window.partitionBy(*keys).orderBy("bound")
    b = buckets.withColumn("bound", le)
    b = b.select(
        *keys, "bound", "cumulative_count",
        F.coalesce(F.lag("bound").over(w), F.lit(0.0)).alias("lo"),
        F.coalesce(F.lag("cumulative_count").over(w), F.lit(0)).alias("below"),
        F.max("cumulative_count").over(Window.partitionBy(*keys)).alias("total"),
    ).withColumn("goal", F.col("total") * F.lit(phi))
    hit = b.where((F.col("cumulative_count") >= F.col("goal")) & (F.col("total") > 0))
    inside = F.col("lo") + (F.col("bound") - F.col("lo")) * (F.col("goal") - F.col("below")) / (F.col("cumulative_count") - F.col("below"))
    q = F.when(F.col("bound") == float("inf"), F.col("lo")).otherwise(inside)
    return hit.groupBy(*keys).agg(F.min_by(q, F.col("bound")).alias("quantile"))


def ratio_panels(requests: DataFrame, width_seconds: int) -> DataFrame:
    b = (F.floor(seconds("ts") / width_seconds) * width_seconds).alias("window_start")
    n = F.count(F.lit(1))
    return requests.groupBy(b).agg(
        (F.count_if(~F.col("success")) / n * 100).alias("error_pct"),
        (F.count_if("cached") / n * 100).alias("cache_hit_pct"),
        (n / F.lit(float(width_seconds))).alias("request_rate"),
    )


def by_adapter_panels(requests: DataFrame, width_seconds: int) -> DataFrame:
    b = (F.floor(seconds("ts") / width_seconds) * width_seconds).alias("window_start")
    return requests.groupBy(b, "adapter").agg(
        F.sum("tokens_out").alias("tokens"), F.avg("latency_ms").alias("avg_latency_ms"),
        (F.sum("latency_ms") / 1000 / F.count(F.lit(1))).alias("mean_generation_s"),
        F.count(F.lit(1)).alias("requests"),
    )


def complexity_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("adapter", "complexity").agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence"))


def _panel_pairs(points: DataFrame, interval: int, start: Column | None, end: Column | None) -> DataFrame:
    """(name, bucket, p): one [value, ts_ms] pair as JSON text per series and bucket of the time range.

    The range is a condition on the stored timestamp, so it reaches the scan.
    """
    inside = points if start is None else points.where(F.col("ts") >= start)
    inside = inside if end is None else inside.where(F.col("ts") <= end)
    b = F.floor(seconds("ts") / F.lit(float(interval))) * F.lit(int(interval))
    # printed numbers are averaged in exact decimals, so a tie does not depend on row order
    mean = F.round(F.avg(F.col("value").cast("decimal(18,6)")), 4)
    p = inside.groupBy("name", b.alias("bucket")).agg(mean.alias("value"))
    pair = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(","), (F.col("bucket") * 1000).cast("string"), F.lit("]"))
    return p.select("name", "bucket", pair.alias("p"))


def _joined_pairs() -> Column:
    listed = F.sort_array(F.collect_list(F.struct("bucket", "p")))
    return F.concat(F.lit("["), F.array_join(F.transform(listed, lambda s: s["p"]), ","), F.lit("]"))


def grafana_series(points: DataFrame, interval: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Per target the [value, ts_ms] pairs as JSON text; lists are built after downsampling.

    One row per series: for panels, whose range and interval bound the buckets. `grafana_blocks` has no such row.
    """
    p = _panel_pairs(points, interval, start, end)
    return p.groupBy(F.col("name").alias("target")).agg(_joined_pairs().alias("datapoints"))


def grafana_blocks(
    points: DataFrame, interval: int, start: Column | None = None, end: Column | None = None, per_block: int = 1000
) -> DataFrame:
    """(target, block, block_start, n, datapoints): a series in time order, cut into lists of at most `per_block` buckets.

    Blocks lie on a fixed grid of interval * per_block seconds, so they don't depend on the range; `block` numbers those of a
    series that hold points from 0, in time order. Rows meet per (target, block): neither a long series nor a hot one is a
    list or a task of its own. Points without a time or value are left out, and so is a series without any.
    """
    width = int(interval) * per_block
    at = F.floor(F.col("bucket") / F.lit(width)) * F.lit(width)
    p = _panel_pairs(points, interval, start, end).where("p is not null")
    blocks = p.groupBy(F.col("name").alias("target"), at.cast("bigint").alias("block_start")).agg(
        F.count(F.lit(1)).alias("n"), _joined_pairs().alias("datapoints")
    )
    # only the numbers of blocks go through the window, not their lists
    numbers = ranked(blocks.select("target", "block_start"), ["block_start"], ["target"])
    numbers = numbers.select(F.col("target").alias("t"), F.col("block_start").alias("s"), (F.col("rank") - 1).alias("block"))
    same = F.col("target").eqNullSafe(F.col("t")) & (F.col("block_start") == F.col("s"))
    return blocks.join(numbers, same).select("target", "block", "block_start", "n", "datapoints")


def metric_names(points: DataFrame) -> DataFrame:
    return points.select("name").distinct()
