"""Metric store queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import timeseries as T
from plumbline.operators.monitoring import latency_histogram

W = B.with_ctes
_START = "TIMESTAMP '2024-01-05'"
_END = "TIMESTAMP '2024-01-20'"


def _range(c):
    return F.lit(c).cast("timestamp_ntz")


@query(
    "metric_query",
    W("metrics", f"SELECT event_id, value, name || '{{adapter=' || adapter || ',user=' || usr || '}}' AS series FROM metrics WHERE name LIKE '%i%' AND adapter = 'code' AND ts BETWEEN {_START} AND {_END}"),
)
def _(spark, d):
    q = T.metric_query(B.metrics(spark, d), "*i*", {"adapter": "code"}, _range("2024-01-05"), _range("2024-01-20"))
    return q.select("event_id", "value", "series")


@query(
    "downsample",
    W("metrics", "SELECT name || '{adapter=' || adapter || ',user=' || usr || '}' AS series, (floor(epoch(ts)/3600)*3600)::BIGINT AS bucket, avg(value) AS value, count(*) AS n FROM metrics GROUP BY 1, 2"),
)
def _(spark, d):
    return T.downsample(T.metric_query(B.metrics(spark, d), "*"), ["series"], 3600)


@query("retention", W("metrics", "SELECT event_id, name, value FROM metrics WHERE ts >= (SELECT max(ts) FROM metrics) - INTERVAL 24 HOUR"))
def _(spark, d):
    return T.retention(B.metrics(spark, d)).select("event_id", "name", "value")


@query(
    "metric_summary",
    W("metrics", "SELECT name, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, coalesce(stddev_samp(value),0e0) AS std, median(value) AS median FROM metrics GROUP BY name"),
)
def _(spark, d):
    return T.metric_summary(B.metrics(spark, d), ["name"])


_NEAR = "list_sort(list(value))[least(floor(count(*)*{p}e0), count(*)-1)::INT+1] AS p{n}"
_NEARS = ", ".join(_NEAR.format(p=p / 100, n=p) for p in (50, 90, 95, 99))


@query("metric_percentiles", W("metrics", f"SELECT name, {_NEARS} FROM metrics GROUP BY name"))
def _(spark, d):
    return T.metric_percentiles(B.metrics(spark, d), ["name"], [50, 90, 95, 99])


@query("metric_percentiles_located", W("metrics", f"SELECT {_NEARS} FROM metrics"))
def _(spark, d):
    """One giant metric: ranks located through value buckets."""
    return T.metric_percentiles(B.metrics(spark, d), [], [50, 90, 95, 99])


@query("metric_rate", W("metrics", "SELECT name, (arg_max(value, ts) - arg_min(value, ts)) / (epoch(max(ts)) - epoch(min(ts))) AS rate FROM metrics GROUP BY name"))
def _(spark, d):
    return T.metric_rate(B.metrics(spark, d), ["name"])


@query(
    "counter_rate",
    W("metrics", """, s AS (SELECT name, adapter, ts, value, lag(value) OVER (PARTITION BY name, adapter ORDER BY ts, event_id) AS prev FROM metrics)
SELECT name, adapter, sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS inc,
 sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) / (epoch(max(ts)) - epoch(min(ts))) AS rate FROM s GROUP BY 1, 2"""),
)
def _(spark, d):
    m = B.metrics(spark, d).withColumn("adapter", F.col("labels")["adapter"])
    return T.counter_rate(m, ["name", "adapter"], block=256)


@query(
    "histogram_quantile",
    W("requests", """, b AS (SELECT unnest([0.01e0,0.05e0,0.1e0,0.25e0,0.5e0,1e0,2.5e0,5e0,10e0,'inf'::DOUBLE]) AS le),
h AS (SELECT adapter, le, count(*) FILTER (WHERE latency_ms/1000 <= le) AS c FROM requests, b GROUP BY 1, 2),
q AS (SELECT adapter, le, c, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY adapter)*0.95e0 AS goal FROM h WINDOW w AS (PARTITION BY adapter ORDER BY le))
SELECT adapter, CASE WHEN isinf(le) THEN lo ELSE lo + (le-lo)*(goal-below)/(c-below) END AS quantile FROM q WHERE c >= goal QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY le) = 1"""),
)
def _(spark, d):
    return T.histogram_quantile(latency_histogram(B.requests(spark, d)), ["adapter"], 0.95)


@query(
    "ratio_panels",
    W("requests", """SELECT (floor(epoch(ts)/300)*300)::BIGINT AS window_start, count(*) FILTER (WHERE NOT success)/count(*)*100 AS error_pct, count(*) FILTER (WHERE cached)/count(*)*100 AS cache_hit_pct, count(*)/300e0 AS request_rate FROM requests GROUP BY 1"""),
)
def _(spark, d):
    return T.ratio_panels(B.requests(spark, d), 300)


@query(
    "by_adapter_panels",
    W("requests", """SELECT (floor(epoch(ts)/3600)*3600)::BIGINT AS window_start, adapter, sum(tokens_out)::BIGINT AS tokens, avg(latency_ms) AS avg_latency_ms, sum(latency_ms)/1000/count(*) AS mean_generation_s, count(*) AS requests FROM requests GROUP BY 1, 2"""),
)
def _(spark, d):
    return T.by_adapter_panels(B.requests(spark, d), 3600)


@query("complexity_distribution", W("samples", "SELECT adapter, complexity, count(*) AS rows, avg((id*7919 % 1000)/1000e0) AS avg_confidence FROM samples GROUP BY 1, 2"))
def _(spark, d):
    return T.complexity_distribution(B.samples(spark, d).withColumn("confidence", (F.col("id") * 7919 % 1000) / 1000.0))


@query(
    "grafana_series",
    W("metrics", """, p AS (SELECT name, (floor(epoch(ts)/86400)*86400)::BIGINT AS b, ((200*sum(round(value*100)::BIGINT) + count(*)) // (2*count(*)))/10000e0 AS v FROM metrics GROUP BY 1, 2)
SELECT name AS target, '[' || string_agg('[' || printf('%.4f', v) || ',' || b*1000 || ']', ',' ORDER BY b) || ']' AS datapoints FROM p GROUP BY name"""),
)
def _(spark, d):
    return T.grafana_series(B.metrics(spark, d), 86400)


@query(
    "grafana_blocks",
    W("metrics", f""", p AS (SELECT name, (floor(epoch(ts)/3600)*3600)::BIGINT AS b, ((200*sum(round(value*100)::BIGINT) + count(*)) // (2*count(*)))/10000e0 AS v FROM metrics WHERE ts BETWEEN {_START} AND {_END} GROUP BY 1, 2),
q AS (SELECT name AS target, (floor(b/86400)*86400)::BIGINT AS block_start, count(*) AS n, '[' || string_agg('[' || printf('%.4f', v) || ',' || b*1000 || ']', ',' ORDER BY b) || ']' AS datapoints FROM p GROUP BY 1, 2)
SELECT target, row_number() OVER (PARTITION BY target ORDER BY block_start) - 1 AS block, block_start, n, datapoints FROM q"""),
)
def _(spark, d):
    return T.grafana_blocks(B.metrics(spark, d), 3600, _range("2024-01-05"), _range("2024-01-20"), per_block=24)


@query("metric_names", W("metrics", "SELECT DISTINCT name FROM metrics"))
def _(spark, d):
    return T.metric_names(B.metrics(spark, d))
