"""Request statistics."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import monitoring as M

R = lambda body: B.with_ctes("requests", body)

_STATS = """count(*) AS total_requests, avg(success::INT::DOUBLE) AS success_rate, avg(latency_ms) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
 coalesce(avg(CASE WHEN latency_ms > 0 AND tokens_out > 0 THEN tokens_out*1000e0/latency_ms END),0e0) AS mean_tokens_per_sec,
 sum(tokens_in)::BIGINT AS total_tokens_in, sum(tokens_out)::BIGINT AS total_tokens_out,
 quantile_cont(latency_ms,0.5) AS median_ms, quantile_cont(latency_ms,0.95) AS p95_ms, quantile_cont(latency_ms,0.99) AS p99_ms"""


@query("tokens_per_second", R("SELECT request_id, CASE WHEN latency_ms > 0 THEN tokens_out*1000e0/latency_ms ELSE 0e0 END AS tps FROM requests"))
def _(spark, d):
    return B.requests(spark, d).select("request_id", M.tokens_per_second(F.col("tokens_out"), F.col("latency_ms")).alias("tps"))


@query("performance_stats", R(f"SELECT {_STATS} FROM requests"))
def _(spark, d):
    return M.performance_stats(B.requests(spark, d))


@query("performance_stats_by_adapter", R(f"SELECT adapter, {_STATS} FROM requests GROUP BY adapter"))
def _(spark, d):
    return M.performance_stats(B.requests(spark, d), ["adapter"])


@query(
    "performance_stats_recent",
    R(f"SELECT {_STATS} FROM (SELECT * FROM requests WHERE ts >= (SELECT max(ts) FROM requests) - INTERVAL 7 DAY ORDER BY ts DESC, request_id DESC LIMIT 1000)"),
)
def _(spark, d):
    return M.performance_stats(M.recent_requests(B.requests(spark, d), last=1000, seconds=7 * 86400.0))


@query(
    "performance_stats_located",
    R("SELECT adapter, quantile_cont(latency_ms,0.5) AS p50, quantile_cont(latency_ms,0.95) AS p95, quantile_cont(latency_ms,0.99) AS p99 FROM requests GROUP BY adapter"),
)
def _(spark, d):
    """The quantile plan for groups too large for one buffer, forced on."""
    from plumbline.plans.ordering import group_quantiles

    return group_quantiles(B.requests(spark, d), ["adapter"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(
    "adapter_breakdown",
    R("SELECT adapter, count(*) AS requests, avg(success::INT::DOUBLE) AS success_rate, avg(latency_ms) AS mean_latency_ms, quantile_cont(latency_ms,0.95) AS p95_latency_ms FROM requests GROUP BY adapter"),
)
def _(spark, d):
    return M.adapter_breakdown(B.requests(spark, d))


@query(
    "cost_estimate",
    R("""SELECT i/1000*0.001e0 + o/1000*0.002e0 AS total_cost, i/1000*0.001e0 AS input_cost, o/1000*0.002e0 AS output_cost, i::BIGINT AS tokens_in, o::BIGINT AS tokens_out
FROM (SELECT sum(tokens_in)::DOUBLE AS i, sum(tokens_out)::DOUBLE AS o FROM requests)"""),
)
def _(spark, d):
    return M.cost_estimate(B.requests(spark, d))


@query(
    "request_alerts",
    R(""", r AS (SELECT *, avg((NOT success)::INT::DOUBLE) OVER (ORDER BY ts, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS er FROM requests)
SELECT request_id, 'high_latency' AS type, latency_ms AS value, 2000e0 AS threshold FROM r WHERE latency_ms > 2000
UNION ALL SELECT request_id, 'high_error_rate', er, 0.25e0 FROM r WHERE er > 0.25e0"""),
)
def _(spark, d):
    return M.request_alerts(B.requests(spark, d), latency_limit=2000.0, error_limit=0.25, block=512)


@query(
    "latency_histogram",
    R(""", b AS (SELECT unnest(['0.01','0.05','0.1','0.25','0.5','1.0','2.5','5.0','10.0','+Inf']) AS le)
SELECT adapter, le, count(*) FILTER (WHERE le = '+Inf' OR latency_ms/1000 <= CASE WHEN le='+Inf' THEN 0 ELSE le::DOUBLE END) AS cumulative_count FROM requests, b GROUP BY adapter, le""".replace("CASE WHEN le='+Inf' THEN 0 ELSE le::DOUBLE END", "coalesce(try_cast(replace(le,'+Inf','0') AS DOUBLE),0)")),
)
def _(spark, d):
    return M.latency_histogram(B.requests(spark, d))


@query(
    "request_counters",
    R("""SELECT 'requests_total' AS metric, adapter AS label, CASE WHEN success THEN 'success' ELSE 'error' END AS sublabel, count(*) AS value FROM requests GROUP BY ALL
UNION ALL SELECT 'tokens_total','in','',sum(tokens_in)::BIGINT FROM requests UNION ALL SELECT 'tokens_total','out','',sum(tokens_out)::BIGINT FROM requests"""),
)
def _(spark, d):
    return M.request_counters(B.requests(spark, d))


@query(
    "resource_summary",
    """WITH t AS (SELECT event_id AS id, ts, value AS cpu, value/2 AS memory FROM events ORDER BY ts DESC, event_id DESC LIMIT 60)
SELECT avg(cpu) AS cpu_avg, avg(memory) AS memory_avg, (SELECT string_agg(id::VARCHAR, ',' ORDER BY ts DESC, id DESC) FROM (SELECT * FROM t ORDER BY ts DESC, id DESC LIMIT 10)) AS newest_ids FROM t""",
)
def _(spark, d):
    e = B.table(spark, d, "events")
    return M.resource_summary(e.select(F.col("event_id").alias("id"), "ts", F.col("value").alias("cpu"), (F.col("value") / 2).alias("memory")))


@query(
    "dashboard_summary",
    R("""SELECT count(*) AS total_requests, avg(success::INT::DOUBLE) AS success_rate, avg(latency_ms) AS avg_latency_ms, quantile_cont(latency_ms,0.95) AS p95_latency_ms,
 count(DISTINCT adapter) AS adapters_active, sum(tokens_in)::DOUBLE/1000*0.001e0 + sum(tokens_out)::DOUBLE/1000*0.002e0 AS total_cost,
 CASE WHEN avg(success::INT::DOUBLE) > 0.95e0 THEN 'healthy' ELSE 'degraded' END AS health FROM requests"""),
)
def _(spark, d):
    return M.dashboard_summary(B.requests(spark, d))


@query(
    "gateway_stats",
    R("""SELECT count(*) AS requests_total, count(*) FILTER (WHERE success) AS requests_success, count(*) FILTER (WHERE NOT success) AS requests_failed, count(*) FILTER (WHERE cached) AS cache_hits,
 count(*) FILTER (WHERE success)/count(*) AS success_rate, sum(latency_ms) FILTER (WHERE success)/count(*) FILTER (WHERE success) AS avg_latency_success_ms, avg(latency_ms) AS avg_latency_all_ms,
 floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS uptime_seconds FROM requests"""),
)
def _(spark, d):
    return M.gateway_stats(B.requests(spark, d))


@query(
    "bench_summary",
    R("""SELECT adapter, avg(latency_ms) AS mean_ms, stddev_samp(latency_ms) AS std_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, count(*) AS n, count(*)*1000e0/sum(latency_ms) AS throughput,
 list_sort(list(latency_ms))[least(floor(count(*)*0.95e0), count(*)-1)::INT+1] AS p95_ms, list_sort(list(latency_ms))[least(floor(count(*)*0.99e0), count(*)-1)::INT+1] AS p99_ms, median(latency_ms) AS median_ms FROM requests GROUP BY adapter"""),
)
def _(spark, d):
    return M.bench_summary(B.requests(spark, d), ["adapter"])


@query(
    "system_eval_latency",
    R("""SELECT avg(latency_ms) AS mean_ms, stddev_pop(latency_ms) AS std_ms, count(*)/(sum(latency_ms)/1000) AS throughput_qps, quantile_cont(latency_ms,0.5) AS p50_ms, quantile_cont(latency_ms,0.95) AS p95_ms, quantile_cont(latency_ms,0.99) AS p99_ms FROM requests"""),
)
def _(spark, d):
    return M.system_eval_latency(B.requests(spark, d))


@query(
    "best_variant",
    """WITH r AS (SELECT event_type AS study, user_id AS variant, avg(value) AS score FROM events GROUP BY ALL)
SELECT study, variant, score FROM r QUALIFY row_number() OVER (PARTITION BY study ORDER BY score DESC, variant) = 1""",
)
def _(spark, d):
    r = B.table(spark, d, "events").groupBy(F.col("event_type").alias("study"), F.col("user_id").alias("variant")).agg(F.avg("value").alias("score"))
    return M.best_variant(r, "study", "variant", "score")


@query("weighted_mean_meter", R("SELECT adapter, sum(latency_ms*tokens_out)/sum(tokens_out) AS avg, sum(tokens_out)::BIGINT AS count FROM requests GROUP BY adapter"))
def _(spark, d):
    return M.weighted_mean_meter(B.requests(spark, d), "adapter", "latency_ms", "tokens_out")


_U = "('0x'||substr(md5(request_id::VARCHAR || '|profile|0|42'),1,8))::BIGINT/4294967296e0"


@query("slow_requests", R(f"SELECT request_id, latency_ms, latency_ms > 1000 AS slow, {_U} < 0.01e0 AS profiled FROM requests WHERE latency_ms > 1000 OR {_U} < 0.01e0"))
def _(spark, d):
    return M.slow_requests(B.requests(spark, d))


@query(
    "prom_text_export",
    R(""", g AS (SELECT count(*) AS t, count(*) FILTER (WHERE success) AS s, count(*) FILTER (WHERE NOT success) AS f, count(*) FILTER (WHERE cached) AS c,
 sum(latency_ms) FILTER (WHERE success) AS l, floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS u FROM requests),
p AS (SELECT unnest([{n:0,t:'# HELP requests_total Total requests'},{n:1,t:'# TYPE requests_total counter'},{n:2,t:'requests_total '||t},
{n:3,t:'# HELP requests_success Successful requests'},{n:4,t:'# TYPE requests_success counter'},{n:5,t:'requests_success '||s},
{n:6,t:'# HELP requests_failed Failed requests'},{n:7,t:'# TYPE requests_failed counter'},{n:8,t:'requests_failed '||f},
{n:9,t:'# HELP cache_hits Cache hit count'},{n:10,t:'# TYPE cache_hits counter'},{n:11,t:'cache_hits '||c},
{n:12,t:'# HELP success_rate Request success rate'},{n:13,t:'# TYPE success_rate gauge'},{n:14,t:printf('success_rate %.4f', s/t)},
{n:15,t:'# HELP avg_latency_ms Average latency in ms'},{n:16,t:'# TYPE avg_latency_ms gauge'},{n:17,t:printf('avg_latency_ms %.2f', l/s)},
{n:18,t:'# HELP uptime_seconds API uptime'},{n:19,t:'# TYPE uptime_seconds counter'},{n:20,t:'uptime_seconds '||u}]) AS x FROM g)
SELECT x.n::INT AS line_no, x.t AS line FROM p"""),
)
def _(spark, d):
    g = M.gateway_stats(B.requests(spark, d)).withColumnRenamed("avg_latency_success_ms", "avg_latency_ms")
    return M.prom_text(g, M.GATEWAY_METRICS)
