"""Stateful operators in batch and stream form, stream twins of aggregates."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators.alerts import Rule
from plumbline.operators.timeseries import seconds
from plumbline.streaming import limits as L
from plumbline.streaming import streams as ST

W = B.with_ctes
DAY = 86400.0
NONE = "0 seconds"  # the table is one file: nothing comes late, and nothing has to wait behind the last row


def recursive(names, body):
    return W(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


def shaped(r):
    k = F.concat(F.lit("k="), F.col("tokens_out").cast("string"), F.lit(":"), F.col("adapter"))
    return r.select(F.col("request_id").alias("seq"), "user_id", "adapter", seconds("ts").alias("sec"), "success", k.alias("cache_key"))


def events(spark, d):
    return shaped(B.requests(spark, d))


def event_stream(spark, d):
    return ST.table_stream(spark, d, "events.parquet", B.table(spark, d, "events").schema)


def request_stream(spark, d):
    return B.request_columns(event_stream(spark, d))


def _num(key):
    return f", n AS (SELECT request_id AS seq, *, epoch(ts) AS sec, 'k=' || tokens_out || ':' || adapter AS cache_key, row_number() OVER (PARTITION BY {key} ORDER BY epoch(ts), request_id) AS rn FROM requests)"


def _num_c(key):
    return f", c0 AS (SELECT *, 'k=' || tokens_out || ':' || adapter AS cache_key FROM requests), n AS (SELECT request_id AS seq, *, epoch(ts) AS sec, row_number() OVER (PARTITION BY {key} ORDER BY epoch(ts), request_id) AS rn FROM c0)"


RATE = 3 / 43200.0
_BUCKET = recursive(
    "requests",
    _num("user_id") + f""", w AS (SELECT seq, user_id, rn, sec, 2e0 AS tokens, true AS allowed, 2 AS remaining, 0e0 AS retry_after FROM n WHERE rn = 1
UNION ALL SELECT n.seq, n.user_id, n.rn, n.sec, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, t >= 1, CASE WHEN t >= 1 THEN floor(t - 1)::INT ELSE 0 END, CASE WHEN t >= 1 THEN 0e0 ELSE (1-t)/{RATE!r} END
 FROM (SELECT n.*, least(3e0, w.tokens + (n.sec - w.sec)*{RATE!r}) AS t FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1) n)
SELECT seq, allowed, remaining::BIGINT AS remaining, retry_after FROM w""",
)


def _limit_cols(df):
    return df.select("seq", "allowed", F.col("remaining").cast("bigint").alias("remaining"), "retry_after")


@query("token_bucket", _BUCKET)
def _(spark, d):
    return _limit_cols(L.token_bucket(events(spark, d), "user_id", 3, 3, 43200.0))


@query("stream_token_bucket", _BUCKET)
def _(spark, d):
    s = L.token_bucket_stream(shaped(request_stream(spark, d)), "user_id", 3, 3, 43200.0, delay=NONE)
    return _limit_cols(ST.run_to_files(s, "token-bucket"))


def _window_sql(limit):
    return recursive(
        "requests users",
        _num("user_id") + f""", m AS (SELECT n.*, floor(sec/8640)::BIGINT AS slot, {limit} AS lim FROM n JOIN users USING (user_id)),
w AS (SELECT seq, user_id, rn, [slot] AS log, true AS allowed, lim - 1 AS remaining FROM m WHERE rn = 1
UNION ALL SELECT seq, user_id, rn, CASE WHEN len(l) < lim THEN list_append(l, slot) ELSE l END, len(l) < lim, CASE WHEN len(l) < lim THEN lim - len(l) - 1 ELSE 0 END
 FROM (SELECT m.*, list_filter(w.log, lambda x: x > m.slot - 10) AS l FROM w JOIN m ON m.user_id = w.user_id AND m.rn = w.rn + 1))
SELECT seq, allowed, remaining::BIGINT AS remaining FROM w""",
    )


@query("sliding_window_limit", _window_sql("4"))
def _(spark, d):
    e = events(spark, d).withColumn("lim", F.lit(4))
    return L.sliding_window_limit(e, ["user_id"], "lim", DAY).select("seq", "allowed", "remaining")


TIERS = {"free": 3, "basic": 4, "pro": 5, "enterprise": 8}


@query("tiered_limit", _window_sql("CASE tier WHEN 'pro' THEN 5 WHEN 'enterprise' THEN 8 ELSE 3 END"))
def _(spark, d):
    return L.tiered_limit(events(spark, d), B.users(spark, d), "user_id", TIERS, DAY).select("seq", "allowed", "remaining")


@query("stream_sliding_window", _window_sql("4"))
def _(spark, d):
    s = L.sliding_window_stream(shaped(request_stream(spark, d)), ["user_id"], 4, DAY, delay=NONE)
    return ST.run_to_files(s, "sliding-window").select("seq", "allowed", "remaining")


@query("stream_tiered_limit", _window_sql("CASE tier WHEN 'pro' THEN 5 WHEN 'enterprise' THEN 8 ELSE 3 END"))
def _(spark, d):
    s = L.tiered_stream(shaped(request_stream(spark, d)), B.users(spark, d), "user_id", TIERS, DAY, delay=NONE)
    return ST.run_to_files(s, "tiered").select("seq", "allowed", "remaining")


_LOG = recursive(
    "requests",
    _num("user_id") + """, w AS (SELECT seq, user_id, rn, [sec] AS log, true AS allowed, 3 AS remaining, 0e0 AS retry_after FROM n WHERE rn = 1
UNION ALL SELECT seq, user_id, rn, CASE WHEN len(l) < 4 THEN list_append(l, sec) ELSE l END, len(l) < 4, CASE WHEN len(l) < 4 THEN 4 - len(l) - 1 ELSE 0 END, CASE WHEN len(l) < 4 THEN 0e0 ELSE greatest(0e0, l[1] + 86400 - sec) END
 FROM (SELECT n.*, list_filter(w.log, lambda x: x > n.sec - 86400) AS l FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1))
SELECT seq, allowed, remaining::BIGINT AS remaining, retry_after FROM w""",
)


@query("sliding_log_limit", _LOG)
def _(spark, d):
    return _limit_cols(L.sliding_log_limit(events(spark, d), "user_id", 4, DAY))


@query("stream_sliding_log", _LOG)
def _(spark, d):
    return _limit_cols(ST.run_to_files(L.sliding_log_stream(shaped(request_stream(spark, d)), "user_id", 4, DAY, delay=NONE), "sliding-log"))


_TTL = recursive(
    "requests",
    _num_c("cache_key") + """, w AS (SELECT seq, cache_key, rn, sec AS since, false AS hit FROM n WHERE rn = 1
UNION ALL SELECT n.seq, n.cache_key, n.rn, CASE WHEN n.sec - w.since < 86400 THEN w.since ELSE n.sec END, n.sec - w.since < 86400 FROM w JOIN n ON n.cache_key = w.cache_key AND n.rn = w.rn + 1)
SELECT seq, hit FROM w""",
)


@query("ttl_cache_hits", _TTL)
def _(spark, d):
    return L.ttl_cache_hits(events(spark, d), "cache_key", DAY).select("seq", "hit")


@query("stream_ttl_cache", _TTL)
def _(spark, d):
    return ST.run_to_files(L.ttl_cache_stream(shaped(request_stream(spark, d)), "cache_key", DAY, delay=NONE), "ttl-cache").select("seq", "hit")


_BREAK = recursive(
    "requests",
    _num("adapter") + """, w AS (SELECT seq, adapter, rn, true AS proceeded, 'closed' AS state, CASE WHEN success THEN 0 ELSE 1 END AS fails, CASE WHEN success THEN 0e0 ELSE sec END AS lf FROM n WHERE rn = 1
UNION ALL SELECT seq, adapter, rn, go, CASE WHEN NOT go THEN 'open' WHEN success THEN 'closed' WHEN fails + 1 >= 2 THEN 'open' ELSE st END,
 CASE WHEN NOT go THEN fails WHEN success THEN 0 ELSE fails + 1 END, CASE WHEN go AND NOT success THEN sec ELSE lf END
 FROM (SELECT n.*, w.fails, w.lf, NOT (w.state = 'open' AND n.sec - w.lf <= 3600) AS go, CASE WHEN w.state = 'open' THEN 'half-open' ELSE w.state END AS st FROM w JOIN n ON n.adapter = w.adapter AND n.rn = w.rn + 1))
SELECT seq, proceeded, state FROM w""",
)


@query("failure_breaker", _BREAK)
def _(spark, d):
    return L.failure_breaker(events(spark, d), "adapter", 2, 3600.0).select("seq", "proceeded", "state")


@query("stream_failure_breaker", _BREAK)
def _(spark, d):
    return ST.run_to_files(L.breaker_stream(shaped(request_stream(spark, d)), "adapter", 2, 3600.0, delay=NONE), "breaker").select("seq", "proceeded", "state")


# --- built-in aggregation; a window is emitted once the watermark has passed its end


@query(
    "windowed_request_stats",
    W("requests", """, g AS (SELECT (floor(epoch(ts)/3600)*3600)::BIGINT AS window_start, adapter, count(*) AS requests, avg((NOT success)::INT::DOUBLE) AS error_ratio, avg(latency_ms) AS mean_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM requests GROUP BY 1, 2)
SELECT * FROM g WHERE window_start + 3600 <= (SELECT epoch(max(ts)) - 600 FROM requests)"""),
)
def _(spark, d):
    return ST.run_to_files(ST.windowed_request_stats(request_stream(spark, d), "1 hour"), "windowed")


@query(
    "windowed_request_stats_batch",
    W("requests", """SELECT (floor(epoch(ts)/3600)*3600)::BIGINT AS window_start, adapter, count(*) AS requests, avg((NOT success)::INT::DOUBLE) AS error_ratio, avg(latency_ms) AS mean_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM requests GROUP BY 1, 2"""),
)
def _(spark, d):
    return ST.windowed_request_stats(B.requests(spark, d), "1 hour")


@query(
    "stream_downsample",
    """WITH g AS (SELECT event_type AS name, (floor(epoch(ts)/3600)*3600)::BIGINT AS bucket, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM g WHERE bucket + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""",
)
def _(spark, d):
    p = event_stream(spark, d).select(F.col("event_type").alias("name"), "ts", "value")
    return ST.run_to_files(ST.stream_downsample(p, "1 hour"), "downsample")


@query("stream_dedup", "SELECT event_id, value FROM events")
def _(spark, d):
    """Every event is delivered twice."""
    e = event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = e.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return ST.run_to_files(ST.stream_dedup(twice, "event_id").select("event_id", "value"), "dedup")


_BUDGET = """, g AS (SELECT user_id, tier, (floor(epoch(ts)/86400)*86400)::BIGINT AS window_start, sum(tokens_in + tokens_out)::BIGINT AS tokens FROM requests JOIN users USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id, window_start, tokens, tokens > CASE tier WHEN 'pro' THEN 200 WHEN 'enterprise' THEN 400 ELSE 100 END AS over FROM g"""
_BUDGETS = {"free": 100, "pro": 200, "enterprise": 400}


@query("token_budget", W("requests users", _BUDGET))
def _(spark, d):
    return ST.token_budget(B.requests(spark, d), B.users(spark, d), _BUDGETS, "1 day")


@query("stream_token_budget", W("requests users", _BUDGET + " WHERE window_start + 86400 <= (SELECT epoch(max(ts)) - 600 FROM requests)"))
def _(spark, d):
    return ST.run_to_files(ST.token_budget(request_stream(spark, d), B.users(spark, d), _BUDGETS, "1 day"), "budget")


def scored(r):
    s = F.col("request_id") * 7919 % 1000 / 1000.0
    return r.select(F.col("request_id").alias("seq"), "adapter", seconds("ts").alias("sec"), s.alias("score"))


@query(
    "stream_quality",
    W("requests", """, s AS (SELECT request_id AS seq, adapter, (request_id*7919 % 1000)/1000e0 AS score, row_number() OVER (PARTITION BY adapter ORDER BY request_id) AS rn FROM requests),
b AS (SELECT adapter, avg(score) AS b FROM s WHERE rn <= 50 GROUP BY 1),
r AS (SELECT seq, adapter, rn, round(b - avg(score) OVER (PARTITION BY adapter ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS dg FROM s JOIN b USING (adapter))
SELECT seq, adapter, dg > 0.01e0 AS alert FROM r WHERE rn >= 50"""),
)
def _(spark, d):
    s = ST.stream_quality(scored(request_stream(spark, d)), "adapter", 50, 50, 50, 0.01, delay=NONE)
    return ST.run_to_files(s, "quality").where("rows >= 50").select("seq", "adapter", "alert")


@query("stream_drift")
def _(spark, d):
    """Vectors with an odd id against the baseline of the even ones."""
    from plumbline.operators.drift import embedding_baseline

    v = B.vectors(spark, d)
    base = embedding_baseline(v.where("vec_id % 2 = 0")).orderBy("pos").collect()  # one row per dimension
    stats = {"mean": [r["mean"] for r in base], "std": [r["std"] for r in base]}
    s = ST.table_stream(spark, d, "embeddings.parquet", B.table(spark, d, "embeddings").schema).where("vec_id % 2 = 1")
    s = s.select(F.col("vec_id").alias("seq"), F.col("vec_id").cast("double").alias("sec"), B.adapter_of(F.col("label")).alias("adapter"), F.col("embedding").cast("array<double>").alias("v"))
    return ST.run_to_files(ST.stream_drift(s, "adapter", stats, 20, delay=NONE), "drift").select("seq", "adapter", "drift_score")


@query(
    "stream_alerts",
    """WITH RECURSIVE n AS (SELECT event_id AS seq, event_type AS fp, epoch(ts) AS sec, value > 20 AS met, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT seq, fp, rn, CASE WHEN met THEN sec END AS since, NULL::DOUBLE AS sent_at, false AS firing, false AS sent FROM n WHERE rn = 1
UNION ALL SELECT seq, fp, rn, since2, CASE WHEN f AND (sent_at IS NULL OR sec - sent_at >= 14400) THEN sec ELSE sent_at END, f, f AND (sent_at IS NULL OR sec - sent_at >= 14400)
 FROM (SELECT x.*, coalesce(met AND sec - since2 >= 600, false) AS f FROM (SELECT n.*, w.sent_at, CASE WHEN n.met THEN coalesce(w.since, n.sec) END AS since2 FROM w JOIN n ON n.fp = w.fp AND n.rn = w.rn + 1) x))
SELECT seq, firing, sent FROM w""",
)
def _(spark, d):
    p = event_stream(spark, d).select(
        F.lit("value").alias("metric"), F.col("event_id").alias("seq"), seconds("ts").alias("sec"), "value", F.col("event_type").alias("fingerprint")
    )
    rules = [Rule("high_value", "value", "value > 20", "warning", "'high'", 600)]
    return ST.run_to_files(ST.stream_alerts(p, rules, window=14400.0, delay=NONE), "alerts").select("seq", "firing", "sent")
