"""SQL analytics, joins, set operations."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import sqlviews as S

W = B.with_ctes

# averages over whole tenths and thousandths, rounded half up in integers: no floating-point ties
_T = "sum(round(latency_ms*10)::BIGINT)"
AVG0 = f"((2*{_T} + 10*count(*)) // (20*count(*)))::BIGINT"
AVG2 = f"((20*{_T} + count(*)) // (2*count(*)))/100e0"
AVG3 = "((2*sum(round(overall_score*1000)::BIGINT) + count(overall_score)) // (2*count(overall_score)))/1000e0"


@query(
    "daily_metrics",
    W("requests", f"""SELECT strftime(ts,'%Y-%m-%d') AS date, user_id, count(*) AS total_requests, count(*) FILTER (WHERE cached) AS cached_requests, {AVG0} AS avg_latency_ms,
 sum(tokens_out)::BIGINT AS total_tokens, count(*) FILTER (WHERE NOT success) AS error_count FROM requests GROUP BY 1, 2"""),
)
def _(spark, d):
    return S.daily_metrics(B.requests(spark, d)).withColumn("date", F.col("date").cast("string"))


@query(
    "request_summary",
    W("requests evaluations users", """SELECT r.request_id, r.adapter, r.latency_ms, r.cached, e.overall_score, e.is_failure, u.email AS user_email
 FROM requests r LEFT JOIN evaluations e USING (request_id) LEFT JOIN users u USING (user_id)"""),
)
def _(spark, d):
    return S.request_summary(B.requests(spark, d), B.evaluations(spark, d), B.users(spark, d))


_PERF = f"""SELECT adapter, count(*) AS total_requests, {AVG0} AS avg_latency, {AVG3} AS avg_quality,
 count(*) FILTER (WHERE is_failure) AS failures, count(*) FILTER (WHERE cached) AS cache_hits FROM requests LEFT JOIN {{e}} USING (request_id) GROUP BY adapter"""


@query("adapter_performance", W("requests evaluations", _PERF.format(e="evaluations")))
def _(spark, d):
    return S.adapter_performance(B.requests(spark, d), B.evaluations(spark, d))


@query(
    "adapter_performance_dedup",
    W("requests evaluations", ", e1 AS (SELECT * FROM evaluations QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY eval_no DESC) = 1) " + _PERF.format(e="e1")),
)
def _(spark, d):
    return S.adapter_performance(B.requests(spark, d), B.evaluations(spark, d), one_per_request=True)


@query(
    "adapter_daily_rollup",
    W("requests evaluations", f""", e AS (SELECT request_id, sum(round(overall_score*1000)::BIGINT) AS s, count(*) AS c FROM evaluations GROUP BY 1)
SELECT adapter, strftime(ts,'%Y-%m-%d') AS date, count(*) AS total_requests, {AVG2} AS avg_latency_ms, ((2*sum(s) + sum(c)) // (2*sum(c)))/1000e0 AS avg_quality_score,
 count(*) FILTER (WHERE NOT success) AS failure_count, count(*) FILTER (WHERE cached) AS cache_hits FROM requests LEFT JOIN e USING (request_id) GROUP BY 1, 2"""),
)
def _(spark, d):
    return S.adapter_daily_rollup(B.requests(spark, d), B.evaluations(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("rate_limit_counts", W("requests", "SELECT user_id, (floor(epoch(ts)/60)*60)::BIGINT AS window_start, count(*) AS request_count FROM requests GROUP BY 1, 2"))
def _(spark, d):
    r = S.rate_limit_counts(B.requests(spark, d))
    return r.withColumn("window_start", F.unix_seconds("window_start"))


_CACHE = """, c AS (SELECT substr(sha256('k=' || tokens_out || ':' || adapter),1,16) AS cache_key, adapter, count(*)-1 AS hit_count, max(floor(epoch(ts)))::BIGINT AS last_accessed,
 max(floor(epoch(ts)))::BIGINT + 3600 AS expires_at, min(floor(epoch(ts)))::BIGINT AS created_at FROM requests GROUP BY 1, 2) """


def _cache(spark, d):
    r = B.requests(spark, d)
    return S.cache_hit_stats(r, F.concat(F.lit("k="), F.col("tokens_out").cast("string")))


@query("cache_hit_stats", W("requests", _CACHE + "SELECT * FROM c"))
def _(spark, d):
    return _cache(spark, d)


@query(
    "purge_expired",
    W("requests", _CACHE + """, n AS (SELECT max(floor(epoch(ts)))::BIGINT AS t FROM requests)
SELECT 'cache' AS kind, cache_key AS key, expires_at AS until FROM c, n WHERE expires_at >= t
UNION ALL SELECT 'window', user_id::VARCHAR, w FROM (SELECT user_id, (floor(epoch(ts)/60)*60)::BIGINT AS w FROM requests GROUP BY 1, 2), n WHERE w >= t - 3600"""),
)
def _(spark, d):
    r = B.requests(spark, d)
    now = r.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("t")).scalar()
    cache = S.purge_expired(_cache(spark, d), now).select(F.lit("cache").alias("kind"), F.col("cache_key").alias("key"), F.col("expires_at").alias("until"))
    wins = S.purge_old_windows(S.rate_limit_counts(r), now)
    return cache.union(wins.select(F.lit("window"), F.col("user_id").cast("string"), F.unix_seconds("window_start")))


@query(
    "feedback_join",
    W("requests feedback", """SELECT adapter, count(*) AS rows, count(rating) AS rated, avg(rating) AS avg_rating, avg(thumbs_up::INT::DOUBLE) AS thumbs_up_share FROM requests LEFT JOIN feedback USING (request_id) GROUP BY adapter"""),
)
def _(spark, d):
    return S.feedback_by_adapter(B.requests(spark, d), B.feedback(spark, d))


@query(
    "router_training_extract",
    W("samples", """SELECT id, instruction AS query, adapter AS adapter_label, complexity AS complexity_label, (id*7919 % 1000)/1000e0 AS confidence, 'production' AS source, (id*7919 % 1000)/1000e0 >= 0.8e0 AS is_validated FROM samples"""),
)
def _(spark, d):
    s = B.samples(spark, d).withColumn("confidence", (F.col("id") * 7919 % 1000) / 1000.0)
    return S.router_training_extract(s)


def _versions(spark, d):
    return B.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("version"), F.col("value").alias("metric"))


@query(
    "latest_version",
    "SELECT event_type AS model, max(event_id) AS latest, count(*) AS n_versions, first(event_id ORDER BY value, event_id) AS best FROM events GROUP BY 1",
)
def _(spark, d):
    return S.latest_version(_versions(spark, d))


@query("keep_last_n", "SELECT event_type AS model, event_id AS version, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5 AS keep FROM events")
def _(spark, d):
    return S.keep_last_n(_versions(spark, d))


@query(
    "table_constraints",
    W("requests evaluations users feedback", """SELECT 'users_tier' AS constraint_name, count(*) AS violations FROM users WHERE tier NOT IN ('free','pro','enterprise')
UNION ALL SELECT 'feedback_rating', count(*) FROM feedback WHERE rating NOT BETWEEN 1 AND 5
UNION ALL SELECT 'evaluations_unique_request', count(*) FROM (SELECT request_id FROM evaluations GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'requests_unique_id', count(*) FROM (SELECT request_id FROM requests GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'evaluations_request_fk', count(*) FROM evaluations WHERE request_id NOT IN (SELECT request_id FROM requests)
UNION ALL SELECT 'labels_document_fk', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'lineitem_order_fk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'requests_adapter_not_null', count(*) FROM requests WHERE adapter IS NULL"""),
)
def _(spark, d):
    req, ev, fb = B.requests(spark, d), B.evaluations(spark, d), B.feedback(spark, d)
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.constraint_report(
        {
            "users_tier": S.not_in(B.users(spark, d), "tier", B.TIERS),
            "feedback_rating": fb.where(~F.col("rating").between(1, 5)),
            "evaluations_unique_request": S.repeated_keys(ev, ["request_id"]),
            "requests_unique_id": S.repeated_keys(req, ["request_id"]),
            "evaluations_request_fk": S.orphans(ev, req, "request_id"),
            "labels_document_fk": S.orphans(B.table(spark, d, "labels"), B.table(spark, d, "documents"), "doc_id"),
            "lineitem_order_fk": S.orphans(B.table(spark, d, "lineitem"), orders, "l_orderkey"),
            "requests_adapter_not_null": req.where(F.col("adapter").isNull()),
        }
    )


@query(
    "set_ops",
    """WITH good AS (SELECT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'union_all' AS op, doc_id FROM (SELECT * FROM good UNION ALL SELECT * FROM toxic) UNION ALL SELECT 'intersect', doc_id FROM (SELECT * FROM good INTERSECT SELECT * FROM toxic)
UNION ALL SELECT 'except', doc_id FROM (SELECT * FROM good EXCEPT SELECT * FROM toxic) UNION ALL SELECT 'pool_minus_selected', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, d):
    lab, docs = B.table(spark, d, "labels"), B.table(spark, d, "documents").select("doc_id")
    good, toxic = lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")
    parts = {
        "union_all": good.unionByName(toxic),
        "intersect": good.intersect(toxic),
        "except": good.subtract(toxic),
        "pool_minus_selected": docs.join(lab, "doc_id", "left_anti"),
    }
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("op"), "doc_id")
        out = p if out is None else out.union(p)
    return out


@query("top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def _(spark, d):
    return S.top_k(B.table(spark, d, "events").select("event_id", "value"), "value", "event_id", 100)


@query("chunk", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS chunk FROM documents")
def _(spark, d):
    return S.chunk(B.table(spark, d, "documents").select("doc_id"), ["doc_id"], 32)
