"""Drift queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import drift as D

W = B.with_ctes


def scores(spark, d):
    r = B.requests(spark, d).select("request_id", "adapter", "ts")
    e = B.evaluations(spark, d).where("eval_no = 1").select("request_id", F.col("overall_score").alias("score"))
    return r.join(e, "request_id")


_SCORES = ", scores AS (SELECT r.request_id, r.adapter, r.ts, e.overall_score AS score FROM requests r JOIN evaluations e USING (request_id) WHERE e.eval_no = 1) "
_DIMS = "(SELECT unnest(range(64)) AS i)"


@query("embedding_baseline", W("vectors", f"SELECT i::INT AS pos, avg(v[i+1]) AS mean, stddev_pop(v[i+1]) + 1e-10 AS std, count(*) AS n FROM vectors, {_DIMS} WHERE vec_id % 2 = 0 GROUP BY i"))
def _(spark, d):
    return D.embedding_baseline(B.vectors(spark, d).where("vec_id % 2 = 0"))


@query(
    "embedding_drift",
    W("vectors", f""", b AS (SELECT i, avg(v[i+1]) AS m, stddev_pop(v[i+1]) + 1e-10 AS s FROM vectors, {_DIMS} WHERE vec_id % 2 = 0 GROUP BY i),
cur AS (SELECT * FROM vectors WHERE vec_id % 2 = 1 ORDER BY vec_id DESC LIMIT 1000), c AS (SELECT i, avg(v[i+1]) AS m, stddev_pop(v[i+1]) + 1e-10 AS s, count(*) AS n FROM cur, {_DIMS} GROUP BY i),
r AS (SELECT avg(abs((c.m-b.m)/b.s)) AS mean_drift, avg(abs(ln(c.s/b.s))) AS variance_drift, max(n) AS sample_count FROM b JOIN c USING (i))
SELECT *, 0.7*mean_drift + 0.3*variance_drift AS drift_score, CASE WHEN 0.7*mean_drift + 0.3*variance_drift > 0.5 THEN 'high' WHEN 0.7*mean_drift + 0.3*variance_drift > 0.3 THEN 'medium' ELSE 'low' END AS severity,
 0.7*mean_drift + 0.3*variance_drift > 0.1 AND sample_count >= 100 AS alert FROM r"""),
)
def _(spark, d):
    v = B.vectors(spark, d)
    base = D.embedding_baseline(v.where("vec_id % 2 = 0"))
    cur = D.embedding_baseline(D.newest(v.where("vec_id % 2 = 1"), 1000, "vec_id"))
    return D.embedding_drift(base, cur)


@query(
    "quality_degradation",
    W("requests evaluations", _SCORES + """, n AS (SELECT *, row_number() OVER w AS rn, avg(score) OVER (PARTITION BY adapter ORDER BY ts, request_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cur FROM scores WINDOW w AS (PARTITION BY adapter ORDER BY ts, request_id)),
b AS (SELECT adapter, avg(score) AS baseline FROM n WHERE rn <= 50 GROUP BY 1)
SELECT epoch_us(ts) AS ts, request_id, n.adapter, baseline, cur AS current, round(baseline - cur, 9) AS degradation, CASE WHEN round(baseline-cur,9) > 0.3e0 THEN 'high' WHEN round(baseline-cur,9) > 0.2e0 THEN 'medium' ELSE 'low' END AS severity
 FROM n JOIN b USING (adapter) WHERE rn >= 50 AND round(baseline - cur, 9) > 0.01e0"""),
)
def _(spark, d):
    q = D.quality_degradation(scores(spark, d), ["ts", "request_id"], baseline_rows=50, window=50, min_rows=50, threshold=0.01, block=256)
    return q.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query(
    "adapter_comparison",
    W("requests evaluations", _SCORES + """, n AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY ts DESC, request_id DESC) <= 500)
SELECT adapter, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, count(*) AS count FROM n GROUP BY 1"""),
)
def _(spark, d):
    return D.adapter_comparison(scores(spark, d), [F.desc("ts"), F.desc("request_id")], "request_id")


@query(
    "drift_summary",
    """WITH a AS (SELECT event_type AS drift_type, CASE WHEN value > 50 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE value > 10)
SELECT 'severity' AS kind, severity AS label, count(*) AS alerts FROM a GROUP BY 2 UNION ALL SELECT 'type', drift_type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM a""",
)
def _(spark, d):
    e = B.table(spark, d, "events").where("value > 10")
    return D.drift_summary(e.select(F.col("event_type").alias("drift_type"), D.severity(F.col("value"), 50, 30).alias("severity")))


@query(
    "drift_recent_alerts",
    "SELECT event_id, event_type AS drift_type, value FROM events WHERE value > 10 ORDER BY ts DESC, event_id DESC LIMIT 10",
)
def _(spark, d):
    e = B.table(spark, d, "events").where("value > 10").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    return e.select("event_id", F.col("event_type").alias("drift_type"), "value")


@query(
    "mmd_window",
    W("vectors", """, x AS (SELECT adapter, v FROM vectors QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY vec_id) <= 100), y AS (SELECT adapter, v FROM vectors QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY vec_id DESC) <= 100),
k AS (SELECT a.adapter, 'xx' AS p, exp(-list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])**2))) AS k FROM x a JOIN x b USING (adapter) UNION ALL SELECT a.adapter, 'yy', exp(-list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])**2))) FROM y a JOIN y b USING (adapter)
 UNION ALL SELECT a.adapter, 'xy', exp(-list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])**2))) FROM x a JOIN y b USING (adapter)),
m AS (SELECT adapter, sqrt(greatest(0, avg(k) FILTER (p='xx') + avg(k) FILTER (p='yy') - 2*avg(k) FILTER (p='xy'))) AS mmd FROM k GROUP BY 1) SELECT adapter, mmd, mmd > 0.1 AS drift FROM m"""),
)
def _(spark, d):
    return D.mmd_window(B.vectors(spark, d), "vec_id")


@query("mmd_rff")
def _(spark, d):
    return D.mmd_rff(B.vectors(spark, d), F.col("vec_id") % 2 == 0, dims=64)


@query(
    "reference_window",
    W("requests evaluations", _SCORES + """, f AS (SELECT adapter, avg(score) AS r, count(*) AS n FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY request_id) <= 100) GROUP BY 1),
l AS (SELECT adapter, avg(score) AS c FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY request_id DESC) <= 100) GROUP BY 1)
SELECT adapter, r AS reference_quality, c AS current_quality, c - r AS quality_change, c - r < -0.1e0 AS quality_drift FROM f JOIN l USING (adapter) WHERE n >= 100"""),
)
def _(spark, d):
    return D.reference_window(scores(spark, d), "request_id", "request_id")


_QS = ",".join(f"{i / 10}" for i in range(1, 10))


@query(
    "psi",
    W("requests", f""", r AS (SELECT latency_ms AS v, day(ts) <= 15 AS ref FROM requests), e AS (SELECT quantile_cont(v, [{_QS}]) AS e FROM r WHERE ref),
b AS (SELECT ref, len(list_filter(e, lambda x: x < v)) AS bin FROM r, e), t AS (SELECT count(*) FILTER (ref) AS tr, count(*) FILTER (NOT ref) AS tc FROM r),
s AS (SELECT bin, greatest(count(*) FILTER (ref)/any_value(tr), 1e-4) AS r, greatest(count(*) FILTER (NOT ref)/any_value(tc), 1e-4) AS c FROM b, t GROUP BY bin)
SELECT sum((c-r)*ln(c/r)) AS psi, sum((c-r)*ln(c/r)) > 0.2 AS drift FROM s"""),
)
def _(spark, d):
    r = B.requests(spark, d).withColumn("ref", F.dayofmonth("ts") <= 15)
    return D.psi(r, "ref", "latency_ms")


@query(
    "ks_two_sample",
    W("requests", """, r AS (SELECT latency_ms AS v, day(ts) <= 15 AS ref FROM requests), t AS (SELECT count(*) FILTER (ref) AS na, count(*) FILTER (NOT ref) AS nb FROM r),
g AS (SELECT v, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM r GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v)::DOUBLE AS ca, sum(b) OVER (ORDER BY v)::DOUBLE AS cb FROM g),
s AS (SELECT max(abs(ca/na - cb/nb)) AS d, any_value(sqrt(na*nb/(na+nb))) AS ne FROM c, t), l AS (SELECT d, (ne + 0.12e0 + 0.11e0/ne)*d AS lam FROM s),
p AS (SELECT d, least(greatest(2*list_sum(list_transform(range(1,101), lambda j: (-1e0)**(j-1) * exp(-2*lam*lam*j*j))),0e0),1e0) AS p FROM l) SELECT d AS statistic, p AS p_value, p < 0.05e0 AS drift FROM p"""),
)
def _(spark, d):
    r = B.requests(spark, d).withColumn("ref", F.dayofmonth("ts") <= 15)
    return D.ks_two_sample(r, "ref", "latency_ms")


@query(
    "retrain_decision",
    W("requests evaluations", _SCORES + """, q AS (SELECT adapter, avg(score) AS q FROM scores GROUP BY 1), w AS (SELECT * FROM q WHERE q < 0.7e0 ORDER BY q, adapter LIMIT 1)
SELECT true AS retrain, 'Quality degraded for ' || adapter || ': ' || printf('%.2f', q) || ' < 0.7' AS reason FROM w"""),
)
def _(spark, d):
    q = scores(spark, d).groupBy("adapter").agg(F.avg("score").alias("quality"))
    drift = q.select("adapter", (F.col("quality") * 0).alias("psi"))
    return D.retrain_decision(q, drift, F.lit(48.0), F.lit(0))
