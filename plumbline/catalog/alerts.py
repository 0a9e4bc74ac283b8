"""Alert queries over hourly metric points."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import alerts as A
from plumbline.operators.timeseries import seconds
from plumbline.plans.ordering import group_quantiles

W = B.with_ctes
HOUR = 3600

_POINTS = """, hr AS (SELECT (floor(epoch(ts)/3600)*3600)::BIGINT AS sec, quantile_cont(latency_ms,0.99) AS p99, avg((NOT success)::INT::DOUBLE) AS er, avg(overall_score) AS q
 FROM requests LEFT JOIN evaluations USING (request_id) GROUP BY 1),
points AS (SELECT 'latency_p99' AS metric, sec, p99 AS value FROM hr UNION ALL SELECT 'error_rate', sec, er FROM hr UNION ALL SELECT 'quality_score', sec, q FROM hr WHERE q IS NOT NULL),
rules AS (SELECT * FROM (VALUES ('high_latency','latency_p99','warning',7200e0),('high_error_rate','error_rate','error',3600e0),('quality_degradation','quality_score','warning',10800e0)) t(rule,metric,severity,dur)),
ev AS (SELECT p.*, r.rule, r.severity, r.dur, CASE r.rule WHEN 'high_latency' THEN value > 1000 WHEN 'high_error_rate' THEN value > 0.05e0 ELSE value < 0.7e0 END AS met,
 CASE r.rule WHEN 'high_error_rate' THEN 'Error rate above threshold: ' || printf('%.1f', value*100) || '%' WHEN 'quality_degradation' THEN 'Response quality below threshold: ' || printf('%.2f', value) END AS msg
 FROM points p JOIN rules r USING (metric)),
isl AS (SELECT *, sum((NOT met)::INT) OVER (PARTITION BY rule ORDER BY sec) AS island FROM ev),
fire AS (SELECT *, CASE WHEN met THEN min(CASE WHEN met THEN sec END) OVER (PARTITION BY rule, island) END AS since FROM isl),
fr AS (SELECT *, coalesce(met AND sec - since >= dur, false) AS firing FROM fire) """

RULES = [
    A.Rule(r.name, r.metric, r.condition, r.severity, r.message, s)
    for r, s in zip(A.DEFAULT_RULES, (7200, 3600, 10800, 0))
]


def points(spark, d):
    j = B.requests(spark, d).join(B.evaluations(spark, d), "request_id", "left")
    j = j.withColumn("sec", (F.floor(seconds("ts") / HOUR) * HOUR))
    aggs = [F.avg((~F.col("success")).cast("double")).alias("error_rate"), F.avg("overall_score").alias("quality_score")]
    wide = group_quantiles(j, ["sec"], "latency_ms", {"latency_p99": 0.99}, aggs)
    return wide.unpivot(["sec"], ["latency_p99", "error_rate", "quality_score"], "metric", "value").where("value is not null")


def fired(spark, d):
    return A.rule_for_duration(A.rule_eval(points(spark, d), RULES), [], "sec")


@query(
    "rule_eval",
    W("requests evaluations", _POINTS + """SELECT rule, sec, value, severity, CASE WHEN rule <> 'high_latency' THEN msg END AS message FROM ev WHERE met"""),
)
def _(spark, d):
    e = A.rule_eval(points(spark, d), RULES).where("met")
    return e.select("rule", "sec", "value", "severity", F.when(F.col("rule") != "high_latency", F.col("message")).alias("message"))


@query("rule_for_duration", W("requests evaluations", _POINTS + "SELECT rule, sec, met, firing, since AS pending_since FROM fr"))
def _(spark, d):
    return fired(spark, d).select("rule", "sec", "met", "firing", "pending_since")


@query(
    "alert_lifecycle",
    W("requests evaluations", _POINTS + """, per AS (SELECT rule, island, min(sec) FILTER (WHERE firing) AS started_at, max(sec) FILTER (WHERE firing) AS last_seen, count(*) FILTER (WHERE firing) AS points FROM fr GROUP BY 1,2),
cl AS (SELECT rule, island - 1 AS island, min(sec) AS resolved_at FROM fr WHERE NOT met GROUP BY 1, 2)
SELECT rule, started_at, resolved_at, coalesce(resolved_at,last_seen) - started_at AS duration, points, CASE WHEN resolved_at IS NULL THEN 'firing' ELSE 'resolved' END AS status FROM per LEFT JOIN cl USING (rule, island) WHERE points > 0"""),
)
def _(spark, d):
    return A.alert_lifecycle(fired(spark, d), [], "sec")


@query(
    "slo_rules",
    W("requests", """, b AS (SELECT unnest([0.01e0,0.05e0,0.1e0,0.25e0,0.5e0,1e0,2.5e0,5e0,10e0,'inf'::DOUBLE]) AS le),
h AS (SELECT (floor(epoch(ts)/21600)*21600)::BIGINT AS sec, le, count(*) FILTER (WHERE latency_ms/1000 <= le) AS c FROM requests, b GROUP BY 1, 2),
q AS (SELECT sec, le, c, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY sec)*0.95e0 AS goal FROM h WINDOW w AS (PARTITION BY sec ORDER BY le)),
p AS (SELECT sec, CASE WHEN isinf(le) THEN lo ELSE lo + (le-lo)*(goal-below)/(c-below) END AS value FROM q WHERE c >= goal QUALIFY row_number() OVER (PARTITION BY sec ORDER BY le) = 1),
s AS (SELECT (floor(epoch(ts)/21600)*21600)::BIGINT AS sec, count(*) FILTER (WHERE NOT success)/count(*) AS er, count(*)/21600e0 AS rate FROM requests GROUP BY 1),
ev AS (SELECT 'HighLatency' AS rule, sec, value, value > 2 AS met, 21600e0 AS dur FROM p UNION ALL SELECT 'HighErrorRate', sec, er, er > 0.05e0, 21600e0 FROM s UNION ALL SELECT 'LowThroughput', sec, rate, rate < 1, 43200e0 FROM s),
isl AS (SELECT *, sum((NOT met)::INT) OVER (PARTITION BY rule ORDER BY sec) AS island FROM ev),
fire AS (SELECT *, CASE WHEN met THEN min(CASE WHEN met THEN sec END) OVER (PARTITION BY rule, island) END AS since FROM isl)
SELECT rule, sec, value, coalesce(met AND sec - since >= dur, false) AS firing FROM fire"""),
)
def _(spark, d):
    from plumbline.operators import timeseries as T
    from plumbline.operators.monitoring import LATENCY_BOUNDS

    width = 21600
    r = B.requests(spark, d).withColumn("sec", F.floor(seconds("ts") / width) * width)
    sec = F.col("latency_ms") / 1000
    h = r.groupBy("sec").agg(*[F.count_if(sec <= float(b)).alias(b) for b in LATENCY_BOUNDS], F.count(F.lit(1)).alias("+Inf"))
    h = h.unpivot(["sec"], [f"`{b}`" for b in [*LATENCY_BOUNDS, "+Inf"]], "le", "cumulative_count")
    p95 = T.histogram_quantile(h, ["sec"], 0.95).select("sec", F.lit("p95_seconds").alias("metric"), F.col("quantile").alias("value"))
    panels = T.ratio_panels(r, width).select(F.col("window_start").alias("sec"), (F.col("error_pct") / 100).alias("error_ratio"), "request_rate")
    rest = panels.unpivot(["sec"], ["error_ratio", "request_rate"], "metric", "value")
    rules = [
        A.Rule("HighLatency", "p95_seconds", "value > 2", "warning", "'High API latency detected'", width),
        A.Rule("HighErrorRate", "error_ratio", "value > 0.05", "critical", "'High error rate detected'", width),
        A.Rule("LowThroughput", "request_rate", "value < 1", "warning", "'Low request throughput'", 2 * width),
    ]
    f = A.rule_for_duration(A.rule_eval(p95.unionByName(rest), rules), [], "sec")
    return f.select("rule", "sec", "value", "firing")


_ALERTS = """, al AS (SELECT event_id AS seq, name, adapter, usr, epoch(ts) AS sec, value, CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'error' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity,
 substr(md5(name || '|[(''adapter'', ''' || adapter || '''), (''user'', ''' || usr || ''')]'),1,16) AS fingerprint FROM metrics) """


def alert_rows(spark, d):
    m = B.metrics(spark, d)
    sev = F.when(F.col("value") > 100, "critical").when(F.col("value") > 50, "error").when(F.col("value") > 20, "warning").otherwise("info")
    return m.select(
        F.col("event_id").alias("seq"), "name", seconds("ts").alias("sec"), "value", sev.alias("severity"),
        A.fingerprint(F.col("name"), F.col("labels")).alias("fingerprint"),
    )


@query("alert_fingerprint", W("metrics", _ALERTS + "SELECT seq, fingerprint FROM al"))
def _(spark, d):
    return alert_rows(spark, d).select("seq", "fingerprint")


@query(
    "alert_rate_cap",
    W("metrics", _ALERTS + "SELECT seq, name, floor(sec/7200)::BIGINT AS slot, row_number() OVER (PARTITION BY name, floor(sec/7200) ORDER BY sec, seq) <= 3 AS sent FROM al"),
)
def _(spark, d):
    return A.alert_rate_cap(alert_rows(spark, d), 3, 7200)


@query(
    "alert_dedup_window",
    W("metrics", _ALERTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY sec, seq) AS rn FROM al),
w AS (SELECT seq, fingerprint, rn, sec, sec AS last_sent, true AS sent FROM n WHERE rn = 1
 UNION ALL SELECT n.seq, n.fingerprint, n.rn, n.sec, CASE WHEN n.sec - w.last_sent < 14400 THEN w.last_sent ELSE n.sec END, n.sec - w.last_sent >= 14400 FROM w JOIN n ON n.fingerprint = w.fingerprint AND n.rn = w.rn + 1)
SELECT seq, fingerprint, sent FROM w""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, d):
    rows = alert_rows(spark, d).select("seq", "fingerprint", "sec", F.lit("alert").alias("action"))
    return A.alert_dedup_window(rows, window=14400.0, silence=0.0).select("seq", "fingerprint", "sent")


@query(
    "alert_payload",
    W("metrics", _ALERTS + """, x AS (SELECT *, 'value ' || printf('%.2f', value) AS msg, CASE WHEN seq % 10 = 0 THEN 'resolved' ELSE 'firing' END AS status, upper(severity) AS up, CASE severity WHEN 'info' THEN '#36a64f' WHEN 'warning' THEN '#FFA500' WHEN 'error' THEN '#FF6347' ELSE '#DC143C' END AS colour FROM al)
SELECT fingerprint, sec, '[' || up || '] ' || name AS subject,
 '{"color":"' || colour || '","title":"[' || up || '] ' || name || '","text":"' || msg || '","status":"' || status || '","ts":' || floor(sec)::BIGINT || '}' AS chat,
 '{"event_action":"' || CASE WHEN status='firing' THEN 'trigger' ELSE 'resolve' END || '","dedup_key":"' || fingerprint || '","payload":{"summary":"' || msg || '","severity":"' || severity || '","source":"plumbline"}}' AS page FROM x"""),
)
def _(spark, d):
    a = alert_rows(spark, d).withColumns(
        {
            "message": F.format_string("value %.2f", F.col("value")),
            "status": F.when(F.col("seq") % 10 == 0, "resolved").otherwise("firing"),
        }
    )
    return A.alert_payload(a)
