"""Uncertainty, calibration, routing, active learning and reward queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.functions import vectors as V
from plumbline.operators import active as AL
from plumbline.operators import calibration as C
from plumbline.operators import rewards as RW
from plumbline.operators import routing as RO

W = B.with_ctes
ENT = "-list_sum(list_transform({p}, lambda p: p*ln(p+1e-10)))"
SM = B._SOFTMAX

_MOM = """, mk AS (SELECT item, k, avg(probs[k]) AS m, var_pop(probs[k]) AS vp, var_samp(probs[k]) AS vs FROM mc_samples, range(1,11) r(k) GROUP BY 1,2),
mm AS (SELECT item, list(m ORDER BY k) AS mp, avg(vp) AS epi, avg(vs) AS vs FROM mk GROUP BY 1) """


@query(
    "mc_uncertainty",
    W("mc_samples", _MOM + f""", ci AS (SELECT item, quantile_cont(list_avg(probs), 0.025) AS ci_low, quantile_cont(list_avg(probs), 0.975) AS ci_high FROM mc_samples GROUP BY 1)
SELECT item, epi AS epistemic, {ENT.format(p='mp')} AS aleatoric, epi + {ENT.format(p='mp')} AS total, ci_low, ci_high, epi + {ENT.format(p='mp')} < 0.3 AS confident FROM mm JOIN ci USING (item)"""),
)
def _(spark, d):
    return C.mc_uncertainty(B.mc_samples(spark, d))


def models(spark, d):
    """Item 0 modulo 7 was seen by one model only."""
    return B.mc_samples(spark, d).withColumnRenamed("sample", "model").where("item % 7 <> 0 or model = 0")


@query("ensemble_uncertainty", W("mc_samples", _MOM + f"SELECT item, 6::BIGINT AS members, epi AS epistemic, {ENT.format(p='mp')} AS aleatoric, epi + {ENT.format(p='mp')} AS total FROM mm WHERE item % 7 <> 0"))
def _(spark, d):
    return C.ensemble_uncertainty(models(spark, d))


@query(
    "predictive_entropy_mi",
    W("mc_samples", _MOM + f""", e AS (SELECT item, avg({ENT.format(p='probs')}) AS me FROM mc_samples GROUP BY 1)
SELECT item, {ENT.format(p='mp')} AS entropy, {ENT.format(p='mp')} - me AS mutual_information, vs AS variance, 1 - {ENT.format(p='mp')}/ln(10e0) AS confidence FROM mm JOIN e USING (item)"""),
)
def _(spark, d):
    return C.predictive_entropy_mi(B.mc_samples(spark, d))


@query(
    "embedding_disagreement",
    W("vectors", """, r AS (SELECT vec_id // 5 AS item, vec_id % 5 AS model, v FROM vectors), pv AS (SELECT item, k, var_pop(v[k]) AS vv FROM r, range(1,65) t(k) GROUP BY 1,2), p AS (SELECT item, avg(vv) AS variance FROM pv GROUP BY 1),
c AS (SELECT a.item, avg(list_cosine_similarity(a.v,b.v)) AS s FROM r a JOIN r b ON a.item = b.item AND a.model < b.model GROUP BY 1) SELECT item, variance, s AS mean_similarity, 1 - s AS disagreement FROM p JOIN c USING (item)"""),
)
def _(spark, d):
    r = B.vectors(spark, d).select(F.floor(F.col("vec_id") / 5).alias("item"), (F.col("vec_id") % 5).alias("model"), "v")
    return C.embedding_disagreement(r, "item", "model", "v")


@query("temperature_scale", W("predictions", f", t AS (SELECT item, list_transform(logits, lambda x: x/2e0) AS z FROM predictions), p AS (SELECT item, {SM.format(z='z')} AS p FROM t) SELECT item, list_max(p) AS top, p[1] AS first FROM p"))
def _(spark, d):
    p = B.predictions(spark, d).select("item", C.temperature_scale(F.col("logits"), 2.0).alias("p"))
    return p.select("item", F.array_max("p").alias("top"), F.col("p")[0].alias("first"))


@query(
    "fit_temperature_grid",
    W("predictions", """, g AS (SELECT 0.5e0 + 2.5e0*i/49 AS t FROM range(50) r(i)),
n AS (SELECT t, avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits))/t)))) - (logits[label+1] - list_max(logits))/t) AS nll FROM predictions, g GROUP BY t)
SELECT t AS temperature, nll FROM n ORDER BY nll, t LIMIT 1"""),
)
def _(spark, d):
    return C.fit_temperature_grid(B.predictions(spark, d), "logits", "label")


_BINS = ", e AS (SELECT i AS bin, CAST(i AS DOUBLE)/10 AS lo, CAST(i+1 AS DOUBLE)/10 AS hi FROM range(10) r(i)) "
_CAL = _BINS + """, p AS (SELECT list_max(probs) AS c, (list_position(probs, list_max(probs)) - 1 = label)::INT::DOUBLE AS y FROM predictions),
b AS (SELECT bin::INT AS bin, count(*) AS count, avg(c) AS avg_confidence, avg(y) AS accuracy FROM p JOIN e ON c > lo AND c <= hi GROUP BY 1) """


def _conf():
    return F.array_max("probs"), V.argmax(F.col("probs")) == F.col("label")


@query("calibration_bins", W("predictions", _CAL + "SELECT *, abs(avg_confidence - accuracy) AS gap, (bin + 0.5e0)/10 AS center FROM b"))
def _(spark, d):
    return C.calibration_bins(B.predictions(spark, d), *_conf())


@query("calibration_errors", W("predictions", _CAL + "SELECT sum(count/(SELECT count(*) FROM p) * abs(avg_confidence-accuracy)) AS ece, max(abs(avg_confidence-accuracy)) AS mce FROM b"))
def _(spark, d):
    return C.calibration_errors(B.predictions(spark, d), *_conf())


@query(
    "calibration_bins_binary",
    "WITH x AS (SELECT 1) " + _BINS + """, p AS (SELECT l.quality::DOUBLE AS y, (l.doc_id*7919 % 1000)/1000e0 AS c FROM labels l),
b AS (SELECT bin::INT AS bin, count(*) AS count, avg(c) AS avg_confidence, avg(y) AS accuracy FROM p JOIN e ON c > lo AND c <= hi GROUP BY 1) SELECT *, abs(avg_confidence - accuracy) AS gap, (bin + 0.5e0)/10 AS center FROM b""",
)
def _(spark, d):
    lab = B.table(spark, d, "labels")
    return C.calibration_bins(lab, F.col("doc_id") * 7919 % 1000 / 1000.0, F.col("quality") == 1)


_THR = ", sc AS (SELECT item, probs[label+1] AS s FROM predictions), th AS (SELECT s AS threshold FROM (SELECT s, row_number() OVER (ORDER BY s DESC, item) AS rn, count(*) OVER () AS n FROM sc) WHERE rn = least(ceil((n+1)*0.9e0), n)) "


def _threshold(spark, d):
    s = B.predictions(spark, d).select("item", F.element_at("probs", F.col("label") + 1).alias("s"))
    return C.conformal_threshold(s, "s", "item")


@query("conformal_threshold", W("predictions", _THR + "SELECT threshold FROM th"))
def _(spark, d):
    return _threshold(spark, d)


@query(
    "conformal_set",
    W("predictions", """, x AS (SELECT item, k-1 AS k, probs[k] AS p FROM predictions, range(1,11) r(k)), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY item ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM x)
SELECT item, string_agg(k::VARCHAR, ',' ORDER BY p DESC, k) AS classes, count(*) AS set_size, sum(p) AS coverage FROM c WHERE before < 0.9e0 GROUP BY item"""),
)
def _(spark, d):
    c = C.conformal_set(B.predictions(spark, d), "probs", F.lit(0.9))
    return c.select("item", F.array_join(F.col("prediction_set").cast("array<string>"), ",").alias("classes"), F.col("set_size").cast("bigint").alias("set_size"), "coverage")


# --- routing

_Z = "list_transform(embedding[{a}:{b}], lambda x: x::DOUBLE*10)"
_ROUTES = f""", rz AS (SELECT vec_id AS item, label, {_Z.format(a=1, b=4)} AS wz, {_Z.format(a=5, b=7)} AS cz, {_Z.format(a=8, b=11)} AS tz FROM embeddings),
routes AS (SELECT item, label, wz, cz, {SM.format(z='wz')} AS w, {SM.format(z='cz')} AS c, {SM.format(z='tz')} AS t FROM rz) """
_NAMES = "['reasoning','code','creative','analysis']"


def routes(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))
    z = lambda a, n: F.transform(F.slice("v", a, n), lambda x: x * 10)
    r = e.select(F.col("vec_id").alias("item"), "label", z(1, 4).alias("wz"), z(5, 3).alias("cz"), z(8, 4).alias("tz"))
    r = r.withColumns({"w": V.softmax(F.col("wz")), "c": V.softmax(F.col("cz")), "t": V.softmax(F.col("tz"))})
    return r.withColumn("confidence", F.array_max("w"))


def any_sql(c, keys):
    return "(" + " OR ".join(f"contains({c},'{k}')" for k in keys) + ")"


def _route_sql(c, extra=()):
    k = RO.KEYWORDS
    return f"CASE WHEN {any_sql(c, [*k['code'], *extra])} THEN 'code' WHEN {any_sql(c, k['creative'])} THEN 'creative' WHEN {any_sql(c, k['analysis'])} THEN 'analysis' ELSE 'reasoning' END"


@query("keyword_route", f"SELECT doc_id, {_route_sql('lower(text)')} AS route FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", RO.keyword_route(F.col("text")).alias("route"))


@query(
    "keyword_route_probs",
    f"WITH r AS (SELECT page_id, {_route_sql('lower(html)', RO.MORE_CODE)} AS route FROM pages) SELECT page_id, route, " + ", ".join(f"CASE WHEN route='{a}' THEN 0.7e0/1.15e0 ELSE 0.15e0/1.15e0 END AS {a}" for a in RO.ADAPTERS) + " FROM r",
)
def _(spark, d):
    p = B.table(spark, d, "pages").select("page_id", RO.keyword_route_probs(F.col("html")).alias("p"))
    return p.select("page_id", RO.name_of(V.argmax(F.col("p"))).alias("route"), *[F.col("p")[i].alias(a) for i, a in enumerate(RO.ADAPTERS)])


@query(
    "routing_decision",
    W("vectors", _ROUTES + f""", x AS (SELECT item, k, w[k] AS p FROM routes, range(1,5) r(k)),
s AS (SELECT item, string_agg({_NAMES}[k], ',' ORDER BY p DESC, k) FILTER (p > 0.1e0) AS selected FROM x GROUP BY item)
SELECT item, selected, {_NAMES}[list_position(w, list_max(w))] AS "primary", list_max(w) AS primary_weight, ['easy','medium','hard'][list_position(c, list_max(c))] AS predicted_complexity, w[2] AS code_weight FROM routes JOIN s USING (item)"""),
)
def _(spark, d):
    r = RO.routing_decision(routes(spark, d), "w", "c")
    return r.select("item", F.array_join("selected", ",").alias("selected"), "primary", "primary_weight", "predicted_complexity", F.col("weight_map")["code"].alias("code_weight"))


@query(
    "route_fallback",
    W("vectors", _ROUTES + """, m AS (SELECT item // 8 AS batch, avg(list_max(w)) AS mean FROM routes GROUP BY 1)
SELECT item, mean < 0.55e0 AS fallback, CASE WHEN mean < 0.55e0 THEN CASE WHEN (SELECT count(*) FROM range(1,5) r(k) WHERE w[k] > w[1] OR (w[k] = w[1] AND k < 1)) < 2 THEN 0.5e0 ELSE 0e0 END ELSE w[1] END AS first_weight FROM routes JOIN m ON batch = item // 8"""),
)
def _(spark, d):
    r = routes(spark, d).withColumn("batch", F.floor(F.col("item") / 8))
    f = RO.route_fallback(r, "batch", "w", "confidence", 0.55, top_k=2)
    return f.select("item", "fallback", F.col("w")[0].alias("first_weight"))


@query("route_fallback_uniform", W("vectors", _ROUTES + ", m AS (SELECT item // 8 AS batch, avg(list_max(w)) AS mean FROM routes GROUP BY 1) SELECT item, CASE WHEN mean < 0.55e0 THEN 0.25e0 ELSE w[1] END AS first_weight FROM routes JOIN m ON batch = item // 8"))
def _(spark, d):
    r = routes(spark, d).withColumn("batch", F.floor(F.col("item") / 8))
    return RO.route_fallback(r, "batch", "w", "confidence", 0.55).select("item", F.col("w")[0].alias("first_weight"))


@query(
    "route_ensemble",
    W("mc_samples", """, g AS (SELECT unnest([0,1,2,3,4,5]) AS sample, unnest([0.0,0.5,1.0,0.0,0.5,1.0])::DOUBLE AS z), z AS (SELECT sum(exp(z)) AS s FROM g)
SELECT item, sum(probs[1]*exp(g.z)/z.s) AS w0, sum(probs[10]*exp(g.z)/z.s) AS w9 FROM mc_samples JOIN g USING (sample), z GROUP BY item"""),
)
def _(spark, d):
    m = B.mc_samples(spark, d).withColumn("router", F.col("sample").cast("string"))
    e = RO.route_ensemble(m, "item", "router", "probs", {str(i): (i % 3) / 2 for i in range(6)})
    return e.select("item", F.col("weights")[0].alias("w0"), F.col("weights")[9].alias("w9"))


@query("route_ensemble_mean", W("mc_samples", "SELECT item, avg(probs[1]) AS w0, avg(probs[10]) AS w9 FROM mc_samples GROUP BY item"))
def _(spark, d):
    e = RO.route_ensemble(B.mc_samples(spark, d), "item", "sample", "probs")
    return e.select("item", F.col("weights")[0].alias("w0"), F.col("weights")[9].alias("w9"))


@query(
    "router_eval",
    W("vectors", _ROUTES + f""", h AS (SELECT {_NAMES}[list_position(t, list_max(t))] AS adapter, (list_position(w, list_max(w)) = list_position(t, list_max(t)))::INT::DOUBLE AS hit, (list_position(c, list_max(c)) - 1 = label % 3)::INT::DOUBLE AS chit, {ENT.format(p='w')} AS h FROM routes)
SELECT coalesce(adapter,'all') AS adapter, avg(hit) AS routing_accuracy, avg(chit) AS complexity_accuracy, avg(h) AS mean_entropy, count(*) AS n FROM h GROUP BY GROUPING SETS ((adapter), ())"""),
)
def _(spark, d):
    return RO.router_eval(routes(spark, d).withColumn("tc", F.col("label") % 3), "w", "t", "c", "tc")


_PAIRS = " + ".join(f"greatest(0e0, 0.1e0 - sign(t[{i}]-t[{j}])*(w[{i}]-w[{j}]))" for i in range(1, 5) for j in range(i + 1, 5))


@query(
    "router_losses",
    W("vectors", _ROUTES + f""", l AS (SELECT avg(list_sum(list_transform(range(1,5), lambda k: t[k]*(ln(t[k]) - ln(w[k]))))) AS routing, avg(-ln(c[label % 3 + 1])) AS complexity, avg(({_PAIRS})/6) AS ranking FROM routes)
SELECT *, routing + 0.5*complexity + 0.3*ranking AS total FROM l"""),
)
def _(spark, d):
    r = routes(spark, d).withColumn("tc", F.col("label") % 3)
    return RO.router_losses(r, "wz", "t", "cz", "tc", "t", 4)


_AW = """, sc AS (SELECT adapter, overall_score AS s, r.request_id FROM requests r JOIN evaluations e USING (request_id) WHERE eval_no = 1 AND adapter <> 'analysis'),
m AS (SELECT adapter, avg(s) AS m FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY request_id DESC) <= 100) GROUP BY 1),
a AS (SELECT adapter, exp(coalesce(m, 0.5e0)) AS e FROM (SELECT unnest(['reasoning','code','creative','analysis']) AS adapter) LEFT JOIN m USING (adapter)), aw AS (SELECT adapter, e/(SELECT sum(e) FROM a) AS weight FROM a) """


def _adaptive(spark, d):
    e = B.evaluations(spark, d).where("eval_no = 1").select("request_id", F.col("overall_score").alias("score"))
    s = B.requests(spark, d).where("adapter <> 'analysis'").select("request_id", "adapter").join(e, "request_id")
    return RO.adaptive_weights(s, [F.desc("request_id")], "request_id")


@query("adaptive_weights", W("requests evaluations", _AW + "SELECT adapter, weight FROM aw"))
def _(spark, d):
    return _adaptive(spark, d)


@query(
    "weighted_choice",
    W("requests evaluations", _AW + """, c AS (SELECT sum(weight) FILTER (adapter='reasoning') AS a, sum(weight) FILTER (adapter IN ('reasoning','code')) AS b, sum(weight) FILTER (adapter <> 'analysis') AS c FROM aw),
u AS (SELECT event_id, ('0x'||substr(md5(event_id || '|choice|0|42'),1,8))::BIGINT/4294967296e0 AS u FROM events)
SELECT event_id, CASE WHEN u < a THEN 'reasoning' WHEN u < b THEN 'code' WHEN u < c THEN 'creative' ELSE 'analysis' END AS choice FROM u, c"""),
)
def _(spark, d):
    return RO.weighted_choice(B.table(spark, d, "events").select("event_id"), "event_id", _adaptive(spark, d))


@query("quality_correlation", W("vectors", _ROUTES + f"SELECT corr(list_max(w), (item*7919 % 1000)/1000e0) AS correlation, avg({ENT.format(p='w')}) AS mean_entropy FROM routes"))
def _(spark, d):
    r = routes(spark, d).withColumn("q", F.col("item") * 7919 % 1000 / 1000.0)
    return RO.quality_correlation(r, "confidence", "q", "w")


# --- active learning


@query(
    "uncertainty_score",
    W("predictions", f", s AS (SELECT item, probs, list_reverse_sort(probs) AS o FROM predictions) SELECT item, {ENT.format(p='probs')} AS entropy, 1 - (o[1]-o[2]) AS margin, 1 - o[1] AS confidence FROM s"),
)
def _(spark, d):
    p = F.col("probs")
    return B.predictions(spark, d).select("item", *[AL.uncertainty_score(p, s).alias(s) for s in ("entropy", "margin", "confidence")])


@query("select_uncertain", W("predictions", f"SELECT item, {ENT.format(p='probs')} AS score FROM predictions ORDER BY round(score, 12) DESC, item LIMIT 50"))
def _(spark, d):
    return AL.select_uncertain(B.predictions(spark, d), "item", "probs", 50).select("item", "score")


@query("cluster_diversity")
def _(spark, d):
    return AL.cluster_diversity(B.vectors(spark, d), "vec_id", "v")


@query("coreset_diversity", W("vectors", "SELECT a.vec_id, min(list_distance(a.v, b.v)) AS diversity FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY 1"))
def _(spark, d):
    return AL.coreset_diversity(B.vectors(spark, d), "vec_id", "v")


@query("pairs_within_eps", W("vectors", "SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS dist FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE list_distance(a.v, b.v) <= 1.15e0"))
def _(spark, d):
    from plumbline.plans.similarity import pairs_within

    return pairs_within(B.vectors(spark, d), "vec_id", "v", 1.15)


@query("hybrid_select")
def _(spark, d):
    div = AL.cluster_diversity(B.vectors(spark, d), "vec_id", "v").withColumnRenamed("vec_id", "item")
    return AL.hybrid_select(B.predictions(spark, d), "item", "probs", div, 50)


@query(
    "hybrid_select_coreset",
    W("vectors predictions", f""", dv AS (SELECT a.vec_id AS item, min(list_distance(a.v, b.v)) AS dv FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY 1),
s AS (SELECT item, {ENT.format(p='probs')} AS u, dv FROM predictions JOIN dv USING (item)) SELECT item, 0.6e0*u/(SELECT max(u) FROM s) + 0.4e0*dv/(SELECT max(dv) FROM s) AS score FROM s ORDER BY score DESC, item LIMIT 50"""),
)
def _(spark, d):
    div = AL.coreset_diversity(B.vectors(spark, d), "vec_id", "v").withColumnRenamed("vec_id", "item")
    return AL.hybrid_select(B.predictions(spark, d), "item", "probs", div, 50)


@query(
    "batch_select",
    """WITH o AS (SELECT min(doc_id) AS doc_id, max(n_chars) AS score FROM documents GROUP BY text), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM o)
SELECT doc_id, ceil(rn/40)::BIGINT AS batch FROM r WHERE rn <= 200""",
)
def _(spark, d):
    x = B.table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return AL.batch_select(x, "doc_id", "text", "n_chars", 40, 5).select("doc_id", "batch")


@query("committee_disagreement", W("mc_samples", _MOM + f"SELECT item, {ENT.format(p='mp')} AS vote_entropy FROM mm WHERE item % 7 <> 0"))
def _(spark, d):
    return AL.committee_disagreement(models(spark, d))


# --- rewards

_RW = "0.5e0*q + 0.2e0*(-greatest(0e0, latency_ms/500 - 1)) + 0.1e0*(-c) + 0.2e0*(-0.5e0*h)"
_STEPS = f""", x AS (SELECT request_id, user_id, (request_id*7919 % 1000)/1000e0 AS q, latency_ms, (request_id % 10)/10e0 AS c, (request_id % 14)/10e0 AS h FROM requests),
y AS (SELECT request_id, user_id, {_RW} AS reward FROM x), st AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY request_id) - 1 AS step FROM y) """


def rewards(spark, d):
    r = B.requests(spark, d)
    i = F.col("request_id")
    return r.select("request_id", "user_id", "adapter", RW.shaped_reward(i * 7919 % 1000 / 1000.0, F.col("latency_ms"), i % 10 / 10.0, i % 14 / 10.0).alias("reward"))


def episodes(spark, d):
    """One episode per user with dense steps."""
    from plumbline.plans.ordering import ranked

    return ranked(rewards(spark, d), ["request_id"], ["user_id"], name="r").withColumn("step", F.col("r") - 1).drop("r")


@query("shaped_reward", W("requests", _STEPS + "SELECT request_id, reward FROM y"))
def _(spark, d):
    return rewards(spark, d).select("request_id", "reward")


@query(
    "normalized_reward",
    W("requests", _STEPS + """, n AS (SELECT request_id, reward, row_number() OVER (ORDER BY request_id) AS rn, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS s FROM y WINDOW w AS (ORDER BY request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT request_id, CASE WHEN rn > 100 THEN (reward - m)/(s + 1e-8) ELSE reward END AS normalized FROM n"""),
)
def _(spark, d):
    return RW.normalized_reward(rewards(spark, d), ["request_id"], "reward", block=1024).select("request_id", "normalized")


@query(
    "response_reward",
    W("samples", f"""SELECT id, CASE WHEN length(output) < 50 THEN 0e0 WHEN {any_sql('lower(output)', [p.replace("'", "''") for p in RW.FAILED])} THEN 0.2e0 ELSE 0.6e0*least(1e0, length(output)/500) + 0.4e0*least(1e0,
 len(list_intersect(list_distinct(string_split_regex(trim(lower(instruction),' \n'),'\\s+')), list_distinct(string_split_regex(trim(lower(output),' \n'),'\\s+'))))/greatest(len(list_distinct(string_split_regex(trim(lower(instruction),' \n'),'\\s+'))),1)) END AS reward FROM samples"""),
)
def _(spark, d):
    return B.samples(spark, d).select("id", RW.response_reward(F.col("instruction"), F.col("output")).alias("reward"))


_RET = _STEPS + """, rt AS (SELECT a.user_id, a.step, sum(b.reward * pow(0.99e0, b.step - a.step)) AS ret FROM st a JOIN st b ON a.user_id = b.user_id AND b.step >= a.step GROUP BY 1, 2),
rs AS (SELECT user_id, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n FROM rt GROUP BY 1) """


@query("discounted_returns", W("requests", _RET + 'SELECT user_id, step, ret AS "return", CASE WHEN n > 1 THEN (ret - m)/(s + 1e-8) ELSE ret END AS normalized FROM rt JOIN rs USING (user_id)'))
def _(spark, d):
    r = RW.discounted_returns(episodes(spark, d), ["user_id"], "step", "reward")
    return r.select("user_id", "step", "return", "normalized")


@query(
    "gae",
    W("requests", _STEPS + """, v AS (SELECT *, (request_id*31 % 100)/100e0 AS value, request_id % 23 = 0 AS done, lead((request_id*31 % 100)/100e0) OVER (PARTITION BY user_id ORDER BY step) AS nv, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS back FROM st),
dl AS (SELECT *, reward - value + CASE WHEN done THEN 0 ELSE 0.99e0*coalesce(nv, 0.5e0) END AS delta FROM v),
g AS (SELECT user_id, step, back, delta AS adv, value FROM dl WHERE back = 1 UNION ALL SELECT d.user_id, d.step, d.back, d.delta + CASE WHEN d.done THEN 0 ELSE 0.99e0*0.95e0*g.adv END, d.value FROM g JOIN dl d ON d.user_id = g.user_id AND d.back = g.back + 1)
SELECT user_id, step, adv AS advantage, adv + value AS "return" FROM g""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, d):
    e = episodes(spark, d).withColumns({"value": F.col("request_id") * 31 % 100 / 100.0, "done": F.col("request_id") % 23 == 0, "nv": F.lit(0.5)})
    return RW.gae(e, ["user_id"], "step", "reward", "value", "done", "nv").select("user_id", "step", "advantage", "return")


@query(
    "experience_stats",
    W("requests", """, x AS (SELECT * FROM requests ORDER BY request_id DESC LIMIT 10000) SELECT coalesce(adapter,'all') AS adapter, count(*) AS size, avg(latency_ms) AS mean_reward, stddev_pop(latency_ms) AS std_reward FROM x GROUP BY GROUPING SETS ((adapter), ())"""),
)
def _(spark, d):
    return RW.experience_stats(B.requests(spark, d), [F.desc("request_id")], "latency_ms")


@query(
    "weighted_vector_merge",
    W("vectors", """, w AS (SELECT * FROM (VALUES ('reasoning',0.5e0),('code',0.25e0),('creative',0.25e0)) t(adapter,w)), p AS (SELECT adapter, vec_id // 4 AS key, v FROM vectors QUALIFY row_number() OVER (PARTITION BY adapter, vec_id // 4 ORDER BY vec_id) = 1)
SELECT key, k::INT - 1 AS pos, sum(w*v[k]) AS value FROM p JOIN w USING (adapter), range(1,65) r(k) GROUP BY 1, 2"""),
)
def _(spark, d):
    from plumbline.plans.ordering import first_per_key

    v = B.vectors(spark, d).withColumn("key", F.floor(F.col("vec_id") / 4))
    v = first_per_key(v, [F.col("adapter"), F.col("key")], ["vec_id"])
    return RW.weighted_vector_merge(v.select("adapter", "key", F.col("v").alias("values")), {"reasoning": 2, "code": 1, "creative": 1})
