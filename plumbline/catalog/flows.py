"""End-to-end compositions."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline import flows as FL
from plumbline.catalog.curation import clean_sql, html_sql, refusal_sql, words_sql
from plumbline.catalog.drift import scores
from plumbline.catalog.registry import query
from plumbline.operators import cleaning as C
from plumbline.plans.ordering import ranked

W = B.with_ctes

# every row once more with a new id, so that deduplication has copies to find
_TWICE = ", tw AS (SELECT * FROM samples UNION ALL SELECT id + 1000000000, conv_id, instruction, input, output, adapter, complexity FROM samples) "
_CUR = _TWICE + f""", sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(id::VARCHAR || '|42')) <= floor(count(*) OVER ()*0.9e0) THEN 'train' ELSE 'validation' END AS split FROM tw),
cl AS (SELECT id, split, {html_sql('instruction')} AS i, {html_sql('input')} AS p, {html_sql('output')} AS o FROM sp),
ok AS (SELECT * FROM cl WHERE i <> '' AND o <> '' AND length(i) BETWEEN 10 AND 1000 AND length(o) BETWEEN 20 AND 5000 AND NOT {refusal_sql('o', C.REFUSALS)} AND len({words_sql('o')}) >= 5) """


def twice(spark, d):
    s = B.samples(spark, d)
    return s.union(s.withColumn("id", F.col("id") + 1000000000))


@query("curate", W("samples", _CUR + "SELECT min(id) AS id, split FROM ok GROUP BY split, md5(i || p || o)"))
def _(spark, d):
    return FL.curate(twice(spark, d), "id").select("id", "split")


@query("curate_global", W("samples", _CUR + "SELECT id, split FROM ok QUALIFY row_number() OVER (PARTITION BY md5(i || p || o) ORDER BY id) = 1"))
def _(spark, d):
    return FL.curate(twice(spark, d), "id", global_dedup=True).select("id", "split")


@query(
    "preprocess_batch",
    W("samples", _TWICE + f", c AS (SELECT id, {clean_sql('instruction')} AS i, {clean_sql('output')} AS o FROM tw) SELECT min(id) AS id, i AS instruction FROM c WHERE i <> '' AND o <> '' AND length(o) BETWEEN 10 AND 2048 GROUP BY i, o"),
)
def _(spark, d):
    return FL.preprocess_batch(twice(spark, d), "id").select("id", "instruction")


def with_vectors(samples, vectors):
    """Rows by id take the vectors by (label, vec_id) in turn, from the first again when all are used."""
    v = ranked(vectors.select("label", "vec_id", "v"), ["label", "vec_id"], name="__turn").drop("label")
    s = ranked(samples, ["id"], name="__rank").withColumn("__turn", F.pmod(F.col("__rank") - 1, F.lit(max(v.count(), 1))) + 1)
    return s.join(v, "__turn").drop("__turn", "__rank")


@query("evaluate_and_diagnose")
def _(spark, d):
    """Each instruction row takes the vector with the number of its position."""
    j = with_vectors(B.samples(spark, d), B.vectors(spark, d))
    judge = F.col("id") * 7919 % 1000 / 1000.0
    return FL.evaluate_and_diagnose(j, "id", "instruction", "output", "v", eps=1.25, min_points=3, judge=judge)


@query(
    "monitor",
    W("requests evaluations", """, b AS (SELECT adapter, count(*) AS requests, avg(success::INT::DOUBLE) AS success_rate, avg(latency_ms) AS mean_latency_ms, quantile_cont(latency_ms,0.95) AS p95_latency_ms,
 sum(tokens_in)/1000*0.001e0 + sum(tokens_out)/1000*0.002e0 AS cost FROM requests GROUP BY 1),
sc AS (SELECT r.request_id, r.adapter, e.overall_score AS score FROM requests r JOIN evaluations e USING (request_id) WHERE e.eval_no = 1),
f AS (SELECT adapter, avg(score) AS r FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY request_id) <= 100) GROUP BY 1),
l AS (SELECT adapter, avg(score) AS c FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY request_id DESC) <= 100) GROUP BY 1)
SELECT b.*, c - r AS quality_change, c - r < -0.1e0 AS quality_drift, CASE WHEN success_rate > 0.95e0 THEN 'healthy' ELSE 'degraded' END AS health FROM b JOIN f USING (adapter) JOIN l USING (adapter)"""),
)
def _(spark, d):
    return FL.monitor(B.requests(spark, d), scores(spark, d))


@query("adversarial_loop")
def _(spark, d):
    judge = F.col("id") * 7919 % 1000 / 1000.0
    a = FL.adversarial_loop(B.samples(spark, d), "id", "instruction", "output", per_adapter=50, judge=judge)
    return a.select("variant_id", "adapter", "split", "instruction")
