"""Constraint columns and verdicts."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.curation import docs, words_sql
from plumbline.catalog.registry import query
from plumbline.functions import text as X
from plumbline.operators import validation as VA

W = B.with_ctes
join = lambda c: F.array_join(c, ";")


def blankable(spark, d):
    """Conversation turns as samples; every seventh output is blank so that checks have work."""
    out = F.when(F.col("id") % 7 == 0, "   ").otherwise(F.col("output"))
    return B.samples(spark, d).withColumn("output", out)


_BL = ", bl AS (SELECT id, instruction, input, CASE WHEN id % 7 = 0 THEN '   ' ELSE output END AS output FROM samples) "
_ERR = "CASE WHEN trim(output) = '' THEN 'output blank' ELSE '' END"


@query("check_training_sample", W("samples", _BL + f"SELECT id, {_ERR} AS errors FROM bl"))
def _(spark, d):
    return blankable(spark, d).select("id", join(VA.check_training_sample()).alias("errors"))


@query(
    "check_router_sample",
    W("predictions samples", """, x AS (SELECT s.id, s.complexity, item % 5 - 1 AS opt, list_transform(p.probs, lambda x: x * CASE WHEN s.id % 3 = 0 THEN 1.1 ELSE 1 END) AS w FROM samples s JOIN predictions p ON p.item = s.id % 400)
SELECT id, array_to_string(list_filter([CASE WHEN opt < 0 THEN 'adapter index' END, CASE WHEN abs(list_sum(w) - 1) > 0.01 THEN 'weights sum' END], lambda z: z IS NOT NULL), ';') AS errors FROM x"""),
)
def _(spark, d):
    s, p = B.samples(spark, d), B.predictions(spark, d)
    j = s.withColumn("item", F.col("id") % 400).join(p, "item")
    scale = F.when(F.col("id") % 3 == 0, 1.1).otherwise(1.0)
    j = j.select("id", F.col("instruction").alias("query"), (F.col("item") % 5 - 1).alias("optimal_adapter"), "probs", scale.alias("k"), "complexity")
    j = j.withColumn("adapter_weights", F.zip_with("probs", F.array_repeat("k", F.size("probs")), lambda x, k: x * k))
    return j.select("id", join(VA.check_router_sample()).alias("errors"))


@query(
    "check_eval_sample",
    W("samples", "SELECT id, CASE WHEN (id % 13)/10e0 > 1 THEN 'score range' ELSE '' END AS errors FROM samples"),
)
def _(spark, d):
    s = B.samples(spark, d).select("id", F.col("instruction").alias("query"), F.col("output").alias("response"), (F.col("id") % 13 / 10.0).alias("quality_score"))
    return s.select("id", join(VA.check_eval_sample()).alias("errors"))


@query(
    "schema_verdict",
    W("samples", _BL + f", e AS (SELECT {_ERR} AS e FROM bl) SELECT count(*) FILTER (WHERE e='') AS valid, count(*) FILTER (WHERE e<>'') AS invalid, 'low' AS quality, false AS is_valid FROM e"),
)
def _(spark, d):
    return VA.schema_verdict(blankable(spark, d), VA.check_training_sample())


_REP = f"""w AS (SELECT doc_id, text, {words_sql('lower(text)')} AS w FROM documents),
g AS (SELECT *, list_transform(range(1, greatest(len(w)-1,1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM w),
rep AS (SELECT doc_id, text, CASE WHEN len(w) < 5 THEN 0e0 ELSE 1e0 - len(list_distinct(g))/len(g) END AS repetition FROM g)"""


@query("ngram_repetition", f"WITH {_REP} SELECT doc_id, repetition FROM rep")
def _(spark, d):
    return docs(spark, d).select("doc_id", VA.ngram_repetition("text").alias("repetition"))


@query(
    "text_quality",
    f"""WITH {_REP}, f AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 10 THEN 'too short' END, CASE WHEN length(text) > 50000 THEN 'too long' END], lambda z: z IS NOT NULL), ';') AS errors,
 array_to_string(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'replacement characters' END, CASE WHEN repetition > 0.3e0 THEN 'repetition' END], lambda z: z IS NOT NULL), ';') AS warnings FROM rep)
SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN warnings <> '' THEN 'medium' ELSE 'high' END AS quality FROM f""",
)
def _(spark, d):
    q = VA.text_quality(docs(spark, d), "text")
    return q.select("doc_id", join(F.col("errors")).alias("errors"), join(F.col("warnings")).alias("warnings"), "quality")


@query(
    "dataset_verdict",
    W("samples", _BL + f""", e AS (SELECT *, {_ERR} AS e FROM bl),
f AS (SELECT string_agg(id || ': ' || e, '; ' ORDER BY id) AS t FROM (SELECT * FROM e WHERE e <> '' ORDER BY id LIMIT 10))
SELECT count(*) AS total, count(*) FILTER (WHERE e='') AS valid, count(*) FILTER (WHERE e<>'') AS invalid, count(*) FILTER (WHERE instruction='') AS missing_instruction, count(*) FILTER (WHERE output='') AS missing_output,
 count(*) - count(DISTINCT (instruction, input, output)) AS duplicates, any_value(f.t) AS first_errors, 'low' AS quality FROM e, f"""),
)
def _(spark, d):
    return VA.dataset_verdict(blankable(spark, d), "id", VA.check_training_sample(), data_columns=["instruction", "input", "output"])


@query(
    "request_field_checks",
    W("samples", """, r AS (SELECT id, instruction AS prompt, CASE WHEN id % 11 = 0 THEN 'other' ELSE adapter END AS adapter, id % 600 AS max_tokens, (id % 25)/10e0 AS temperature, (id % 11)/10e0 AS top_p FROM samples)
SELECT id, array_to_string(list_filter([CASE WHEN length(prompt) NOT BETWEEN 1 AND 4096 THEN 'prompt' END, CASE WHEN adapter = 'other' THEN 'adapter' END, CASE WHEN max_tokens NOT BETWEEN 1 AND 512 THEN 'max_tokens' END,
 CASE WHEN temperature NOT BETWEEN 0.1e0 AND 2 THEN 'temperature' END, CASE WHEN top_p NOT BETWEEN 0.1e0 AND 1 THEN 'top_p' END], lambda z: z IS NOT NULL), ';') AS errors, least(greatest(temperature,0.1e0),2e0) AS temperature FROM r"""),
)
def _(spark, d):
    i = F.col("id")
    r = B.samples(spark, d).select(
        "id", F.col("instruction").alias("prompt"), F.when(i % 11 == 0, "other").otherwise(F.col("adapter")).alias("adapter"),
        (i % 600).alias("max_tokens"), (i % 25 / 10.0).alias("temperature"), (i % 11 / 10.0).alias("top_p"),
    )
    return r.select("id", join(VA.check_request()).alias("errors"), VA.clamp("temperature", 0.1, 2.0).alias("temperature"))


# --- scalar functions


@query("words", f"SELECT doc_id, len({words_sql('text')}) AS n, array_to_string({words_sql('text')}[1:5], '|') AS head FROM documents")
def _(spark, d):
    w = docs(spark, d).select("doc_id", X.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n"), F.array_join(F.slice("w", 1, 5), "|").alias("head"))


_STOP = ["the", "a", "of", "and"]
_SET = lambda c: f"list_filter(list_distinct({words_sql(f'lower({c})')}), lambda x: x NOT IN ('the','a','of','and'))"


@query("word_overlap", W("samples", f"SELECT id, len(list_intersect({_SET('instruction')}, {_SET('output')})) AS overlap FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", X.word_overlap("instruction", "output", _STOP).cast("bigint").alias("overlap"))


@query("count_phrases", "SELECT doc_id, (contains(lower(text),'the')::INT + contains(lower(text),'die')::INT + contains(lower(text),'que')::INT)::BIGINT AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.count_phrases(F.lower("text"), ["the", "die", "que"]).cast("bigint").alias("n"))


@query(
    "ngrams",
    f"WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark) SELECT item_id, array_to_string(list_transform(range(1, greatest(len(w)-1,1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]), '|') AS grams FROM w",
)
def _(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", F.array_join(X.ngrams(X.words("text"), 3), "|").alias("grams"))


@query(
    "vector_functions",
    W("vectors", """SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS cosine, list_distance(a.v, b.v) AS l2, list_distance(a.v, b.v)**2 AS sqdist FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"""),
)
def _(spark, d):
    from plumbline.functions import vectors as V

    v = B.vectors(spark, d)
    j = v.select("vec_id", "v").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    a, b = F.col("v"), F.col("w")
    return j.select("vec_id", V.cosine(a, b).alias("cosine"), V.l2(a, b).alias("l2"), V.sqdist(a, b).alias("sqdist"))


@query("distribution_functions", W("predictions", "SELECT item, -list_sum(list_transform(probs, lambda p: p*ln(p+1e-10))) AS entropy, list_position(probs, list_max(probs))::INT - 1 AS top FROM predictions"))
def _(spark, d):
    from plumbline.functions import vectors as V

    return B.predictions(spark, d).select("item", V.entropy(F.col("probs")).alias("entropy"), V.argmax(F.col("probs")).alias("top"))


@query(
    "format_functions",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN printf('%.2f', o_totalprice) WHEN o_totalprice < 1000000 THEN printf('%.2fK', o_totalprice/1000) ELSE printf('%.2fM', o_totalprice/1000000) END AS num,
 CASE WHEN o_orderkey < 60 THEN printf('%.1fs', o_orderkey::DOUBLE) WHEN o_orderkey < 3600 THEN (o_orderkey // 60) || 'm ' || (o_orderkey % 60) || 's' ELSE (o_orderkey // 3600) || 'h ' || (o_orderkey % 3600 // 60) || 'm ' || (o_orderkey % 60) || 's' END AS t FROM orders""",
)
def _(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", X.format_number(F.col("o_totalprice")).alias("num"), X.format_time(F.col("o_orderkey")).alias("t"))


@query("glob_match", "SELECT doc_id, source LIKE 'src1%' AS a, regexp_matches(source, '^src[0-4]$') AS b FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", X.glob_match("source", "src1*").alias("a"), X.glob_match("source", "src[0-4]").alias("b"))


@query("json_field", "SELECT event_id, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS k FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
