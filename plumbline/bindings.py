"""Logical tables (requests, samples, predictions ...) derived from the given Parquet tables.

Each binding exists twice: as a DataFrame and as SQL text (a CTE) for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import vectors as V

# Adapter names in id order; tiers in id order; classes of a prediction.
ADAPTERS = ["reasoning", "code", "creative", "analysis"]
TIERS = ["free", "pro", "enterprise"]
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter_of(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ADAPTERS]), (F.pmod(i, F.lit(4)) + 1).cast("int"))


def requests(spark, d) -> DataFrame:
    return request_columns(table(spark, d, "events"))


def request_columns(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming read of the event table."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("request_id"),
        "user_id",
        adapter_of(F.col("event_id")).alias("adapter"),
        "ts",
        (F.col("value") * 10).alias("latency_ms"),
        (k % 17 + 1).alias("tokens_in"),
        k.alias("tokens_out"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_type") == "view").alias("cached"),
    )


def evaluations(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 3 <> 0")
    n = F.when(F.col("event_id") % 50 == 1, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    score = ((F.col("event_id") * 7919 + (F.col("n") - 1) * 137) % 1000) / 1000.0
    return (
        e.select("event_id", F.explode(n).alias("n"))
        .select(F.col("event_id").alias("request_id"), F.col("n").cast("bigint").alias("eval_no"), score.alias("overall_score"))
        .withColumn("is_failure", F.col("overall_score") < 0.6)
    )


def users(spark, d) -> DataFrame:
    u = table(spark, d, "events").select("user_id").distinct()
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("user_id") % 3 + 1).cast("int"))
    return u.select("user_id", F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com")).alias("email"), tier.alias("tier"))


def feedback(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 5 = 2")
    return e.select(
        F.col("event_id").alias("request_id"),
        (F.col("event_id") * 31 % 5 + 1).alias("rating"),
        (F.col("event_id") % 2 == 0).alias("thumbs_up"),
    )


def samples(spark, d) -> DataFrame:
    """Instruction rows: a user turn, the assistant turn after it, and the system turn as input."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    s = c.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("input"))
    n = F.length("instruction")
    return (
        u.join(a, ["conv_id", "turn"])
        .join(s, "conv_id", "left")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            "conv_id",
            "instruction",
            F.coalesce("input", F.lit("")).alias("input"),
            "output",
            adapter_of(F.col("conv_id") + F.col("turn")).alias("adapter"),
            F.when(n < 120, "easy").when(n < 260, "medium").otherwise("hard").alias("complexity"),
        )
    )


def pairs(spark, d) -> DataFrame:
    """(pred, ref): an assistant turn and the assistant turn two turns later."""
    a = table(spark, d, "conversations").where("role = 'assistant'")
    left = a.select("conv_id", "turn", F.col("text").alias("pred"))
    right = a.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("ref"))
    return left.join(right, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "pred", "ref"
    )


def predictions(spark, d) -> DataFrame:
    """Class probabilities: softmax of ten times the first ten dimensions."""
    e = table(spark, d, "embeddings")
    z = F.transform(F.slice(V.as_double(F.col("embedding")), 1, CLASSES), lambda x: x * 10)
    return e.select(F.col("vec_id").alias("item"), "label", z.alias("logits")).withColumn("probs", V.softmax(F.col("logits")))


def mc_samples(spark, d) -> DataFrame:
    """(item, sample, probs): dimensions 10k..10k+9 are stochastic pass k = 0..5."""
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("item"), V.as_double(F.col("embedding")).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("sample")
    )
    z = F.transform(F.slice("v", F.col("sample") * 10 + 1, 10), lambda x: x * 10)
    return e.select("item", "sample", z.alias("logits")).select("item", "sample", V.softmax(F.col("logits")).alias("probs"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", V.as_double(F.col("embedding")).alias("v"), "label", adapter_of(F.col("label")).alias("adapter")
    )


def metrics(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("name"),
        F.create_map(F.lit("adapter"), adapter_of(F.col("event_id")), F.lit("user"), (F.col("user_id") % 3).cast("string")).alias("labels"),
        "ts",
        "value",
    )


_ADAPTER = "['reasoning','code','creative','analysis'][CAST(({i}) % 4 AS INT) + 1]"
_SOFTMAX = (
    "list_transform(list_transform({z}, lambda x: exp(x - list_max({z}))), "
    "lambda e: e / list_sum(list_transform({z}, lambda x: exp(x - list_max({z})))))"
)

CTE = {
    "requests": f"""requests AS (SELECT event_id AS request_id, user_id, {_ADAPTER.format(i='event_id')} AS adapter, ts,
  value*10 AS latency_ms, k % 17 + 1 AS tokens_in, k AS tokens_out, event_type <> 'error' AS success, event_type = 'view' AS cached
  FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events))""",
    "evaluations": """evaluations AS (SELECT event_id AS request_id, n AS eval_no, ((event_id*7919 + (n-1)*137) % 1000) / 1000e0 AS overall_score,
  ((event_id*7919 + (n-1)*137) % 1000) / 1000e0 < 0.6e0 AS is_failure
  FROM (SELECT event_id, unnest(range(1, CASE WHEN event_id % 50 = 1 THEN 3 ELSE 2 END)) AS n FROM events WHERE event_id % 3 <> 0))""",
    "users": """users AS (SELECT DISTINCT user_id, 'user' || user_id || '@example.com' AS email, ['free','pro','enterprise'][CAST(user_id % 3 AS INT) + 1] AS tier FROM events)""",
    "feedback": """feedback AS (SELECT event_id AS request_id, event_id*31 % 5 + 1 AS rating, event_id % 2 = 0 AS thumbs_up FROM events WHERE event_id % 5 = 2)""",
    "samples": f"""samples AS (SELECT u.conv_id*1000 + u.turn AS id, u.conv_id, u.text AS instruction, coalesce(s.input,'') AS input, a.text AS output,
  {_ADAPTER.format(i='u.conv_id + u.turn')} AS adapter, CASE WHEN length(u.text) < 120 THEN 'easy' WHEN length(u.text) < 260 THEN 'medium' ELSE 'hard' END AS complexity
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS input FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')""",
    "pairs": """pairs AS (SELECT a.conv_id*1000 + a.turn AS id, a.text AS pred, b.text AS ref FROM conversations a JOIN conversations b
  ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 WHERE a.role = 'assistant' AND b.role = 'assistant')""",
    "predictions": f"""logits_t AS (SELECT vec_id AS item, label, list_transform(embedding[1:10], lambda x: x::DOUBLE * 10) AS logits FROM embeddings),
  predictions AS (SELECT item, label, logits, {_SOFTMAX.format(z='logits')} AS probs FROM logits_t)""",
    "mc_samples": f"""mc_logits AS (SELECT vec_id AS item, sample, list_transform(embedding[sample*10+1 : sample*10+10], lambda x: x::DOUBLE * 10) AS logits
  FROM embeddings, range(6) r(sample)), mc_samples AS (SELECT item, sample, {_SOFTMAX.format(z='logits')} AS probs FROM mc_logits)""",
    "vectors": f"""vectors AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label, {_ADAPTER.format(i='label')} AS adapter FROM embeddings)""",
    "metrics": f"""metrics AS (SELECT event_id, event_type AS name, {_ADAPTER.format(i='event_id')} AS adapter, CAST(user_id % 3 AS VARCHAR) AS usr, ts, value FROM events)""",
}


def with_ctes(names: str, body: str) -> str:
    """SQL text with the named bindings in front; `body` may start with its own CTEs (', x AS ...')."""
    return "WITH " + ", ".join(CTE[n] for n in names.split()) + " " + body
