"""Router outputs: keyword routes, decisions, fallbacks, losses and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.functions import vectors as V
from plumbline.functions.keyed import uniform
from plumbline.plans.ordering import top_n_per_group

# Keyword lists, first match wins; everything else is reasoning.
KEYWORDS = {
    "code": ["code", "python", "function", "debug", "programming"],
    "creative": ["write", "story", "creative", "poem", "imagine"],
    "analysis": ["analyze", "data", "summarize", "research", "compare"],
}
MORE_CODE = ["javascript"]
ADAPTERS = ["reasoning", "code", "creative", "analysis"]
LEVELS = ["easy", "medium", "hard"]


def keyword_route(query: Column, extra_code: Sequence[str] = ()) -> Column:
    low, out = F.lower(query), None
    for name, keys in KEYWORDS.items():
        hit = X.any_phrase(low, [*keys, *(extra_code if name == "code" else ())])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("reasoning")


def keyword_route_probs(query: Column) -> Column:
    """0.15 each plus 0.55 on the match, normalised, in adapter order."""
    hit = keyword_route(query, MORE_CODE)
    total = 0.15 * len(ADAPTERS) + 0.55
    return F.array(*[F.when(hit == a, 0.70 / total).otherwise(0.15 / total) for a in ADAPTERS])


def name_of(index: Column, names: Sequence[str] = ADAPTERS) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def routing_decision(rows: DataFrame, weights: str, complexity: str, names: Sequence[str] = ADAPTERS, threshold: float = 0.1) -> DataFrame:
    w = F.col(weights)
    ranked = F.sort_array(F.transform(w, lambda x, i: F.struct((-x).alias("nw"), i.alias("i"))))
    selected = F.transform(F.filter(ranked, lambda s: -s["nw"] > threshold), lambda s: name_of(s["i"], names))
    all_names = F.array(*[F.lit(n) for n in names])
    return rows.withColumns(
        {
            "selected": selected, "primary": name_of(V.argmax(w), names), "primary_weight": F.array_max(w),
            "predicted_complexity": name_of(V.argmax(F.col(complexity)), LEVELS), "weight_map": F.map_from_arrays(all_names, w),
        }
    )


def route_fallback(rows: DataFrame, batch: str, weights: str, confidence: str, minimum: float = 0.5, top_k: int | None = None) -> DataFrame:
    """Where a batch's mean confidence is low: uniform weights, or 1/k on the k largest."""
    mean = rows.groupBy(batch).agg(F.avg(confidence).alias("__mean"))
    w = F.col(weights)
    if top_k is None:
        other = F.transform(w, lambda x: F.lit(1.0) / F.size(w))
    else:
        order = F.sort_array(F.transform(w, lambda x, i: F.struct((-x).alias("nw"), i.alias("i"))))
        best = F.transform(F.slice(order, 1, top_k), lambda s: s["i"])
        other = F.transform(w, lambda x, i: F.when(F.array_contains(F.col("__best"), i), 1.0 / top_k).otherwise(0.0))
        rows = rows.withColumn("__best", best)
    low = F.col("__mean") < minimum
    return rows.join(mean, batch).withColumns({weights: F.when(low, other).otherwise(w), "fallback": low}).drop("__mean", "__best")


def route_ensemble(outputs: DataFrame, item: str, router: str, weights: str, logits: dict[str, float] | None = None) -> DataFrame:
    """Mean of the routers' weights, or their softmax-weighted mean."""
    import math

    e = outputs.select(item, router, F.posexplode(weights).alias("k", "w"))
    if logits is None:
        value = F.avg("w")
    else:
        z = sum(math.exp(v) for v in logits.values())
        share = F.lit(0.0)
        for name, v in logits.items():
            share = F.when(F.col(router) == name, math.exp(v) / z).otherwise(share)
        value = F.sum(F.col("w") * share)
    per = e.groupBy(item, "k").agg(value.alias("w"))
    cells = F.sort_array(F.collect_list(F.struct("k", "w")))
    return per.groupBy(item).agg(F.transform(cells, lambda s: s["w"]).alias("weights"))


def router_eval(rows: DataFrame, weights: str, target: str, complexity: str, target_complexity: str, names: Sequence[str] = ADAPTERS) -> DataFrame:
    """Accuracy overall and per true adapter (grouping sets), mean entropy. One row per group."""
    r = rows.select(
        (V.argmax(F.col(weights)) == V.argmax(F.col(target))).cast("double").alias("hit"),
        (V.argmax(F.col(complexity)) == F.col(target_complexity)).cast("double").alias("chit"),
        V.entropy(F.col(weights)).alias("h"), name_of(V.argmax(F.col(target)), names).alias("adapter"),
    )
    g = r.groupingSets([["adapter"], []], "adapter").agg(
        F.avg("hit").alias("routing_accuracy"), F.avg("chit").alias("complexity_accuracy"), F.avg("h").alias("mean_entropy"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumn("adapter", F.coalesce("adapter", F.lit("all")))


def router_losses(
    rows: DataFrame, weight_logits: str, target: str, complexity_logits: str, complexity: str, scores: str, n: int, margin: float = 0.1
) -> DataFrame:
    """KL to the target, cross entropy of the complexity, pairwise ranking hinge; weights 1, .5, .3."""
    r = rows.select(
        V.softmax(F.col(weight_logits)).alias("w"), F.col(target).alias("t"), F.col(complexity_logits).alias("cz"),
        F.col(complexity).alias("c"), F.col(scores).alias("s"),
    )
    kl = V.total(F.zip_with("t", "w", lambda t, w: F.when(t > 0, t * (F.ln(t) - F.ln(w))).otherwise(0.0)))
    ce = -F.ln(F.element_at(V.softmax(F.col("cz")), F.col("c") + 1))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    hinge = F.lit(0.0)
    for i, j in pairs:
        want = F.signum(F.col("s")[i] - F.col("s")[j])
        hinge = hinge + F.greatest(F.lit(0.0), margin - want * (F.col("w")[i] - F.col("w")[j]))
    m = r.agg(F.avg(kl).alias("routing"), F.avg(ce).alias("complexity"), F.avg(hinge / max(len(pairs), 1)).alias("ranking"))
    return m.withColumn("total", F.col("routing") + 0.5 * F.col("complexity") + 0.3 * F.col("ranking"))


def adaptive_weights(scores: DataFrame, order: Sequence, row_id: str, names: Sequence[str] = ADAPTERS, last: int = 100) -> DataFrame:
    """Softmax over the mean of each adapter's newest scores; 0.5 without scores."""
    recent = top_n_per_group(scores, ["adapter"], order, last, [row_id]).groupBy("adapter").agg(F.avg("score").alias("m"))
    known = scores.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("adapter"))
    w = known.join(recent, "adapter", "left").withColumn("e", F.exp(F.coalesce("m", F.lit(0.5))))
    # one row per adapter
    return w.select("adapter", (F.col("e") / F.sum("e").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def weighted_choice(rows: DataFrame, row_id: str, weights: DataFrame, names: Sequence[str] = ADAPTERS) -> DataFrame:
    """Keyed draw of an adapter per row from a weight table with one row per adapter."""
    vals = [F.coalesce(F.max(F.when(F.col("adapter") == n, F.col("weight"))), F.lit(0.0)) for n in names]
    d = rows.withColumn("__w", weights.agg(F.array(*vals).alias("w")).scalar()).withColumn("__u", uniform(F.col(row_id), "choice"))
    acc, out = F.lit(0.0), None
    for i, n in enumerate(names[:-1]):
        acc = acc + F.col("__w")[i]
        out = F.when(F.col("__u") < acc, n) if out is None else out.when(F.col("__u") < acc, n)
    return d.withColumn("choice", out.otherwise(names[-1])).drop("__w", "__u")


def quality_correlation(rows: DataFrame, confidence: str, quality: str, weights: str) -> DataFrame:
    return rows.agg(F.corr(confidence, quality).alias("correlation"), F.avg(V.entropy(F.col(weights))).alias("mean_entropy"))
