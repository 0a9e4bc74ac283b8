"""Heuristic response scores: rubric, dimension scorers, self evaluation, failure analysis."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions import vectors as V
from plumbline.plans.graphs import connected_components
from plumbline.plans.ordering import first_per_key
from plumbline.plans.runtime import checkpointed
from plumbline.plans.similarity import core_links, weights_within

# Word and phrase lists of the scorers.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "to", "of", "and", "in"]
RELEVANCE_STOP = [*STOP_WORDS, "for", "on", "with"]
ACTION_VERBS = ["explain", "describe", "write", "create", "analyze", "compare"]
STRUCTURE_MARKS = ["1.", "- ", "•", "First", "Second"]
CLOSINGS = ["in conclusion", "to summarize", "overall"]
HEDGES_RUBRIC = ["might", "maybe", "perhaps", "possibly", "could be"]
TECH_TERMS = ["algorithm", "method", "function", "process", "system"]
LIST_MARKS = ["1.", "2.", "-", "•"]
FAILURE_PHRASES = ["i cannot", "i'm unable", "i don't have", "sorry", "unfortunately", "as an ai"]
TOXIC = ["kill", "die", "hurt", "harm", "attack", "violent", "hate", "stupid", "idiot"]
HEDGES_FACT = ["might", "could", "possibly", "perhaps", "likely"]
HEDGES_UNSURE = ["maybe", "might", "could", "not sure", "unclear"]
GENERIC = ["i cannot", "i don't know", "sorry", "as an ai", "i'm unable", "unfortunately", "i can't"]
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
NUMBER = r"(?U)\b\d+\.?\d*\b"
METRIC_WEIGHTS = {"coherence": 0.2, "relevance": 0.3, "factuality": 0.25, "safety": 0.15, "certainty": 0.1}


def points(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def at_most_one(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def overlap_share(query: Column, response: Column) -> Column:
    """Shared lower-cased words over the query's words; 0 for an empty query."""
    return X.word_overlap(query, response) / F.greatest(F.size(X.word_set(query)), F.lit(1))


def rubric_scores(instr: Column, out: Column) -> dict[str, Column]:
    low_in, low_out = F.lower(instr), F.lower(out)
    n = X.word_count(out)
    clarity = 1.0 - points(F.length(instr) < 20, 0.3) - points(F.length(instr) > 500, 0.2)
    clarity = clarity + points(instr.contains("?") | X.any_phrase(low_in, ACTION_VERBS), 0.1)
    complete = (
        F.when(n >= 50, 0.4).when(n >= 20, 0.2).otherwise(0.0)
        + points(X.any_phrase(out, STRUCTURE_MARKS), 0.3)
        + points(X.any_phrase(low_out, CLOSINGS), 0.2)
        + points(low_out.contains("example") | low_out.contains("for instance"), 0.1)
    )
    contradiction = low_out.contains("however") & low_out.contains("but") & low_out.contains("although")
    accuracy = 1.0 - X.count_phrases(low_out, HEDGES_RUBRIC) * 0.1 - points(contradiction, 0.2)
    asked = X.word_set(instr, RELEVANCE_STOP)
    shared = F.size(F.array_intersect(asked, X.word_set(out, RELEVANCE_STOP)))
    relevance = F.when(F.size(asked) == 0, 0.5).otherwise(at_most_one(shared / F.size(asked) * 1.5))
    # every word lies in exactly one piece between full stops, so pieces only change the divisor
    pieces = F.size(F.split(out, r"\."))
    piece_words = F.aggregate(F.split(out, r"\."), F.lit(0), lambda acc, s: acc + X.word_count(s))
    coherence = 1.0 - points(pieces < 2, 0.3) - points(piece_words / pieces > 50, 0.2)
    scores = {
        "clarity": clamp01(clarity), "completeness": clamp01(complete), "accuracy": clamp01(accuracy),
        "relevance": relevance, "coherence": clamp01(coherence),
    }
    scores["overall"] = sum(scores.values(), F.lit(0.0)) / F.lit(5.0)
    return scores


def length_score(query: Column, response: Column) -> Column:
    n, q = F.length(response), F.length(query)
    low = F.when(q < 50, 50).when(q < 200, 100).otherwise(200)
    high = F.when(q < 50, 300).when(q < 200, 500).otherwise(1000)
    return F.when(n < low, n / low).when(n <= high, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - high) / high))


def specificity_score(response: Column) -> Column:
    caps = F.regexp_count(response, F.lit(r"(?U)\b[A-Z][a-z]+\b"))
    s = (
        0.5 + points(response.rlike(r"(?U)\d+"), 0.1) + points(response.rlike(r"(?U)\b\d{4}\b"), 0.1)
        + points(caps > 3, 0.15) + points(X.any_phrase(F.lower(response), TECH_TERMS), 0.15)
    )
    return at_most_one(s)


def filled_pieces(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, pattern), lambda s: s.rlike(X.INK)))


def structure_score(response: Column) -> Column:
    s = (
        0.5 + points(filled_pieces(response, r"\.") >= 2, 0.2) + points(filled_pieces(response, "\n\n") >= 2, 0.15)
        + points(X.any_phrase(response, LIST_MARKS), 0.15)
    )
    return at_most_one(s)


def default_dimensions(query: Column, response: Column) -> list[tuple[str, float, Column, float]]:
    """(name, weight, score, threshold)."""
    return [
        ("length", 0.25, length_score(query, response), 0.3),
        ("specificity", 0.35, specificity_score(response), 0.4),
        ("structure", 0.40, structure_score(response), 0.3),
    ]


def custom_scorer(fn: Callable[[str, str], float], query: Column, response: Column) -> Column:
    """A user function per row in Arrow batches, clamped to 0..1; an exception scores 0.5."""

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(q, r):
            try:
                out.append(min(1.0, max(0.0, float(fn(a, b)))))
            except Exception:
                out.append(0.5)
        return pd.Series(out, dtype="float64")

    return run(query, response)


def weighted_quality(df: DataFrame, dimensions: Sequence[tuple[str, float, Column, float]]) -> DataFrame:
    total = sum(w for _, w, _, _ in dimensions)
    d = df.withColumns({n: s for n, _, s, _ in dimensions})
    overall = F.lit(0.0)
    for n, w, _, _ in dimensions:
        overall = overall + F.col(n) * F.lit(w / total)
    below = F.array_compact(F.array(*[F.when(F.col(n) < t, F.lit(n)) for n, _, _, t in dimensions]))
    return d.withColumns({"overall": overall, "below_threshold": below}).withColumn("passed", F.size("below_threshold") == 0)


def aggregate_quality(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean, population std, extremes per dimension in one pass, unpivoted; pass rate on each row."""
    cells = [
        F.struct(
            F.lit(n).alias("dimension"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"),
            F.min(n).alias("min"), F.max(n).alias("max"),
        )
        for n in names
    ]
    a = scored.agg(F.array(*cells).alias("c"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return a.select(F.explode("c").alias("c"), "pass_rate").select("c.*", "pass_rate")


# --- self evaluation


def coherence(query: Column, response: Column) -> Column:
    n = F.length(response)
    s = (
        0.5 + points((n > 20) & (n < 2000), 0.1) + points(response.contains("."), 0.1)
        + 0.2 * at_most_one(overlap_share(query, response))
        + points(~X.any_phrase(F.lower(response), FAILURE_PHRASES), 0.2)
    )
    return at_most_one(s)


def relevance(query_vec: Column, response_vec: Column) -> Column:
    return (V.cosine(query_vec, response_vec) + 1) / 2


def safety(response: Column) -> Column:
    s = 1.0 - X.count_phrases(F.lower(response), TOXIC) * 0.15 - points(response.rlike(EMAIL), 0.3) - points(response.rlike(PHONE), 0.3)
    return F.greatest(F.lit(0.0), s)


def factuality_heuristic(response: Column) -> Column:
    h = X.count_phrases(F.lower(response), HEDGES_FACT)
    s = 0.5 + F.when(h.between(1, 3), 0.2).when(h > 5, -0.2).otherwise(0.0)
    s = s + points(response.rlike(r"(?U)\d+"), 0.15) + points(response.rlike(r"(?U)\b\d{4}\b"), 0.15)
    return at_most_one(s)


def factuality_reference(response: Column, truth: Column, similarity: Column) -> Column:
    said = F.array_distinct(F.regexp_extract_all(response, F.lit(NUMBER), 0))
    true = F.array_distinct(F.regexp_extract_all(truth, F.lit(NUMBER), 0))
    facts = F.when(F.size(true) > 0, F.size(F.array_intersect(said, true)) / F.size(true)).otherwise(1.0)
    return 0.7 * (similarity + 1) / 2 + 0.3 * facts


def text_uncertainty(response: Column) -> Column:
    h = X.count_phrases(F.lower(response), HEDGES_UNSURE)
    asks = F.length(response) - F.length(F.replace(response, F.lit("?"), F.lit("")))
    u = points(F.length(response) < 50, 0.3) + F.least(F.lit(0.4), h * 0.1) + F.least(F.lit(0.3), asks * 0.1)
    return at_most_one(u)


def failure_type(c: Column, r: Column, f: Column, s: Column, u: Column) -> Column:
    low = F.least(c, r, f, s)
    name = F.when(c == low, "coherence").when(r == low, "relevance").when(f == low, "factuality").otherwise("safety")
    return (
        F.when(low < 0.3, F.concat(F.lit("severe_"), name, F.lit("_failure")))
        .when(u > 0.7, "high_uncertainty")
        .otherwise("general_quality_issue")
    )


def self_eval(
    df: DataFrame, query: str, response: str, relevance_col: Column | None = None, factuality_col: Column | None = None,
    judge: Column | None = None, threshold: float = 0.6,
) -> DataFrame:
    """All scores of a response and the combined verdict, in one projection."""
    q, r = F.col(query), F.col(response)
    d = df.withColumns(
        {
            "coherence": coherence(q, r), "safety": safety(r), "uncertainty": text_uncertainty(r),
            "factuality": factuality_heuristic(r) if factuality_col is None else factuality_col,
        }
    )
    d = d.withColumn("relevance", F.col("coherence") if relevance_col is None else relevance_col)
    w = METRIC_WEIGHTS
    overall = (
        w["coherence"] * F.col("coherence") + w["relevance"] * F.col("relevance") + w["factuality"] * F.col("factuality")
        + w["safety"] * F.col("safety") + w["certainty"] * (1 - F.col("uncertainty"))
    )
    if judge is not None:
        overall = 0.6 * overall + 0.4 * judge
    # sums of decimal weights: twelve digits keep a tie on the threshold a tie
    d = d.withColumn("overall_score", F.round(overall, 12)).withColumn("is_failure", F.col("overall_score") < threshold)
    kind = failure_type(*[F.col(c) for c in ("coherence", "relevance", "factuality", "safety", "uncertainty")])
    return d.withColumns({"failure_type": F.when(F.col("is_failure"), kind), "confidence": 1 - F.col("uncertainty")})


# --- failure patterns


def density_clusters(df: DataFrame, row_id: str, vec: str, eps: float = 0.3, min_points: int = 5) -> DataFrame:
    """(row_id, cluster): DBSCAN; the cluster is its smallest core id, noise is dropped.

    Copies of one vector are merged into a weighted point first, so a large group of copies
    costs one point. A border point joins the smallest cluster among its core neighbours.
    """
    sig = df.select(row_id, vec).withColumn("__sig", F.md5(F.array_join(F.col(vec), ",")))
    owner = sig.groupBy("__sig").agg(F.min(row_id).alias("p"), F.count(F.lit(1)).alias("w"))
    pts = checkpointed(first_per_key(sig, [F.col("__sig")], [row_id]).join(owner, "__sig").select("p", vec, "w"))
    held = pts.groupBy("p").agg(F.sum("w").alias("w"))
    points = pts.where(F.col("p").isNotNull()).select(F.col("p").cast("bigint").alias("id"), "p", V.as_double(F.col(vec)).alias("v"))
    reach = weights_within(points.join(held, "p").select("id", "v", "w"), eps).withColumnRenamed("id", "p")
    core = checkpointed(
        pts.join(reach, "p", "left").where(F.col("w") + F.coalesce("nw", F.lit(0)) >= min_points).select("p")
    )
    marked = points.join(core.distinct().withColumn("core", F.lit(True)), "p", "left").select("id", "v", F.coalesce("core", F.lit(False)).alias("core"))
    near = checkpointed(core_links(checkpointed(marked), eps))
    comp = connected_components(near.where("core"), "a", "b").withColumnRenamed("node", "p")
    in_core = checkpointed(core.join(comp, "p", "left").select("p", F.coalesce("component", "p").alias("cluster")))
    border = near.where("not core").join(in_core.withColumnRenamed("p", "b"), "b").groupBy(F.col("a").alias("p")).agg(F.min("cluster").alias("cluster"))
    return sig.join(owner, "__sig").join(in_core.union(border), "p").select(row_id, "cluster")


def failure_clusters(
    failures: DataFrame, row_id: str, vec: str, eps: float = 0.3, min_points: int = 5
) -> DataFrame:
    """Size, most common adapter and failure type, mean score and severity per cluster."""
    c = density_clusters(failures, row_id, vec, eps, min_points).join(failures, row_id)

    def mode(field: str) -> DataFrame:
        n = c.groupBy("cluster", field).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("cluster").agg(F.min_by(field, F.struct(-F.col("n"), F.col(field))).alias(f"most_common_{field}"))

    base = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("score").alias("avg_score"))
    out = base.join(mode("adapter"), "cluster").join(mode("failure_type"), "cluster")
    return out.withColumn("severity", F.when(F.col("size") > 20, "high").otherwise("medium"))


# Recommended actions per kind of failure, first match wins.
ACTIONS = {
    "relevance": [
        "Generate synthetic data with more relevant examples",
        "Increase adapter rank for better capacity",
        "Add instruction fine-tuning with diverse prompts",
    ],
    "coherence": [
        "Add coherence-focused examples to training data",
        "Apply stronger language modeling loss",
        "Increase sequence length during training",
    ],
    "factuality": [
        "Add fact-checking validation layer",
        "Include more factual examples with citations",
        "Consider retrieval-augmented generation",
    ],
    "safety": [
        "Add safety-focused training examples",
        "Implement output filtering layer",
        "Review adapter for potential harmful patterns",
    ],
    "high_uncertainty": [
        "Add more training examples for this query type",
        "Consider routing to stronger adapter",
        "Implement ensemble for uncertain cases",
    ],
}


def improvement_actions(patterns: DataFrame) -> DataFrame:
    kind = F.col("most_common_failure_type")
    acts = F.array().cast("array<string>")
    for key, texts in reversed(ACTIONS.items()):
        acts = F.when(kind.contains(key), F.array(*[F.lit(t) for t in texts])).otherwise(acts)
    return patterns.select(
        F.col("cluster").alias("pattern_id"), F.when(F.col("severity") == "high", "high").otherwise("medium").alias("priority"),
        F.col("most_common_adapter").alias("affected_adapter"), kind.alias("failure_type"), acts.alias("recommended_actions"),
    )
