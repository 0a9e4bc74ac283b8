"""End-to-end compositions of the operators, each one declarative plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import cleaning as C
from plumbline.operators import dedup as DD
from plumbline.operators import drift as D
from plumbline.operators import monitoring as M
from plumbline.operators import scoring as S
from plumbline.operators import splitting as SP
from plumbline.operators import synthesis as Y
from plumbline.plans.runtime import checkpointed


def curate(df: DataFrame, row_id: str, validation: float = 0.1, global_dedup: bool = False, seed: int = 42) -> DataFrame:
    """Split, clean, validate, deduplicate. Copies are looked for inside each split, so the two
    splits can share a row; `global_dedup` looks across them."""
    split = SP.split_train_val(df, row_id, validation, seed)
    valid = C.strip_html_example(split).where(C.reject_reason().isNull())
    return DD.dedup_md5(valid, [row_id], within=[] if global_dedup else ["split"])


def preprocess_batch(
    df: DataFrame, row_id: str, clean: bool = True, keep_valid: bool = True, dedupe: bool = True,
    fields: Sequence[str] = ("instruction", "output"), max_length: int | None = None,
) -> DataFrame:
    """Texts stay whole, of any length; with `max_length` they are cut to it, or, if not cleaned, longer ones are dropped."""
    if clean:
        df = C.clean_example(df, max_length=max_length)
    if keep_valid:
        df = C.filter_examples(df, max_length=max_length)
    return DD.dedup_exact(df, fields, [row_id]) if dedupe else df


def evaluate_and_diagnose(
    df: DataFrame, row_id: str, query: str, response: str, vec: str, eps: float = 0.3, min_points: int = 5, judge: Column | None = None
) -> DataFrame:
    """Scores, failure clusters and the actions recommended for them."""
    scored = S.self_eval(df, query, response, judge=judge)
    bad = scored.where("is_failure").select(row_id, vec, "adapter", "failure_type", F.col("overall_score").alias("score"))
    # scores feed several branches of the clustering, so they are computed once
    patterns = S.failure_clusters(checkpointed(bad), row_id, vec, eps, min_points)
    return S.improvement_actions(patterns)


def monitor(requests: DataFrame, scores: DataFrame, window: int = 100) -> DataFrame:
    """Adapter statistics with the change of quality since the reference window."""
    b = M.adapter_breakdown(requests)
    q = D.reference_window(scores, "request_id", "request_id", window)
    tokens = requests.groupBy("adapter").agg(
        (F.sum("tokens_in") / 1000 * 0.001 + F.sum("tokens_out") / 1000 * 0.002).alias("cost")
    )
    health = F.when(F.col("success_rate") > 0.95, "healthy").otherwise("degraded")
    return b.join(tokens, "adapter").join(q.select("adapter", "quality_change", "quality_drift"), "adapter", "left").withColumn("health", health)


def adversarial_loop(
    df: DataFrame, row_id: str, query: str, response: str, per_failure: int = 5, per_adapter: int = 1000, judge: Column | None = None, seed: int = 42
) -> DataFrame:
    """Failures, perturbed copies, validation, a bounded sample per adapter and its split."""
    bad = S.self_eval(df, query, response, judge=judge).where("is_failure")
    made = Y.from_failures(bad, row_id, query, per_failure)
    made = made.withColumns(
        {"instruction": F.col(query), "output": F.col(response), "variant_id": F.concat_ws("-", F.col(row_id).cast("string"), F.col("copy").cast("string"))}
    )
    good = Y.validate_synthetic(made, "variant_id")
    kept = SP.sample_per_group(good, "adapter", "variant_id", per_adapter, seed)
    return SP.split_three_way(kept, "variant_id", seed=seed)
