"""Active learning: uncertainty, diversity and committee scores, batch selection."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.calibration import _class_moments
from plumbline.plans.ordering import first_per_key, ranked
from plumbline.plans.runtime import checkpointed
from plumbline.plans.similarity import nearest_other


def uncertainty_score(probs: Column, strategy: str = "entropy") -> Column:
    """entropy, margin (1 - top two apart) or confidence (1 - max); other names mean entropy."""
    top = F.sort_array(probs, asc=False)
    if strategy == "margin":
        return 1 - (top[0] - top[1])
    if strategy in ("confidence", "least_confidence"):
        return 1 - F.array_max(probs)
    return V.entropy(probs)


def select_uncertain(pool: DataFrame, row_id: str, probs: str, n: int, strategy: str = "entropy") -> DataFrame:
    s = pool.withColumn("score", uncertainty_score(F.col(probs), strategy))
    return s.orderBy(F.desc("score"), row_id).limit(n)


def cluster_diversity(pool: DataFrame, row_id: str, vec: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Distance to the own cluster centre over the largest such distance."""
    # the training rounds and the scoring read the same pinned rows
    feats = checkpointed(pool.select(row_id, vec, array_to_vector(F.col(vec)).alias("features")))
    n = feats.count()
    model = KMeans(k=max(2, min(k, n)), seed=seed).fit(feats)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    d = model.transform(feats).select(row_id, V.l2(F.col(vec), F.element_at(centres, F.col("prediction") + 1)).alias("dist"))
    top = d.agg(F.max("dist").alias("m")).scalar()
    return d.withColumn("__m", top).select(row_id, F.coalesce(F.try_divide("dist", "__m"), F.lit(0.0)).alias("diversity"))


def coreset_diversity(pool: DataFrame, row_id: str, vec: str) -> DataFrame:
    return nearest_other(pool, row_id, vec).select(row_id, F.col("dist").alias("diversity"))


def hybrid_select(
    pool: DataFrame, row_id: str, probs: str, diversity: DataFrame, n: int, u_weight: float = 0.6, d_weight: float = 0.4,
    strategy: str = "entropy",
) -> DataFrame:
    """Weighted sum of uncertainty and diversity, each over its maximum."""
    # the maxima and the scores read the same rows; the diversity behind them is dear
    s = checkpointed(pool.select(row_id, uncertainty_score(F.col(probs), strategy).alias("u")).join(diversity, row_id))
    top = s.agg(F.struct(F.max("u").alias("u"), F.max("diversity").alias("d")).alias("m")).scalar()
    s = s.withColumn("__m", top)
    over = lambda c, m: F.when(m > 0, c / m).otherwise(c)
    score = u_weight * over(F.col("u"), F.col("__m.u")) + d_weight * over(F.col("diversity"), F.col("__m.d"))
    return s.select(row_id, score.alias("score")).orderBy(F.desc("score"), row_id).limit(n)


def batch_select(pool: DataFrame, row_id: str, text: str, score: str, batch_size: int, batches: int) -> DataFrame:
    """Successive batches of the highest scores; equal texts leave the pool together.

    Scores do not change between batches, so a row's batch follows from its rank.
    """
    once = first_per_key(pool, [F.md5(F.col(text))], [F.desc(score), row_id])
    r = ranked(once, [F.desc(score), row_id], name="__rank")
    return r.withColumn("batch", F.ceil(F.col("__rank") / batch_size)).where(F.col("batch") <= batches).drop("__rank")


def committee_disagreement(samples: DataFrame, item: str = "item", axis: str = "model") -> DataFrame:
    m = _class_moments(samples, item, axis, F.var_pop).where("members >= 2")
    return m.select(item, V.entropy(F.col("mean_probs")).alias("vote_entropy"))
