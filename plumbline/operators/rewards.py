"""Rewards, returns and advantages; buffer statistics; weighted parameter merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.plans.folds import affine_reverse_scan
from plumbline.plans.ordering import ranked, rolling_rows

# Phrases that mark a failed response.
FAILED = ["i cannot", "sorry", "i'm unable", "as an ai"]


def shaped_reward(quality: Column, latency_ms: Column, cost: Column, entropy: Column, target_ms: float = 500.0) -> Column:
    late = -F.greatest(F.lit(0.0), latency_ms / target_ms - 1.0)
    return 0.5 * quality + 0.2 * late + 0.1 * (-cost) + 0.2 * (-0.5 * entropy)


def normalized_reward(rows: DataFrame, order: Sequence[str], reward: str, keys: Sequence[str] = (), window: int = 100, block: int = 8192) -> DataFrame:
    """Raw for the first `window` rows of a run, then z-score over the last `window` rows."""
    r = ranked(rows, order, keys, name="__rank")
    r = rolling_rows(r, {"__m": F.avg(reward), "__s": F.stddev_pop(reward)}, window - 1, "__rank", keys, block)
    z = (F.col(reward) - F.col("__m")) / (F.col("__s") + 1e-8)
    return r.withColumn("normalized", F.when(F.col("__rank") > window, z).otherwise(F.col(reward))).drop("__rank", "__m", "__s")


def response_reward(query: Column, response: Column) -> Column:
    n = F.length(response)
    overlap = X.word_overlap(query, response) / F.greatest(F.size(X.word_set(query)), F.lit(1))
    good = 0.6 * F.least(F.lit(1.0), n / 500) + 0.4 * F.least(overlap, F.lit(1.0))
    return F.when(n < 50, 0.0).when(X.any_phrase(F.lower(response), FAILED), 0.2).otherwise(good)


def discounted_returns(rows: DataFrame, keys: Sequence[str], step: str, reward: str, gamma: float = 0.99) -> DataFrame:
    """R(t) = r(t) + gamma R(t+1) per episode, standardised with the sample std.

    Steps are dense from 0. An episode is scanned in blocks, so its length is not bounded by a task.
    """
    d = rows.withColumns({"__a": F.col(reward).cast("double"), "__b": F.lit(float(gamma))})
    d = affine_reverse_scan(d, keys, step, "__a", "__b", "return").drop("__a", "__b")
    s = d.groupBy(*keys).agg(F.avg("return").alias("__m"), F.stddev_samp("return").alias("__s"), F.count(F.lit(1)).alias("__n"))
    z = (F.col("return") - F.col("__m")) / (F.col("__s") + 1e-8)
    return d.join(s, list(keys)).withColumn("normalized", F.when(F.col("__n") > 1, z).otherwise(F.col("return"))).drop("__m", "__s", "__n")


def gae(
    rows: DataFrame, keys: Sequence[str], step: str, reward: str, value: str, done: str, next_value: str,
    gamma: float = 0.99, lam: float = 0.95,
) -> DataFrame:
    """Generalised advantage: delta(t) + gamma*lam*A(t+1), restarted where an episode is done.

    The value after a step comes from an equi-join on step - 1; the last step uses `next_value`.
    """
    nxt = rows.select(*keys, (F.col(step) - 1).alias(step), F.col(value).alias("__nv"))
    d = rows.join(nxt, [*keys, step], "left").withColumn("__nv", F.coalesce("__nv", next_value))
    delta = F.col(reward) - F.col(value) + F.when(F.col(done), 0.0).otherwise(gamma * F.col("__nv"))
    d = d.withColumns({"__a": delta.cast("double"), "__b": F.when(F.col(done), 0.0).otherwise(gamma * lam)})
    d = affine_reverse_scan(d, keys, step, "__a", "__b", "advantage").drop("__a", "__b", "__nv")
    return d.withColumn("return", F.col("advantage") + F.col(value))


def experience_stats(rows: DataFrame, order: Sequence, reward: str, capacity: int = 10000) -> DataFrame:
    """Totals and counts per adapter over the newest `capacity` rows (grouping sets)."""
    b = rows.orderBy(*order).limit(capacity)
    g = b.groupingSets([["adapter"], []], "adapter").agg(
        F.count(F.lit(1)).alias("size"), F.avg(reward).alias("mean_reward"), F.stddev_pop(reward).alias("std_reward")
    )
    return g.withColumn("adapter", F.coalesce("adapter", F.lit("all")))


def weighted_vector_merge(params: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Normalised-weight sum of parameter vectors (adapter, key, values) per key and position."""
    total = sum(weights.values())
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col("adapter") == name, F.lit(x / total)).otherwise(w)
    e = params.select("key", w.alias("w"), F.posexplode("values").alias("pos", "x")).where("w <> 0")
    return e.groupBy("key", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("value"))
