"""Distribution and quality drift: per-dimension statistics, MMD, PSI, KS, retraining decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans.ordering import group_quantiles, prefix_sums, ranked, rolling_rows, top_n_per_group

TINY = 1e-10


def embedding_baseline(rows: DataFrame, vec: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population std per dimension; map tasks reduce to one row per dimension."""
    e = rows.select(*keys, F.posexplode(vec).alias("pos", "x"))
    return e.groupBy(*keys, "pos").agg(
        F.avg("x").alias("mean"), (F.stddev_pop("x") + TINY).alias("std"), F.count(F.lit(1)).alias("n")
    )


def severity(score: Column, high: float, medium: float) -> Column:
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def embedding_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1, min_rows: int = 100) -> DataFrame:
    """Compare two per-dimension tables (dimension count rows each)."""
    b = baseline.select("pos", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    j = current.join(b, "pos")
    r = j.agg(
        F.avg(F.abs((F.col("mean") - F.col("bm")) / F.col("bs"))).alias("mean_drift"),
        F.avg(F.abs(F.ln(F.col("std") / F.col("bs")))).alias("variance_drift"),
        F.max("n").alias("sample_count"),
    ).withColumn("drift_score", 0.7 * F.col("mean_drift") + 0.3 * F.col("variance_drift"))
    return r.select(
        "*", severity(F.col("drift_score"), 0.5, 0.3).alias("severity"),
        ((F.col("drift_score") > threshold) & (F.col("sample_count") >= min_rows)).alias("alert"),
    )


def newest(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def quality_degradation(
    scores: DataFrame, order: Sequence[str], baseline_rows: int = 500, window: int = 500, min_rows: int = 50,
    threshold: float = 0.1, block: int = 8192,
) -> DataFrame:
    """Rolling degradation after every score per adapter, against the mean of its first rows."""
    r = ranked(scores, order, ["adapter"])
    base = r.where(F.col("rank") <= baseline_rows).groupBy("adapter").agg(F.avg("score").alias("baseline"))
    roll = rolling_rows(r, {"current": F.avg("score"), "k": F.count(F.lit(1))}, window - 1, keys=["adapter"], block=block)
    j = roll.join(base, "adapter").withColumn("degradation", F.round(F.col("baseline") - F.col("current"), 9))
    return j.where((F.col("k") >= min_rows) & (F.col("degradation") > threshold)).select(
        *order, "adapter", "baseline", "current", "degradation", severity(F.col("degradation"), 0.3, 0.2).alias("severity")
    )


def adapter_comparison(scores: DataFrame, order: Sequence, row_id: str, last: int = 500) -> DataFrame:
    recent = top_n_per_group(scores, ["adapter"], order, last, [row_id])
    return recent.groupBy("adapter").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"),
        F.max("score").alias("max"), F.count(F.lit(1)).alias("count"),
    )


def drift_summary(alerts: DataFrame) -> DataFrame:
    """Totals, counts by severity and by type in one pass of grouping sets."""
    g = alerts.groupingSets([["severity"], ["drift_type"], []], "severity", "drift_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.grouping_id().alias("gid")
    )
    kind = F.when(F.col("gid") == 1, "severity").when(F.col("gid") == 2, "type").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("severity", "drift_type", F.lit("all")).alias("label"), "alerts")


def mmd_window(rows: DataFrame, order: str, window: int = 100, gamma: float = 1.0, threshold: float = 0.1) -> DataFrame:
    """RBF maximum mean discrepancy between the first and the last `window` rows per adapter.

    Both sides hold at most `window` rows per adapter, which bounds the pairs per adapter.
    """
    first = top_n_per_group(rows, ["adapter"], [order], window, [order]).select("adapter", "v", F.lit("x").alias("side"))
    last = top_n_per_group(rows, ["adapter"], [F.desc(order)], window, [order]).select("adapter", "v", F.lit("y").alias("side"))
    both = first.union(last)
    a = both.select("adapter", F.col("v").alias("va"), F.col("side").alias("sa"))
    b = both.select("adapter", F.col("v").alias("vb"), F.col("side").alias("sb"))
    k = F.exp(-F.lit(gamma) * V.sqdist(F.col("va"), F.col("vb")))
    m = lambda p, q: F.avg(F.when((F.col("sa") == p) & (F.col("sb") == q), F.col("k")))
    j = a.join(b, "adapter").select("adapter", "sa", "sb", k.alias("k")).groupBy("adapter")
    sq = m("x", "x") + m("y", "y") - 2 * m("x", "y")
    return j.agg(F.sqrt(F.greatest(F.lit(0.0), sq)).alias("mmd")).withColumn("drift", F.col("mmd") > threshold)


def mmd_rff(rows: DataFrame, side: Column, dims: int, features: int = 128, gamma: float = 1.0, seed: int = 7) -> DataFrame:
    """MMD of two whole sets through random Fourier features (Rahimi and Recht, 2007).

    One pass: every row becomes `features` cosines, averaged per side with map-side combine.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    w = F.lit(rng.normal(0.0, np.sqrt(2 * gamma), features * dims))
    phase = F.lit(rng.uniform(0, 2 * np.pi, features))
    scale = F.lit(float(np.sqrt(2.0 / features)))
    angle = lambda f: V.dot(F.col("v"), F.slice(w, f * dims + 1, F.lit(dims))) + F.element_at(phase, f + 1)
    z = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.cos(angle(f)) * scale)
    e = rows.select(side.alias("side"), F.posexplode(z).alias("pos", "z"))
    m = e.groupBy("pos").agg(
        F.avg(F.when(F.col("side"), F.col("z"))).alias("a"), F.avg(F.when(~F.col("side"), F.col("z"))).alias("b")
    )
    return m.agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2)))).alias("mmd"), F.count(F.lit(1)).alias("features"))


def reference_window(scores: DataFrame, order: str, row_id: str, window: int = 100) -> DataFrame:
    """Quality of the first full window against the last one, per adapter."""
    first = top_n_per_group(scores, ["adapter"], [order], window, [row_id])
    last = top_n_per_group(scores, ["adapter"], [F.desc(order)], window, [row_id])
    f = first.groupBy("adapter").agg(F.avg("score").alias("reference_quality"), F.count(F.lit(1)).alias("n"))
    c = last.groupBy("adapter").agg(F.avg("score").alias("current_quality"))
    change = F.col("current_quality") - F.col("reference_quality")
    return f.join(c, "adapter").where(F.col("n") >= window).select(
        "adapter", "reference_quality", "current_quality", change.alias("quality_change"),
        ((change < -0.1) & (F.col("n") > 10)).alias("quality_drift"),
    )


def psi(rows: DataFrame, is_reference: str, value: str, bins: int = 10, floor: float = 1e-4, **quantile_args) -> DataFrame:
    """Population stability index on reference-quantile bins."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    edges = group_quantiles(rows.where(F.col(is_reference)), [], value, probs, **quantile_args)
    e = edges.select(F.array(*probs).alias("e")).scalar()
    placed = rows.select(is_reference, F.col(value).alias("__v")).withColumn("__e", e)
    binned = placed.select(is_reference, F.size(F.filter("__e", lambda x: x < F.col("__v"))).alias("bin"))
    n = binned.groupBy("bin").agg(F.count_if(is_reference).alias("r"), F.count_if(~F.col(is_reference)).alias("c"))
    tot = binned.agg(F.struct(F.count_if(is_reference).alias("r"), F.count_if(~F.col(is_reference)).alias("c")).alias("t"))
    s = n.withColumn("t", tot.scalar())
    r = F.greatest(F.col("r") / F.col("t.r"), F.lit(floor))
    c = F.greatest(F.col("c") / F.col("t.c"), F.lit(floor))
    return s.agg(F.sum((c - r) * F.ln(c / r)).alias("psi")).withColumn("drift", F.col("psi") > 0.2)


def ks_two_sample(rows: DataFrame, is_first: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with the asymptotic p-value.

    Counts are collapsed per value before anything is ordered; running counts then go through
    range partitions instead of one global window.
    """
    v = rows.groupBy(F.col(value).alias("__v")).agg(F.count_if(is_first).alias("a"), F.count_if(~F.col(is_first)).alias("b"))
    cum = prefix_sums(v, ["__v"], {"ca": F.col("a"), "cb": F.col("b")})
    tot = rows.agg(F.struct(F.count_if(is_first).alias("na"), F.count_if(~F.col(is_first)).alias("nb")).alias("t"))
    cum = cum.withColumn("t", tot.scalar())
    na, nb = F.first("t.na"), F.first("t.nb")
    s = cum.agg(F.max(F.abs(F.col("ca") / F.col("t.na") - F.col("cb") / F.col("t.nb"))).alias("statistic"), na.alias("na"), nb.alias("nb"))
    ne = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    s = s.withColumn("lam", (ne + 0.12 + 0.11 / ne) * F.col("statistic"))
    term = lambda j: F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * F.col("lam") * F.col("lam") * j * j)
    p = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + term(j))
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return s.select("statistic", p.alias("p_value"), (p < alpha).alias("drift"))


def retrain_decision(
    quality: DataFrame, drift: DataFrame, hours_since: Column, new_rows: Column,
    min_quality: float = 0.7, max_psi: float = 0.2, min_rows: int = 1000, cooldown: float = 24.0,
) -> DataFrame:
    """First applicable reason: cooldown, quality, drift, volume. Worst adapter speaks for each."""
    q = quality.where(F.col("quality") < min_quality).agg(F.min_by(F.struct("adapter", "quality"), F.struct("quality", "adapter")).alias("w"))
    p = drift.where(F.col("psi") > max_psi).agg(F.max_by(F.struct("adapter", "psi"), F.struct("psi", "adapter")).alias("w"))
    one = quality.agg(hours_since.alias("h"), new_rows.alias("n")).select("h", "n", q.scalar().alias("q"), p.scalar().alias("p"))
    reason = (
        F.when(F.col("h") < cooldown, F.format_string("Cooldown active (%.1fh remaining)", F.lit(cooldown) - F.col("h")))
        .when(F.col("q").isNotNull(), F.format_string(f"Quality degraded for %s: %.2f < {min_quality}", F.col("q.adapter"), F.col("q.quality")))
        .when(F.col("p").isNotNull(), F.format_string(f"Drift detected for %s: PSI=%.3f > {max_psi}", F.col("p.adapter"), F.col("p.psi")))
        .when(F.col("n") >= min_rows, F.format_string(f"Sufficient new samples: %d >= {min_rows}", F.col("n")))
        .otherwise("No retrain conditions met")
    )
    go = ~(F.coalesce(F.col("h") < cooldown, F.lit(False))) & (F.col("q").isNotNull() | F.col("p").isNotNull() | (F.col("n") >= min_rows))
    return one.select(go.alias("retrain"), reason.alias("reason"))


