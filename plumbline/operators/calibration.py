"""Uncertainty and calibration over class probabilities. Sample and model axes are rows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.plans.ordering import group_quantiles, ranked


def _class_moments(samples: DataFrame, item: str, axis: str, variance) -> DataFrame:
    """Mean and variance per (item, class) over the axis, gathered back to arrays per item."""
    e = samples.select(item, axis, F.posexplode("probs").alias("k", "p"))
    m = e.groupBy(item, "k").agg(F.avg("p").alias("m"), variance("p").alias("v"), F.count(F.lit(1)).alias("n"))
    cells = F.sort_array(F.collect_list(F.struct("k", "m", "v")))
    g = m.groupBy(item).agg(cells.alias("c"), F.max("n").alias("members"))
    return g.select(
        item, "members", F.transform("c", lambda s: s["m"]).alias("mean_probs"), F.transform("c", lambda s: s["v"]).alias("variances")
    )


def mean_of(v: Column) -> Column:
    return V.total(v) / F.size(v)


def mc_uncertainty(samples: DataFrame, item: str = "item", axis: str = "sample", threshold: float = 0.3, **quantile_args) -> DataFrame:
    """Epistemic (mean population variance), aleatoric (entropy of the mean), total, and the
    2.5/97.5 percentiles of each sample's mean probability."""
    m = _class_moments(samples, item, axis, F.var_pop)
    per = samples.select(item, mean_of(F.col("probs")).alias("sm"))
    ci = group_quantiles(per, [item], "sm", {"ci_low": 0.025, "ci_high": 0.975}, **quantile_args)
    u = m.select(item, mean_of(F.col("variances")).alias("epistemic"), V.entropy(F.col("mean_probs")).alias("aleatoric"))
    u = u.withColumn("total", F.col("epistemic") + F.col("aleatoric"))
    return u.join(ci, item).withColumn("confident", F.col("total") < threshold)


def ensemble_uncertainty(samples: DataFrame, item: str = "item", axis: str = "model") -> DataFrame:
    """The same over models; items seen by one model only are left out."""
    m = _class_moments(samples, item, axis, F.var_pop).where("members >= 2")
    u = m.select(item, "members", mean_of(F.col("variances")).alias("epistemic"), V.entropy(F.col("mean_probs")).alias("aleatoric"))
    return u.withColumn("total", F.col("epistemic") + F.col("aleatoric"))


def predictive_entropy_mi(samples: DataFrame, item: str = "item", axis: str = "sample") -> DataFrame:
    m = _class_moments(samples, item, axis, F.var_samp)
    each = samples.groupBy(item).agg(F.avg(V.entropy(F.col("probs"))).alias("mean_entropy"))
    j = m.join(each, item).withColumn("entropy", V.entropy(F.col("mean_probs")))
    top = F.ln(F.size("mean_probs").cast("double"))
    return j.select(
        item, "entropy", (F.col("entropy") - F.col("mean_entropy")).alias("mutual_information"),
        mean_of(F.col("variances")).alias("variance"), (1 - F.col("entropy") / top).alias("confidence"),
    )


def embedding_disagreement(rows: DataFrame, item: str, axis: str, vec: str) -> DataFrame:
    """Mean per-dimension variance and mean pairwise cosine between models, without forming
    pairs: the cosine mean follows from the length of the summed unit vectors."""
    u = rows.withColumn("__n", V.norm(F.col(vec))).select(item, "__n", F.posexplode(vec).alias("k", "x"))
    d = u.groupBy(item, "k").agg(F.var_pop("x").alias("v"), F.sum(F.col("x") / F.col("__n")).alias("s"), F.count(F.lit(1)).alias("m"))
    g = d.groupBy(item).agg(F.avg("v").alias("variance"), F.sum(F.col("s") * F.col("s")).alias("q"), F.max("m").alias("m"))
    cos = (F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    return g.where("m >= 2").select(item, "variance", cos.alias("mean_similarity"), (1 - cos).alias("disagreement"))


def temperature_scale(logits: Column, temperature: float) -> Column:
    return V.softmax(logits, temperature)


def fit_temperature_grid(rows: DataFrame, logits: str, label: str, low: float = 0.5, high: float = 3.0, steps: int = 50) -> DataFrame:
    """Temperature with the lowest mean negative log likelihood on an even grid.

    One pass: every row adds to `steps` sums, which combine on the map side into one row.
    """
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    z = rows.select(F.col(logits).alias("z"), F.array_max(logits).alias("top"), F.element_at(logits, F.col(label) + 1).alias("own"))
    nll = []
    for t in grid:
        lse = F.ln(V.total(F.transform(F.transform("z", lambda x: x - F.col("top")), _scaled_exp(t))))
        nll.append(F.avg(lse - (F.col("own") - F.col("top")) / t))
    cells = F.array(*[F.struct(c.alias("nll"), F.lit(t).alias("temperature")) for c, t in zip(nll, grid)])
    return z.agg(F.array_min(cells).alias("b")).select("b.temperature", "b.nll")


def _scaled_exp(t: float):
    return lambda x: F.exp(x / F.lit(t))


def bin_of(conf: Column, bins: int) -> Column:
    """0-based bin with edges (i/n, (i+1)/n]; 0 and below fall in no bin."""
    out = None
    for i in range(bins):
        hit = (conf > i / bins) & (conf <= (i + 1) / bins)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def calibration_bins(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Reliability table: per non-empty bin its count, mean confidence, accuracy and gap."""
    r = rows.select(confidence.alias("c"), correct.cast("double").alias("y"))
    b = r.withColumn("bin", bin_of(F.col("c"), bins)).where("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("c").alias("avg_confidence"), F.avg("y").alias("accuracy")
    )
    return b.withColumns(
        {"gap": F.abs(F.col("avg_confidence") - F.col("accuracy")), "center": (F.col("bin") + 0.5) / bins}
    )


def calibration_errors(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """ECE weights each bin by its share of all rows, MCE is the largest gap."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    b = calibration_bins(rows, confidence, correct, bins).withColumn("__n", n)
    return b.agg(F.sum(F.col("count") / F.col("__n") * F.col("gap")).alias("ece"), F.max("gap").alias("mce"))


def conformal_threshold(scores: DataFrame, score: str, row_id: str, alpha: float = 0.1) -> DataFrame:
    """The score at index min(ceil((n+1)(1-alpha)), n) - 1 in descending order; 1-alpha if empty."""
    r = ranked(scores.select(score, row_id), [F.desc(score), row_id], name="rank")
    n = scores.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - alpha)), F.col("n"))
    hit = r.withColumn("n", n).where(F.col("rank") == at)
    return hit.agg(F.coalesce(F.max(score), F.lit(1 - alpha)).alias("threshold"))


def conformal_set(rows: DataFrame, probs: str, threshold: Column) -> DataFrame:
    """Classes by falling probability until their sum reaches the threshold."""
    idx = F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("np"), i.alias("i")))
    d = rows.withColumns({"__t": threshold, "__s": F.sort_array(idx)})
    seed = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"))
    step = lambda a, s: F.when(a["sum"] >= F.col("__t"), a).otherwise(
        F.struct((a["sum"] - s["np"]).alias("sum"), (a["k"] + 1).alias("k"))
    )
    d = d.withColumn("__a", F.aggregate("__s", seed, step))
    chosen = F.transform(F.slice("__s", 1, F.col("__a.k")), lambda s: s["i"])
    return d.withColumns({"prediction_set": chosen, "set_size": F.col("__a.k"), "coverage": F.col("__a.sum")}).drop("__t", "__s", "__a")


