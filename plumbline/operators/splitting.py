"""Deterministic splits, sampling, balancing and ordering of training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keyed import pick
from plumbline.plans.ordering import assign_splits, hash_order, null_safe_join, ranked, top_n_per_group

# Difficulty order; unknown counts as medium.
DIFFICULTY = {"easy": 0, "medium": 1, "hard": 2}


def split_train_val(df: DataFrame, row_id: str, validation: float = 0.1, seed: int = 42) -> DataFrame:
    return assign_splits(df, [row_id], [1 - validation], ["train", "validation"], seed)


def split_three_way(
    df: DataFrame, row_id: str, train: float = 0.8, val: float = 0.1, seed: int = 42, keys: Sequence[str] = ()
) -> DataFrame:
    return assign_splits(df, [row_id], [train, val], ["train", "validation", "test"], seed, keys)


def sample_per_group(df: DataFrame, group: str, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """At most k random rows per group: those with the smallest keyed hash."""
    h = df.withColumn("__h", hash_order([row_id], seed))
    return top_n_per_group(h, [group], ["__h"], k, [row_id]).drop("__h")


def balance_dataset(df: DataFrame, group: str, row_id: str, target: int | None = None, seed: int = 42, spread: int = 10000) -> DataFrame:
    """Exactly `target` rows per group (default: the smallest group). Larger groups keep their first
    rows, smaller ones keep all and repeat random rows; `draw` numbers the repeats from 1.

    Draws are produced in two steps of bounded width and spread over tasks in between, so a
    large deficit of one group is not generated by one task.
    """
    r = ranked(df, [row_id], [group], name="__rank")
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    goal = F.lit(target) if target is not None else counts.agg(F.min("__n")).scalar()
    sized = counts.withColumn("__goal", goal)
    kept = null_safe_join(r, sized, [group]).where(F.col("__rank") <= F.col("__goal"))
    need = sized.where("__n < __goal").withColumn("__need", F.col("__goal") - F.col("__n"))
    outer = need.withColumn("__o", F.explode(F.sequence(F.lit(0), F.floor((F.col("__need") - 1) / spread))))
    outer = outer.repartition(F.col(group), F.col("__o"))
    inner = F.least(F.lit(spread), F.col("__need") - F.col("__o") * spread)
    draws = outer.withColumn("__i", F.explode(F.sequence(F.lit(1), inner))).select(
        group, "__n", (F.col("__o") * spread + F.col("__i")).alias("draw")
    )
    draws = draws.withColumn("__rank", (pick(F.col(group), "balance", F.col("__n"), F.col("draw"), seed) + 1).cast("bigint"))
    extra = draws.select(group, "__rank", "draw")
    extra = null_safe_join(extra, r, [group, "__rank"])
    cols = df.columns
    return kept.select(*cols, F.lit(0).cast("bigint").alias("draw")).unionByName(extra.select(*cols, F.col("draw").cast("bigint")))


def fan_out_by_config(df: DataFrame, row_id: str, config: Mapping[str, tuple[Column, float, float]], seed: int = 42) -> DataFrame:
    """Send rows to every target whose filter they pass, each with its own split ratios."""
    targets = F.array_compact(F.array(*[F.when(cond, F.lit(t)) for t, (cond, _, _) in config.items()]))
    fanned = df.withColumn("target", F.explode(targets))
    out = None
    by_ratio: dict[tuple[float, float], list[str]] = {}
    for t, (_, tr, va) in config.items():
        by_ratio.setdefault((tr, va), []).append(t)
    for (tr, va), names in by_ratio.items():
        part = split_three_way(fanned.where(F.col("target").isin(names)), row_id, tr, va, seed, ["target"])
        out = part if out is None else out.unionByName(part)
    return out


def difficulty_rank(c: Column) -> Column:
    out = F.lit(DIFFICULTY["medium"])
    for name, v in DIFFICULTY.items():
        out = F.when(c == name, v).otherwise(out)
    return out


def curriculum_order(df: DataFrame, level: str, row_id: str) -> DataFrame:
    """Position in the order easy, medium, hard, then row id."""
    d = df.withColumn("__d", difficulty_rank(F.col(level)))
    return ranked(d, ["__d", row_id], name="position").drop("__d")


def train_fraction(df: DataFrame, row_id: str, percents: Sequence[int] = (10, 25, 50, 75, 100), seed: int = 42) -> DataFrame:
    """The smallest share each row belongs to; shares are nested."""
    r = ranked(df.withColumn("__h", hash_order([row_id], seed)), ["__h"], name="__rank").drop("__h")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    r = r.withColumn("__total", total)
    out = None
    for p in percents:
        inside = F.col("__rank") <= F.floor(F.col("__total") * p / 100)
        out = F.when(inside, p) if out is None else out.when(inside, p)
    return r.withColumn("fraction", out.cast("bigint")).drop("__rank", "__total")


def self_paced_subset(df: DataFrame, loss: str, row_id: str, round_no: int, start: float = 0.3, step: float = 0.1) -> DataFrame:
    r = ranked(df, [loss, row_id], name="__rank")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = min(1.0, start + step * round_no)
    return r.withColumn("__n", n).where(F.col("__rank") <= F.floor(F.col("__n") * F.lit(share))).drop("__rank", "__n")


def dataset_stats(df: DataFrame, source: Column) -> DataFrame:
    n = F.length(F.coalesce("instruction", F.lit("")))
    return df.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("count"), F.avg(n).alias("avg_instruction_length")).withColumn(
        "fields", F.lit(",".join(df.columns))
    )
