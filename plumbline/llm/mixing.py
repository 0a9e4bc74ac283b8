"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a word target (`source_targets`). Its documents are repeated as often as whole copies fit; the rest of
the target is filled by order sampling: a document with inclusion probability p (in proportion to its size) and uniform
draw u has rank u/(1-u) / (p/(1-p)), and the lowest ranks are taken until the words are used up. What the next document
would overshoot is filled, in rank order again, from documents that still fit, `rounds` times.

No source is ever sorted as a whole: sums per rank bucket find the bucket that holds the cut, one or two more levels cut
inside it, and the choice is a comparison of a document's rank with its source's cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, broadcast_if_small, stored
from plumbline.plans.ordering import prefix_sums, ranked

BUCKETS, LEVELS = 512, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(id_col: Column, seed: int) -> Column:
    """Uniform in (0, 1) from the id and the seed alone, so reruns and layouts agree."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, target, copies, gap, slope): words per source, one row each.

    Sources in code point order, null last, get the weights in turn and share all words. A target stops at `max_repeats`
    times its source; the excess goes to the others by weight. With sources sorted by limit / weight, the share per
    weight is the largest of (words left after the first j limits) / (weight left), over all j. `gap` is what whole
    copies leave open, `slope` times a size is its inclusion probability.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double").alias("squares")
    )
    order = ranked(per, [F.col("source").asc_nulls_last()], name="nth")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    order = order.withColumn("weight", F.element_at(turn, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    order = order.withColumn("limit", F.col("source_size") * max_repeats)
    order = stored(order.withColumn("ratio", F.col("limit") / F.col("weight")), "mix-sources")
    run = prefix_sums(order, [F.col("ratio"), F.col("nth")], {"used": F.col("limit"), "spent": F.col("weight")})
    total = order.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    left = run.crossJoin(F.broadcast(total)).select(  # one row of totals
        ((F.col("total") - F.col("used") + F.col("limit")) / (F.col("weights") - F.col("spent") + F.col("weight"))).alias("share")
    )
    share = left.agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"))
    out = order.crossJoin(F.broadcast(share)).withColumn("target", F.least(F.col("share") * F.col("weight"), F.col("limit").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("copies", F.floor(rate).cast("int"))
    out = out.withColumn("gap", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    slope = F.when(F.col("squares") > 0, F.col("gap") / F.col("squares")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", "copies", "gap", slope.alias("slope"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Pareto order-sampling rank; a probability at or above 1 ranks before all others."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-12))
    return (u / (1 - u)) / (p / (1 - p))


def _unit(rank: Column) -> Column:
    """The rank's image in [0, 1)."""
    return F.least(rank / (1 + rank), F.lit(1 - 2.0**-53))


def _cut(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """(sid, cut): the largest rank such that the words of all rows up to it stay within the source's gap.

    rows: (sid, rank, size). Buckets of the rank's unit-interval image; rows of one rank stand or fall together.
    """
    unit = _unit(F.col("rank"))
    at = gaps.select("sid", "gap", F.lit(0.0).alias("base"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    for _ in range(LEVELS):
        inside = rows.join(at, "sid").where((unit >= F.col("low")) & (unit < F.col("low") + F.col("width")))
        slot = F.least(F.floor((unit - F.col("low")) / F.col("width") * BUCKETS), F.lit(BUCKETS - 1))
        sums = inside.groupBy("sid", "gap", "base", "low", "width", slot.alias("slot")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("sid").orderBy("slot")  # at most BUCKETS rows for each source
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(w)).where("upto > gap")
        first = sums.groupBy("sid").agg(F.min_by(F.struct("gap", (F.col("upto") - F.col("words")).alias("base"), (F.col("low") + F.col("slot") * F.col("width") / BUCKETS).alias("low"), (F.col("width") / BUCKETS).alias("width")), "slot").alias("x"))
        at = stored(first.select("sid", "x.*"), "mix-cut")
    inside = rows.join(at, "sid").where((unit >= F.col("low")) & (unit < F.col("low") + F.col("width")))
    ties = inside.groupBy("sid", "gap", "base", "rank").agg(F.sum("size").alias("words"))
    ties = ties.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("sid").orderBy("rank")))
    exact = ties.where("upto <= gap").groupBy("sid").agg(F.max("rank").alias("cut"))
    edge = at.select("sid", F.col("low").alias("edge"))
    found = gaps.select("sid").join(edge, "sid", "left").join(exact, "sid", "left")
    # without an edge the source's rows all fit; without an exact rank everything below the edge does
    return found.select("sid", "edge", "cut")


def _within(unit: Column, rank: Column) -> Column:
    return F.col("edge").isNull() | (unit < F.col("edge")) | F.coalesce(rank <= F.col("cut"), F.lit(False))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: int = 7, rounds: int = 3,
    max_broadcast_sources: int = 100_000,
) -> DataFrame:
    """All columns of `docs` (those named like new ones are replaced) plus size, source_size, target, repeats, taken.

    size: words of the text, 0 for null or empty. repeats: how often the mix takes the document, 0 to max_repeats.
    taken = size * repeats. A null source is a source of its own; rows that repeat an id share its draw and, where sizes
    agree, its fate. An empty table gives no rows; sources without words get target 0.
    """
    new = ["size", "source_size", "target", "repeats", "taken"]
    docs = docs.drop(*[c for c in new if c not in (id_col, text_col, source_col)])
    words = n_words(F.col(text_col))
    sizes = stored(docs.select(F.col(source_col).alias("source"), words.alias("size"), draw(F.col(id_col), seed).alias("u")), "mix-sizes")
    plan = source_targets(sizes, weights, max_repeats)
    plan = stored(plan.withColumn("sid", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "mix-plan")
    rank = pareto_rank(F.col("u"), F.col("slope") * F.col("size"))
    small = broadcast_if_small(plan.select("sid", "slope"), max_broadcast_sources)
    sid = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rows = sizes.where("size > 0").select(sid.alias("sid"), "size", "u").join(small, "sid").select("sid", "size", rank.alias("rank"))
    unit = _unit(F.col("rank"))
    gaps, cuts = plan.select("sid", "gap"), None
    for k in range(rounds):
        fit = rows.join(broadcast_if_small(gaps, max_broadcast_sources), "sid").where("size <= gap")
        cut = stored(_cut(fit.select("sid", "rank", "size"), gaps).join(gaps, "sid"), "mix-round")
        took = fit.drop("gap").join(broadcast_if_small(cut, max_broadcast_sources), "sid").where(_within(unit, F.col("rank")))
        spent = took.groupBy("sid").agg(F.sum("size").alias("spent"))
        mine = cut.select("sid", F.struct("edge", "cut", "gap").alias(f"cut{k}"))
        cuts = mine if cuts is None else cuts.join(mine, "sid")
        rows = rows.join(broadcast_if_small(cut, max_broadcast_sources), "sid").where(~((F.col("size") <= F.col("gap")) & _within(unit, F.col("rank")))).select("sid", "size", "rank")
        gaps = stored(gaps.join(spent, "sid", "left").select("sid", (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("gap")), "mix-gap")
    plan = stored(plan.join(cuts, "sid"), "mix-cuts").select(
        F.col("sid").alias("__sid"), "source_size", "target", F.col("copies").alias("__copies"), F.col("slope").alias("__slope"), *[F.col(f"cut{k}").alias(f"__cut{k}") for k in range(rounds)]
    )
    rank = pareto_rank(draw(F.col(id_col), seed), F.col("__slope") * F.col("size"))
    chosen = F.lit(False)
    for k in range(rounds):
        c = F.col(f"__cut{k}")
        inside = c["edge"].isNull() | (_unit(F.col("__rank")) < c["edge"]) | F.coalesce(F.col("__rank") <= c["cut"], F.lit(False))
        chosen = chosen | ((F.col("size") <= c["gap"]) & inside)
    out = docs.withColumn("size", words).withColumn("__sid", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")))
    out = out.join(broadcast_if_small(plan, max_broadcast_sources), "__sid").withColumn("__rank", rank)
    out = out.withColumn("repeats", F.col("__copies") + ((F.col("size") > 0) & chosen).cast("int"))
    out = out.withColumn("taken", F.col("size") * F.col("repeats"))
    return out.drop("__sid", "__rank", "__copies", "__slope", *[f"__cut{k}" for k in range(rounds)])
