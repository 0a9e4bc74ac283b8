"""Ordered computation without single-task windows.

A `Window.orderBy` without partition keys, or with few and heavy keys, pushes the data
through one task. The plans here spread ordered work over range or hash partitions and only
put per-partition summaries (one row per partition or bucket) through a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.runtime import checkpointed

_POS = "__pos"
_PART = "__part"


def _sorted_positions(df: DataFrame, order: Sequence) -> DataFrame:
    """Range-partition and sort by a total order, then pin the layout with a checkpoint.

    The boundaries are sampled from the whole composite key, so a hot leading value is split
    by the tie-breaking columns. The checkpoint makes the partition numbers reusable.
    """
    s = df.orderBy(*order).withColumn(_POS, F.monotonically_increasing_id())
    return checkpointed(s).withColumn(_PART, F.shiftrightunsigned(_POS, 33))


def ranked(df: DataFrame, order: Sequence, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based rank in a total order, globally or per key; heavy keys span many partitions."""
    s = _sorted_positions(df, [*keys, *order])
    # one row per sort partition: the running total below is over that small table
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        s.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    out = s.join(offsets, _PART).withColumn(
        name, F.col("__off") + F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    )
    if keys:
        starts = out.groupBy(*keys).agg((F.min(name) - 1).alias("__start"))
        out = null_safe_join(out, starts, keys).withColumn(name, F.col(name) - F.col("__start"))
    return out.drop(_POS, _PART, "__off", "__start")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the left side's keys stay."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def prefix_sums(df: DataFrame, order: Sequence, sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums in a total order (per key when keys are given).

    Running sums are built inside each (sort partition, key) and shifted by the totals of the
    partitions before it; a key's totals are one row per partition that key touches.
    """
    s = df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])
    s = _sorted_positions(s, [*keys, *order])
    group = [_PART, *keys]
    inside = Window.partitionBy(*group).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    totals = s.groupBy(*group).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    prior = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    prior = prior.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *group, *[F.coalesce(F.sum(f"__t_{n}").over(prior), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    out = s.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__i_{n}") for n in sums])
    out = null_safe_join(out, shift, group)
    return out.select(*df.columns, *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def rolling_rows(
    df: DataFrame,
    exprs: Mapping[str, Column],
    lookback: int,
    rank: str = "rank",
    keys: Sequence[str] = (),
    block: int = 8192,
) -> DataFrame:
    """Aggregate over the current and the `lookback` preceding rows of a ranked table.

    Ranks are cut into blocks; the last `lookback` rows of a block are copied in front of the
    next one. Every window therefore holds at most block + lookback rows, for any key skew.
    """
    block = max(block, lookback + 1)
    own = F.floor((F.col(rank) - 1) / block)
    is_tail = (F.col(rank) - 1) % block >= block - lookback
    homes = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("__block", F.explode(homes)).withColumn("__halo", F.col("__block") != own)
    w = Window.partitionBy(*keys, "__block").orderBy(rank).rowsBetween(-lookback, 0)
    out = spread.select("*", *[e.over(w).alias(n) for n, e in exprs.items()])
    return out.where(~F.col("__halo")).drop("__block", "__halo")


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence, n: int, salt_on: Sequence[str], name: str | None = None
) -> DataFrame:
    """First n rows of every key. Heavy keys are cut to n rows per salt before they meet.

    Both row_number filters become WindowGroupLimit, which also trims before each shuffle.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    rn = name or "__rn"
    out = (
        df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        .withColumn("__rn0", F.row_number().over(first))
        .where(F.col("__rn0") <= n)
        .drop("__salt", "__rn0")
        .withColumn(rn, F.row_number().over(second))
        .where(F.col(rn) <= n)
    )
    return out if name else out.drop(rn)


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Sequence) -> DataFrame:
    """Keep the first row of each key. The group limit keeps one row per key and map task,
    so a group of copies of any size shrinks before the shuffle."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return (
        df.withColumns(named)
        .withColumn("__rn", F.row_number().over(w))
        .where("__rn = 1")
        .drop("__rn", *named)
    )


def hash_order(ids: Sequence[str], seed: int = 42) -> Column:
    """Layout-independent random order: 32 hex digits from the row id and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def assign_splits(
    df: DataFrame,
    ids: Sequence[str],
    fractions: Sequence[float],
    names: Sequence[str],
    seed: int = 42,
    keys: Sequence[str] = (),
    column: str = "split",
) -> DataFrame:
    """Random split with exact sizes: int(n * fraction) rows each, the rest to the last name.

    The rows are never sorted as a whole. Counts per hash prefix (at most 65536 rows per key)
    locate the prefix that holds each cut; only those prefixes are ranked to find the exact
    threshold hash. The split itself is a comparison with the thresholds.
    """
    h = df.withColumn("__h", hash_order(ids, seed))
    pre = F.substring("__h", 1, 4)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = h.groupBy(*keys, pre.alias("__pre")).agg(F.count(F.lit(1)).alias("__n"))
    run = counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(part.orderBy("__pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("__total", F.sum("__n").over(part))
    pos, cuts = F.lit(0).cast("bigint"), []
    for i, f in enumerate(fractions):
        pos = pos + F.floor(F.col("__total") * F.lit(float(f)))
        cuts.append(F.struct(F.lit(i).alias("cut"), pos.alias("pos")))
    goal = (
        run.withColumn("__c", F.explode(F.array(*cuts)))
        .where((F.col("__c.pos") > F.col("__before")) & (F.col("__c.pos") <= F.col("__before") + F.col("__n")))
        .select(*keys, "__pre", "__c.cut", (F.col("__c.pos") - F.col("__before")).alias("__want"))
    )
    near = null_safe_join(h.select(*keys, pre.alias("__pre"), "__h"), goal, [*keys, "__pre"])
    rn = F.row_number().over(Window.partitionBy(*keys, "__pre", "cut").orderBy("__h"))
    hits = near.withColumn("__rn", rn).where("__rn = __want")
    edges = [F.max(F.when(F.col("cut") == i, F.col("__h"))).alias(f"e{i}") for i in range(len(fractions))]
    if keys:
        h = null_safe_join(h, hits.groupBy(*keys).agg(F.struct(*edges).alias("__e")), list(keys), "left")
    else:
        h = h.withColumn("__e", hits.agg(F.struct(*edges).alias("e")).scalar())
    label = None
    for i, n in enumerate(names[:-1]):
        test = F.col("__h") <= F.col(f"__e.e{i}")
        label = F.when(test, n) if label is None else label.when(test, n)
    return h.withColumn(column, label.otherwise(names[-1])).drop("__h", "__e")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    aggs: Sequence[Column] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key next to other aggregates; a group without values keeps its row, with nulls.

    `linear` interpolates between neighbours and gives doubles, `nearest` takes sorted[min(int(n*p), n-1)] and keeps the
    column's type. Ranks are located through value buckets, so no group has to fit one buffer.
    """
    k = list(keys)
    located = _located_quantiles(df, k, value, probs, method)
    if method != "linear":
        kind = df.schema[value].dataType
        located = located.select(*k, *[F.col(c).cast(kind).alias(c) for c in probs])
    if not k:
        row = F.struct(*[F.col(c) for c in probs]).alias("q")
        every = df.agg(*(aggs or [F.lit(None).alias("__none")]))
        return every.withColumn("__q", located.select(row).scalar()).select("*", "__q.*").drop("__q", "__none")
    groups = df.groupBy(*k).agg(*aggs) if aggs else df.select(*k).distinct()
    return null_safe_join(groups, located, k, "left")


def _located_quantiles(df, keys, value, probs, method, k: int = 2048, margin: float = 0.012, few: int = 10_000) -> DataFrame:
    """Exact quantiles in two passes over the rows.

    A mergeable sketch per group brackets every wanted rank: `margin` is over ten standard errors of a sketch of size `k`.
    The second pass counts the rows between the brackets and keeps only values inside them, so a group shrinks to a few
    hundredths before it is shuffled. A rank that is not inside its bracket ends the job; nothing is ever approximate.
    """
    kk = list(keys) or ["__all"]
    src = df if keys else df.withColumn("__all", F.lit(0))
    src = src.where(F.col(value).isNotNull()).select(*kk, F.col(value).cast("double").alias("__v"))
    number = F.when(~F.isnan("__v"), F.col("__v"))
    sketch = src.groupBy(*kk).agg(F.count(F.lit(1)).alias("__n"), F.count(number).alias("__m"), F.kll_sketch_agg_double(number, k).alias("__s"))
    shares = [p + side * margin for p in probs.values() for side in (-1, 1)]
    whole = [float("-inf"), float("nan")] * len(probs)  # NaN is the largest value, and beyond the sketch
    inner = F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(min(max(float(x), 0.0), 1.0)) for x in shares]))
    ends = [F.lit(w) if not 0 < x < 1 else inner[i] for i, (x, w) in enumerate(zip(shares, whole))]
    # in groups below 10 / margin rows a rank is a large share; all their rows are kept
    small = (F.col("__n") * margin < 10) | (F.col("__n") != F.col("__m"))
    brackets = sketch.select(*kk, F.when(small, F.array(*[F.lit(w) for w in whole])).otherwise(F.array(*ends)).alias("__e"))
    rows = brackets.limit(few + 1).collect()
    if len(rows) <= few:
        brackets = F.broadcast(df.sparkSession.createDataFrame(rows, brackets.schema))
    placed = null_safe_join(src, brackets, kk)
    low, high = ([F.col("__e")[2 * i + side] for i in range(len(probs))] for side in (0, 1))
    code = sum(((F.col("__v") >= a).cast("int") + (F.col("__v") > b).cast("int") for a, b in zip(low, high)), F.lit(0))
    inside = F.lit(False)
    for a, b in zip(low, high):
        inside = inside | ((F.col("__v") >= a) & (F.col("__v") <= b))
    # rows of one code lie on the same side of every edge; those outside all brackets are only counted
    placed = placed.select(*kk, code.alias("__b"), F.when(inside, F.col("__v")).alias("__x"), "__v")
    placed = placed.groupBy(*kk, "__b", "__x").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__v"))
    k, by_key = kk, Window.partitionBy(*kk)
    sizes = (
        placed.groupBy(*k, "__b")
        .agg(F.sum("__c").alias("__n"), F.min("__v").alias("__low"))  # the same columns as below, so the shuffle is reused
        .where("__low is not null")
        .withColumn(
            "__from",
            F.coalesce(
                F.sum("__n").over(by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("__total", F.sum("__n").over(by_key))
    )
    goals = []
    for name, p in probs.items():
        if method == "linear":
            at = (F.col("__total") - 1) * F.lit(float(p))
            lo, frac = F.floor(at), at - F.floor(at)
        else:
            lo = F.least(F.floor(F.col("__total") * F.lit(float(p))), F.col("__total") - 1)
            frac = F.lit(0.0)
        hi = F.least(lo + 1, F.col("__total") - 1)
        for side, pos in (("lo", lo), ("hi", hi)):
            goals.append(
                F.struct(F.lit(name).alias("p"), F.lit(side).alias("side"), pos.alias("pos"), frac.alias("frac"))
            )
    hits = (
        sizes.withColumn("__g", F.explode(F.array(*goals)))
        .where((F.col("__g.pos") >= F.col("__from")) & (F.col("__g.pos") < F.col("__from") + F.col("__n")))
        .select(*k, "__b", "__g.p", "__g.side", "__g.frac", (F.col("__g.pos") - F.col("__from")).alias("__want"))
    )
    inside = Window.partitionBy(*k, "__b", "p", "side").orderBy("__v")
    r = {c: F.col(c).alias(f"__r_{c}") for c in k}
    h2 = hits.select(*r.values(), F.col("__b").alias("__rb"), "p", "side", "frac", "__want")
    cond = placed["__b"] == h2["__rb"]
    for c in k:
        cond = cond & placed[c].eqNullSafe(h2[f"__r_{c}"])
    found = (
        placed.join(h2, cond)
        .withColumn("__cum", F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("__cum") > F.col("__want")) & (F.col("__cum") - F.col("__c") <= F.col("__want")))
    )
    outside = F.raise_error(F.lit("a rank lies outside its sketch's bracket; run the query again")).cast("double")
    found = found.withColumn("__v", F.when(F.col("__x").isNull(), outside).otherwise(F.col("__x")))
    pick = lambda n, s: F.max(F.when((F.col("p") == n) & (F.col("side") == s), F.col("__v")))
    cols = []
    for n in probs:
        frac = F.max(F.when(F.col("p") == n, F.col("frac")))
        cols.append((pick(n, "lo") + (pick(n, "hi") - pick(n, "lo")) * frac).alias(n))
    return found.groupBy(*k).agg(*cols).drop("__all")
