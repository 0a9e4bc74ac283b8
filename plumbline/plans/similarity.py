"""Exact set-similarity and distance joins that avoid cross joins and hot groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions import vectors as V
from plumbline.plans.graphs import connected_components
from plumbline.plans.ordering import first_per_key
from plumbline.plans.runtime import checkpointed, stored

SMALL_BUCKET = 64
FIRST_BLOCK, BLOCK_GROWTH = 4, 4  # undecided rows of a crowded place that others are compared with in round one; growth per round
SKETCH, BAND, PART = 512, 1.5, 2048  # bits of a sketch; largest by smallest size of a band; rows of a numpy step
LEAST_BLOCKED = 0.7  # below this threshold blocks are too small to tell sets apart
STAR_ROUNDS, ENOUGH = 8, 16  # rounds of one partner a row; a round that links fewer than one row in so many is the last
WIDE, LARGE = 4096, 1024  # bits of the second sketch that sets of at least so many tokens have, as they fill up the first
ASKED_BITS = 1 << 24  # bits of the map of asked sets that goes to all tasks
MEETING = 2048  # rows of a crowded place that meet under one join key


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


def similar_leaders(df: DataFrame, row_id: str, tokens: str, threshold: float) -> DataFrame:
    """(row_id, leader): the earliest kept row whose token set is more similar than `threshold`.

    A row is kept (its own leader) when no earlier kept row is that similar: the sequential
    keep-first rule, computed exactly. Identical sets are merged first. Two sets can only
    reach the threshold if they agree on a whole block of tokens (see `_profiles`; for low thresholds: on a token
    among their rarest ones), so rows meet there. Places with few rows yield pairs directly, a bounded number per row;
    at crowded ones rows are compared with the first few undecided rows, four times as many each
    round: a large group of near copies collapses in linear work, and k unlike rows at one place
    take log k rounds. `leader` is the earliest kept row among those compared.
    """
    signed, reps, sized = _places(df.select(F.col(row_id).alias("id"), F.col(tokens).alias("t")), threshold)
    owner = signed.groupBy("sig").agg(F.min("id").alias("rep"))
    small = sized.where(F.col("k") <= SMALL_BUCKET).select("id", "tok")
    hot = sized.where(F.col("k") > SMALL_BUCKET).select("id", "tok")
    pairs = (
        small.alias("a")
        .join(small.alias("b"), (F.col("a.tok") == F.col("b.tok")) & (F.col("a.id") < F.col("b.id")))
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )
    edges = checkpointed(_verified(pairs, reps, signed, threshold))
    todo = checkpointed(reps.select("id"))
    found, block = [], FIRST_BLOCK
    while not todo.isEmpty():
        queue = hot.join(todo, "id", "left_semi")
        place = F.row_number().over(Window.partitionBy("tok").orderBy("id"))
        heads = checkpointed(queue.withColumn("place", place).where(F.col("place") <= block).select("tok", "id"))
        waiting = checkpointed(queue.join(heads, ["tok", "id"], "left_anti").select("id").distinct())
        faced = queue.join(heads.select("tok", F.col("id").alias("head")), "tok").where("head < id")
        pairs = faced.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
        live = edges.join(todo.withColumnRenamed("id", "a"), "a", "left_semi").join(todo.withColumnRenamed("id", "b"), "b", "left_semi")
        edges = checkpointed(live.select("a", "b").union(_verified(pairs, reps, signed, threshold)).distinct())
        kept, gone = _keep_first(todo, edges, waiting)
        leaders = edges.join(kept.withColumnRenamed("id", "a"), "a", "left_semi")
        leaders = leaders.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
        found += [kept.select("id", F.col("id").alias("leader")), checkpointed(leaders)]
        todo = checkpointed(todo.join(kept, "id", "left_anti").join(gone, "id", "left_anti"))
        block *= BLOCK_GROWTH
    lead = None
    for f in found:
        lead = f if lead is None else lead.union(f)
    of_rep = signed.join(owner, "sig").select("id", "rep")
    if lead is None:
        out = of_rep.withColumn("leader", F.col("rep"))
    else:
        out = of_rep.join(lead.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
            "leader", F.coalesce("leader", "rep")
        )
    return out.select(F.col("id").alias(row_id), "leader")


def similar_links(df: DataFrame, row_id: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b): rows whose token sets are more similar than `threshold` (below 1), enough of these links to connect
    whatever all such pairs connect, kept rows or not.

    Empty sets are like nothing, rows without an id take no part, and rows of one id are one node. Identical sets are linked to their
    first row. Others meet at the places of `similar_leaders`. In rounds, a row is compared with one row of another
    component, the head it meets at most places, so a group of near copies falls together in linear work. What is still apart
    is compared pair by pair wherever it meets, sizes and sketches first, so no pair above the threshold is missed.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(tokens).alias("t")).where(F.col("id").isNotNull())
    signed, reps, sized = _places(base, threshold)
    some = signed.where(F.size("t") > 0).select("id", "sig")
    first = some.groupBy("sig").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("sig", "rep")
    links = some.join(first, "sig").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    rows = _open_places(sized.select("tok", "id", F.col("id").alias("comp")), 0)
    for turn in range(1, STAR_ROUNDS + 1):
        met = rows.where("comp <> of").groupBy("id", "head").agg(F.count(F.lit(1)).alias("c"), F.max("comp").alias("comp"), F.max("of").alias("of"))
        most = F.shiftleft("c", 32) + F.shiftrightunsigned(F.xxhash64("head", F.lit(turn - 1)), 32)
        star = met.groupBy("id").agg(*[F.max_by(c, most).alias(c) for c in ("head", "comp", "of")])
        star = stored(star, "set-star")
        found = stored(_verified(star.select(F.col("id").alias("a"), F.col("head").alias("b")), reps, signed, threshold), "set-links")
        links = links.union(found)
        asked, linked = star.count(), found.select("a").distinct().count()
        if linked:
            ends = found.select(F.col("a").alias("id")).join(star, "id").select("comp", "of")
            label = connected_components(ends, "comp", "of").select(F.col("node").alias("comp"), "component")
            rows = rows.join(label, "comp", "left").select("tok", "id", F.coalesce("component", "comp").alias("comp"))
            rows = _open_places(rows, turn)
        if linked * ENOUGH <= asked:
            break
    return links.union(stored(_verified(_apart_pairs(rows, reps, threshold), reps, signed, threshold), "set-links"))


def _open_places(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (tok, id, comp) of the places that more than one component meets at, with a head of the place, its component `of`, and
    the number `k` of rows there. The head is the same at all places that the same rows share."""
    by = F.xxhash64("id", F.lit(turn))
    head = [F.max_by("id", by).alias("head"), F.max_by("comp", by).alias("of"), F.count(F.lit(1)).alias("k")]
    place = rows.groupBy("tok").agg(*head, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return stored(rows.join(place.drop("low", "high"), "tok"), "set-open")


def _apart_pairs(rows: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet and whose sizes and sketches allow a similarity above the threshold.

    A crowded place is cut into blocks of about `MEETING` rows and its pairs of blocks are spread over tasks.
    """
    lanes = [f"f{i}" for i in range(SKETCH // 64)]
    blocks = F.ceil(F.col("k") / MEETING)
    sets = reps.select("id", "n", *[F.coalesce(F.get("sketch", F.lit(i)), F.lit(0)).alias(f) for i, f in enumerate(lanes)])
    own = F.pmod(F.xxhash64("id"), blocks)
    full = stored(rows.select("tok", "id", "comp", own.alias("own"), blocks.alias("blocks")).join(sets, "id"), "set-apart")
    spans = {"x": (F.col("own"), F.explode(F.sequence("own", F.col("blocks") - 1))), "y": (F.explode(F.sequence(F.lit(0).cast("bigint"), "own")), F.col("own"))}
    sides = [
        full.select("tok", lo.alias("lo"), hi.alias("hi"), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "n", *lanes)])
        for s, (lo, hi) in spans.items()
    ]
    fits = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * F.lit(threshold) - 1e-9
    apart = sum((F.bit_count(F.col(f"{f}_x").bitwiseXOR(F.col(f"{f}_y"))) for f in lanes), F.lit(0))
    near = fits & (apart <= _most_apart(F.col("n_x") + F.col("n_y"), threshold))
    once = (F.col("lo") < F.col("hi")) | (F.col("id_x") < F.col("id_y"))
    met = sides[0].join(sides[1], ["tok", "lo", "hi"]).where(once & (F.col("comp_x") != F.col("comp_y")) & near)
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _places(base: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with the digest `sig` of their set, profiles of distinct sets that are not empty, places (tok, id, k) where k > 1 of these meet)."""
    # the sets are read several times later on, the text they come from only here
    signed = stored(base.withColumn("sig", F.md5(F.array_join(F.sort_array("t"), "\u0001"))), "sets")
    hashed = signed.select("id", "sig", F.size("t").alias("n"), F.transform("t", lambda w: F.xxhash64(w)).alias("h")).where("n > 0")
    # only small profiles move from here on; tokens follow for the pairs that a sketch can't tell apart
    reps = stored(first_per_key(_profiles(hashed, threshold), [F.col("sig")], ["id"]), "set-profiles")
    posts = _prefix_posts(hashed, reps, threshold) if threshold < LEAST_BLOCKED else reps.select("id", F.explode("blocks").alias("tok"))
    size = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return signed, reps, stored(posts.join(size, "tok"), "set-posts")


def _keep_first(todo: DataFrame, edges: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) ids that the links (a < b) known so far decide.

    The lexicographically first independent set in parallel steps: a row is kept once none of its earlier partners is
    undecided, and dropped once one of them is kept. A row in `waiting` has not met all earlier rows and can only be dropped.
    """
    left, live = todo, edges
    kept, gone = todo.limit(0), todo.limit(0)
    while True:
        free = left.join(waiting, "id", "left_anti").join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        free = checkpointed(free)
        if free.isEmpty():
            return kept, gone
        out = checkpointed(live.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        kept, gone = kept.union(free), gone.union(out)
        left = checkpointed(left.join(free, "id", "left_anti").join(out, "id", "left_anti"))
        live = live.join(left.withColumnRenamed("id", "a"), "a", "left_semi")
        live = checkpointed(live.join(left.withColumnRenamed("id", "b"), "b", "left_semi"))


def _most_apart(size_sum, threshold: float):
    """Largest symmetric difference of two sets of this size in sum with a similarity above the threshold."""
    return size_sum * ((1 - threshold) / (1 + threshold)) + 1e-9


def _profiles(hashed: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, sig, n, h) to (id, sig, n, sketch, wide, blocks): parity sketches of `SKETCH` and (large sets, else none) `WIDE` bits, block sums.

    Sets above the threshold differ in at most k tokens. Tokens are dealt by hash over k + 1 blocks, so one block at
    least holds the same tokens in both; each block's sum of hashes is a place to meet. k depends on the size, so blocks
    belong to size bands, and a set that has partners in the next band enters it as a guest. Empty blocks count.
    """
    ratio = max(BAND, 1.0 / threshold if threshold > 0 else 2.0)
    fields = [f for f in hashed.schema.fields if f.name in ("id", "sig", "n")]
    more = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("sketch", "wide", "blocks")]

    def mix(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def parity(own: np.ndarray, x: np.ndarray, count: int, bits: int) -> np.ndarray:
        odd = np.bincount(own * bits + (x & np.uint64(bits - 1)).astype(np.int64), minlength=count * bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)

    def profile(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column("h")
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, count = np.repeat(np.arange(len(n)), n), len(n)
        x = mix(h, 5)
        sketch = parity(rows, x, count, SKETCH)
        large, at, wide = np.flatnonzero(n >= LARGE), np.full(count, -1), [np.zeros(0, np.int64)]
        at[large] = np.arange(len(large))
        for i in range(0, len(large), CHUNK):
            few = large[i : i + CHUNK]
            span = slice(*np.searchsorted(rows, [few[0], few[-1] + 1]))
            pick = at[rows[span]] >= 0
            wide.append(parity(at[rows[span]][pick] - i, x[span][pick], len(few), WIDE))
        filled = np.concatenate(([0], np.cumsum(np.where(n >= LARGE, WIDE // 64, 0))))
        band = np.floor(np.log(n) / np.log(ratio) + 1e-9).astype(np.int64)
        owners, sums = [], []
        for guest in (0, 1) if threshold >= LEAST_BLOCKED else ():
            b = band + guest
            high = np.ceil(ratio ** (b + 1.0) + 1e-6)  # a bound on the sizes of the band
            k = np.floor(_most_apart(2 * high, threshold)).astype(np.int64)
            use = (n > threshold * ratio ** b.astype(float) * (1 - 1e-6)) if guest else np.ones(count, bool)
            m = np.where(use & (_most_apart(n + n / threshold, threshold) >= 1), k + 1, 0)  # sets too small to differ at all meet nobody
            start = np.cumsum(m) - m
            pick = m[rows] > 0
            at, x = rows[pick], h[pick]
            total = np.zeros(int(m.sum()), np.uint64)
            block = (mix(x, 3) >> np.uint64(33)).astype(np.int64) % m[at]
            np.add.at(total, start[at] + block, mix(x, 7))
            own = np.repeat(np.arange(count), m)
            place = (np.arange(len(total)) - start[own]) + (b[own] << 32)
            owners.append(own)
            sums.append(mix(total + mix(place.astype(np.uint64), 11), 13))
        own, tok = (np.concatenate(owners), np.concatenate(sums)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.argsort(own, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=count))))
        cells = [
            pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * (SKETCH // 64), pa.int32()), pa.array(sketch)),
            pa.ListArray.from_arrays(pa.array(filled, pa.int32()), pa.array(np.concatenate(wide))),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tok[order].view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], *cells], names=[*[f.name for f in fields], *[f.name for f in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                yield profile(batch.slice(i, PART))

    return hashed.mapInArrow(run, T.StructType([*fields, *more]))


def _prefix_posts(hashed: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(id, tok): the rarest tokens per set, by 64-bit hash; for low thresholds, where blocks would hold hardly a token."""
    tok = hashed.join(reps.select("id", "sig"), ["id", "sig"], "left_semi").dropDuplicates(["id", "sig"]).select("id", "n", F.explode("h").alias("tok"))
    freq = tok.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    # one spare place (the + 2) covers two tokens of a row sharing a hash
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 2
    rare = (
        tok.join(freq, "tok")
        .where("f > 1")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("o"), F.count(F.lit(1)).alias("shared"))
        # tokens of one row only sort first and take up prefix places without any partner
        .withColumn("left", keep - (F.col("n") - F.col("shared")))
        .where("left > 0")
    )
    return rare.select("id", F.explode(F.slice("o", F.lit(1), F.col("left").cast("int"))).alias("o")).select("id", "o.tok")


def _verified(pairs: DataFrame, reps: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct pairs (a < b) above the threshold: sizes and sketches first, then the tokens."""
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"), F.col("wide").alias(f"w{c}")), c)
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9
    apart = sum((F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH // 64)), F.lit(0))
    most = _most_apart(F.col("na") + F.col("nb"), threshold)
    far = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    tell = (F.size("wa") > 0) & (F.size("wb") > 0)
    fits = fits & (apart <= most) & F.when(tell, far <= most).otherwise(True)
    near = stored(pairs.where(fits).select("a", "b", "sa", "sb"), "set-pairs")
    asked = near.select(F.col("sa").alias("sig")).union(near.select("sb")).distinct()
    # a bounded map of bits tells most sets that no pair asks for before any tokens move; the join that follows is exact (an inner one,
    # since a semi join would be pushed below the map)
    bit = F.pmod(F.xxhash64("sig"), F.lit(ASKED_BITS))
    asked_map = asked.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    some = signed.select("sig", "t", F.shiftright(bit, 6).alias("word"), bit.alias("bit")).join(F.broadcast(asked_map), "word")
    some = some.where(F.expr("shiftright(bits, int(bit & 63)) & 1L") == 1)
    sets = some.select("sig", "t").join(asked, "sig").groupBy("sig").agg(F.first("t").alias("t"))
    left = sets.select(F.col("sig").alias("sa"), F.col("t").alias("ta"))
    right = sets.select(F.col("sig").alias("sb"), F.col("t").alias("tb"))
    both = near.join(left, "sa").join(right, "sb")
    return both.where(jaccard(F.col("ta"), F.col("tb")) > F.lit(threshold)).select("a", "b")


# --- distance joins

BLOCK = 8192
CHUNK = 256  # rows of a block whose distances are held at once
MAX_PIVOTS = 256


def _matrix(col) -> np.ndarray:
    return np.array(col.tolist(), dtype="float64")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise distances without the cancellation of the matrix form."""
    return np.sqrt(((x - y) ** 2).sum(1))


def _pivots(pts: DataFrame) -> np.ndarray:
    """A bounded, layout-independent choice of rows: the smallest id hashes."""
    n = pts.count()
    k = max(1, min(MAX_PIVOTS, n, 4 + n // 256))
    chosen = pts.orderBy(F.md5(F.col("id").cast("string")), "id").limit(k).collect()
    return np.array([r["v"] for r in chosen], dtype="float64")


def _in_cells(pts: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Cell (nearest pivot), distance to it, and distance to the nearest pivot that is another point."""

    @F.pandas_udf(T._parse_datatype_string("cell int, d double, ub double"))
    def assign(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), pivots)
        cell = d.argmin(1)
        other = np.where(d <= 1e-6, np.inf, d).min(1) if len(d) else np.zeros(0)
        return pd.DataFrame({"cell": cell.astype("int32"), "d": d[np.arange(len(d)), cell], "ub": other})

    return pts.withColumn("__c", assign("v")).select(*pts.columns, "__c.cell", "__c.d", "__c.ub")


def _block_join(placed: DataFrame, queries: DataFrame, pivots: np.ndarray, kernel, schema: str, block: int = BLOCK) -> DataFrame:
    """Bring each query row (id, v, reach) together with every member it can have within reach.

    Members lie in the cell of their nearest pivot. A cell is visited only if its pivot is at
    most reach + cell radius away (triangle inequality). Small cells are packed into bins of up to
    `block` members, so that a query goes out once per bin and not once per cell; large cells are cut into blocks of about
    `block` members, and the visits of a bin into groups of about `block` rows, so both sides of a
    task stay bounded however many rows share a cell. Pairs live only inside a numpy block. Columns beyond those named
    go along, as q<name> and m<name>.
    """
    shape = placed.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # one row per pivot
    radius = np.full(len(pivots), -np.inf)
    bins, held = np.zeros(len(pivots), dtype="int32"), [0]
    for row in sorted(shape, key=lambda r: r["cell"]):
        radius[row["cell"]] = row["r"]
        if held[-1] and held[-1] + row["n"] > block:
            held.append(0)
        bins[row["cell"]] = len(held) - 1
        held[-1] += row["n"]
    blocks = -(-np.array(held, dtype="int64") // block)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(v: pd.Series, reach: pd.Series) -> pd.Series:
        d = _distances(_matrix(v), pivots)
        near = d - radius[None, :] <= reach.to_numpy()[:, None] + 1e-6
        return pd.Series([np.unique(bins[row]).astype("int32") for row in near])

    # from here on a cell is a bin
    visits = queries.withColumn("cell", F.explode(cells("v", "reach")))
    counted = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per pivot
    groups = np.ones(len(held), dtype="int64")
    for row in counted:
        groups[row["cell"]] = -(-row["n"] // block)
    n_blocks = F.element_at(F.lit(blocks), F.col("cell") + 1)
    n_groups = F.element_at(F.lit(groups), F.col("cell") + 1)
    own = F.xxhash64("id")
    placed = placed.withColumn("cell", F.element_at(F.lit(bins if len(bins) else np.zeros(1, dtype="int32")), F.col("cell") + 1))
    first = F.lit(0).cast("bigint")
    # both sides may come from one table, so every column gets a name of its own
    members = placed.select(
        F.col("id").alias("mid"), F.col("v").alias("mv"), F.col("cell").alias("mc"), F.pmod(own, n_blocks).alias("mb"),
        F.explode(F.sequence(first, n_groups - 1)).alias("mp"), *[F.col(c).alias(f"m{c}") for c in placed.columns if c not in ("id", "v", "cell", "d", "ub")],
    )
    asked = visits.select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("cell").alias("qc"),
        F.explode(F.sequence(first, n_blocks - 1)).alias("qb"), F.pmod(own, n_groups).alias("qp"),
        *[F.col(c).alias(f"q{c}") for c in queries.columns if c not in ("id", "v", "reach", "cell")],
    )
    return asked.groupBy("qc", "qb", "qp").cogroup(members.groupBy("mc", "mb", "mp")).applyInPandas(kernel, schema)


def pairs_within(df: DataFrame, row_id: str, vec: str, radius: float) -> DataFrame:
    """All pairs (a < b) of rows at Euclidean distance <= radius, with the distance."""
    pts = df.select(F.col(row_id).cast("bigint").alias("id"), V.as_double(F.col(vec)).alias("v"))
    pivots = _pivots(pts)
    placed = _in_cells(pts, pivots)

    def kernel(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        if q.empty or m.empty:
            return empty
        x, y = _matrix(q["qv"]), _matrix(m["mv"])
        ids, other = q["qid"].to_numpy(), m["mid"].to_numpy()
        found = []
        for at in range(0, len(x), CHUNK):
            part, mine = x[at : at + CHUNK], ids[at : at + CHUNK]
            i, j = np.nonzero((_distances(part, y) <= radius + 1e-6) & (mine[:, None] < other[None, :]))
            dist = _exact(part[i], y[j])
            ok = dist <= radius
            found.append(pd.DataFrame({"a": mine[i][ok], "b": other[j][ok], "dist": dist[ok]}))
        return pd.concat(found, ignore_index=True)

    queries = pts.withColumn("reach", F.lit(float(radius)))
    return _block_join(placed, queries, pivots, kernel, "a bigint, b bigint, dist double")


def _near_chunks(q: pd.DataFrame, m: pd.DataFrame, radius: float):
    """(first row, boolean matrix) per chunk of `q`: members within `radius` under another id. Distances near the radius
    are taken again without cancellation."""
    if q.empty or m.empty:
        return
    x, y = _matrix(q["qv"]), _matrix(m["mv"])
    ids, other = q["qid"].to_numpy(), m["mid"].to_numpy()
    order = np.argsort(other, kind="stable")
    lo, hi = (np.searchsorted(other[order], ids, side) for side in ("left", "right"))
    sx, sy = (x * x).sum(1), (y * y).sum(1)
    slack = 1e-12 * sum(s[np.isfinite(s)].max(initial=0.0) for s in (sx, sy)) + 2e-6 * radius + 1e-12
    step = max(1, CHUNK * BLOCK // len(y))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        sq = sx[at : at + step, None] + sy[None, :] - 2.0 * (part @ y.T)
        near = sq <= radius * radius + slack
        i, j = np.nonzero(near & (sq >= radius * radius - slack))
        for k in range(0, len(i), BLOCK):
            a, b = i[k : k + BLOCK], j[k : k + BLOCK]
            near[a, b] = _exact(part[a], y[b]) <= radius
        for row in range(at, at + len(part)):
            near[row - at, order[lo[row] : hi[row]]] = False
        yield at, near


def _block_rows(pts: DataFrame) -> int:
    """Rows of a block that gives off few rows: a sixth of the points, so that a point travels no more often with more of them, up to
    64 MB of vectors; beyond that the copies of a point grow with the points."""
    n, dim = pts.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    return max(1024, min(n // 6, (64 << 20) // (8 * max(dim, 1))))


def weights_within(pts: DataFrame, radius: float) -> DataFrame:
    """(id, nw) per id of points (id, v, w) that has others at distance <= radius: their summed w. No pair leaves a block."""

    def kernel(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        nw, w = np.zeros(len(q), dtype="int64"), m["mw"].to_numpy(dtype="int64")
        heavy = np.flatnonzero(w != 1)
        for at, near in _near_chunks(q, m, radius):
            nw[at : at + len(near)] = np.count_nonzero(near, axis=1) + near[:, heavy] @ (w[heavy] - 1)
        return pd.DataFrame({"id": q["qid"].to_numpy(dtype="int64"), "nw": nw})[nw > 0]

    pivots, queries = _pivots(pts), pts.select("id", "v", F.lit(float(radius)).alias("reach"))
    found = _block_join(_in_cells(pts, pivots), queries, pivots, kernel, "id bigint, nw bigint", _block_rows(pts))
    return found.groupBy("id").agg(F.sum("nw").alias("nw"))


def core_links(pts: DataFrame, radius: float) -> DataFrame:
    """(a, b, core): links among points (id, v, core) at distance <= radius that connect what all such pairs connect.

    A block gives off a spanning forest of its core points (core is true), and for any other point `a` one core point `b` of each tree
    that it touches, so the rows follow the points and not the pairs.
    """

    def kernel(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        other, tree, out = m["mid"].to_numpy(), np.arange(len(m)), []
        for core in (True, False):
            rows = q[q["qcore"].to_numpy(dtype=bool) == core]
            ids = rows["qid"].to_numpy()
            for at, near in _near_chunks(rows, m, radius):
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                root = tree[j]
                if not core:
                    row, root = divmod(np.unique(i * len(m) + root), len(m))
                    out.append((ids[at + row], other[root], core))
                    continue
                start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                low = np.minimum.reduceat(root, start)
                out.append((ids[at + i[start]], other[low], core))
                low = np.repeat(low, np.diff(np.append(start, len(i))))
                apart = root != low
                for a, b in zip(*(x.tolist() for x in divmod(np.unique(root[apart] * len(m) + low[apart]), len(m)))):
                    while tree[a] != a:
                        a = tree[a]
                    while tree[b] != b:
                        b = tree[b]
                    tree[max(a, b)] = min(a, b)
                while not np.array_equal(tree, up := tree[tree]):
                    tree = up
        cut = np.flatnonzero(tree != np.arange(len(tree)))
        out.append((other[cut], other[tree[cut]], True))
        kinds = {"a": "int64", "b": "int64", "core": "bool"}
        return pd.concat([pd.DataFrame({"a": a, "b": b, "core": c}).astype(kinds) for a, b, c in out], ignore_index=True)

    pivots = _pivots(pts)
    members = _in_cells(pts.where("core").select("id", "v"), pivots)
    queries = pts.select("id", "v", "core", F.lit(float(radius)).alias("reach"))
    return _block_join(members, queries, pivots, kernel, "a bigint, b bigint, core boolean", _block_rows(pts))


def nearest_other(df: DataFrame, row_id: str, vec: str) -> DataFrame:
    """(row_id, neighbour, dist) to the nearest other row, exact; ties go to the smaller id.

    Copies of one vector are answered at once (distance 0) and stand for one point. A row's
    search reach is its distance to the nearest pivot, itself a row, so one visit suffices.
    """
    pts = df.select(F.col(row_id).cast("bigint").alias("id"), V.as_double(F.col(vec)).alias("v"))
    sets = pts.withColumn("sig", F.md5(F.array_join("v", ",")))
    copies = sets.groupBy("sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"), F.max("id").alias("last"))
    twins = sets.join(copies.where("k > 1"), "sig")
    twin = F.when(F.col("id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    answered = twins.select("id", twin.alias("neighbour"), F.lit(0.0).alias("dist"))
    pool = checkpointed(sets.join(copies, "sig").where("id = first").select("id", "v", "k"))
    pivots = _pivots(pool)
    placed = _in_cells(pool.select("id", "v"), pivots)
    lone = placed.join(pool.where("k = 1").select("id"), "id", "left_semi")

    def kernel(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "dist": []})
        out = {"id": q["qid"].to_numpy(dtype="int64"), "neighbour": np.zeros(len(q), dtype="int64"), "dist": np.full(len(q), np.inf)}
        if len(m):
            x, y = _matrix(q["qv"]), _matrix(m["mv"])
            ids, other = out["id"], m["mid"].to_numpy()
            order = np.argsort(other, kind="stable")
            y, other = y[order], other[order]
            for at in range(0, len(x), CHUNK):
                to = slice(at, at + CHUNK)
                d = _distances(x[to], y)
                d[ids[to, None] == other[None, :]] = np.inf
                best = d.argmin(1)
                out["neighbour"][to] = other[best]
                out["dist"][to] = np.where(np.isinf(d[np.arange(len(d)), best]), np.inf, _exact(x[to], y[best]))
        return pd.DataFrame(out)

    found = _block_join(placed, lone.select("id", "v", F.col("ub").alias("reach")), pivots, kernel, "id bigint, neighbour bigint, dist double")
    best = found.where(F.col("dist") < float("inf")).groupBy("id").agg(F.min(F.struct("dist", "neighbour")).alias("m"))
    out = answered.union(best.select("id", "m.neighbour", "m.dist"))
    return out.withColumnRenamed("id", row_id)
