"""Largest inner products through low-dimensional stable projections under a kd-tree, with a chi-square stopping test.

Vectors are put on the unit sphere with one more component, so that a larger inner product with a query is a smaller
Euclidean distance (per band of similar norms: an outlier would flatten all others). A few Gaussian projections keep distances
as d^2 times a chi-square variable. A kd-tree over the projected vectors, fitted on a bounded sample, gives leaves of
bounded size; all vectors are indexed. A query takes leaves, and vectors inside a leaf, in order of projected distance
and verifies them in double precision. It stops when the next projected distance is so large that a vector as near as
its k-th best would have been met before with the stated confidence.

A leaf's vectors meet their queries in one task, in blocks: vectors are cut into parts and queries into shares of bounded
size. Equal vectors are one entry with their smallest ids. A query visits its first leaf, then the next few, and last
whatever its stopping test still allows; vectors are shuffled once per such round, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, stored

SHARE = 4096
_STEPS = (1, 8, 1 << 40)


def chi_square_bound(m: int, confidence: float) -> float:
    """The value a chi-square variable with m (even) degrees of freedom stays below with this probability."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    lo, hi = 0.0, 50.0 * m
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < confidence else (lo, mid)
    return hi


def _measured(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim, norm, f1, f2) of the vectors that take part: bytes of doubles, length, norm, fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column("v")
        flat, at = col.values.cast(pa.float64()), col.offsets.to_numpy()
        holes, flat = np.asarray(flat.is_null()), flat.fill_null(0).to_numpy(zero_copy_only=False)
        valid, keep, rows, norms = np.asarray(col.is_valid()), [], [], []
        for i, (a, b) in enumerate(zip(at, at[1:])):
            x = flat[a:b]
            if valid[i] and b > a and not holes[a:b].any() and np.isfinite(x).all() and x.any():
                top = np.abs(x).max()
                keep.append(i)
                rows.append((x + 0.0).tobytes())  # one zero only
                norms.append(np.sqrt(((x / top) ** 2).sum()) * top)
        f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in rows), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(rows, pa.binary()), pa.array([len(r) // 8 for r in rows], pa.int32()), pa.array(norms, pa.float64()), pa.array(f[:, 0]), pa.array(f[:, 1])],
            names=["id", "v", "dim", "norm", "f1", "f2"],
        )

    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    return map_arrow(base, run, "id long, v binary, dim int, norm double, f1 long, f2 long")


def _directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, m))


def _projected(points: DataFrame, m: int, seed: int) -> DataFrame:
    """`points` (with `most`, the largest norm of the band) plus p: the projection on the unit sphere's extra dimension."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        norm, most = (batch.column(c).to_numpy() for c in ("norm", "most"))
        out = []
        for raw, n, top in zip(batch.column("v").to_pylist(), norm, most):
            x = np.frombuffer(raw) / top
            out.append(np.append(x, np.sqrt(max(0.0, 1 - (n / top) ** 2))) @ _lines(len(x)))
        flat = np.concatenate(out)
        return batch.append_column("p", pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, m), pa.int32()), pa.array(flat)))

    cache = {}

    def _lines(dim: int) -> np.ndarray:
        if dim not in cache:
            cache[dim] = _directions(dim, m, seed)
        return cache[dim]

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return map_arrow(points, run, f"{fields}, p array<double>")


def fit_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits of a complete kd-tree in heap order: the widest dimension is cut at its median."""
    if depth == 0:
        return []
    level, out = [points], []
    for _ in range(depth):
        below = []
        for x in level:
            axis = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
            cut = float(np.median(x[:, axis])) if len(x) else 0.0
            out.append((axis, cut))
            below += [x[x[:, axis] < cut], x[x[:, axis] >= cut]] if len(x) else [x, x]
        level = below
    return out


def leaf_of(tree: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    """Leaf number of each point."""
    node = np.zeros(len(points), np.int64)
    if tree:
        axes, cuts = np.array([a for a, _ in tree]), np.array([c for _, c in tree])
        while node[0] < len(tree):
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= cuts[node])
    return node - len(tree)


def _visits(state: DataFrame, boxes: list, bound: float, step: int) -> DataFrame:
    """(leaf, q, v, norm, p, last) per leaf that a query takes next: up to `step` further ones that pass the stopping test.

    Leaves go by the inner product their nearest corner suggests. The state's `seen` leaves were taken before.
    """
    dims = np.array([b["dim"] for b in boxes])
    lows, highs = (np.array([b[c] for b in boxes], float) for c in ("low", "high"))
    tops, keys = np.array([b["most"] for b in boxes]), np.array([b["leaf"] for b in boxes], np.int64)
    sent = state.sparkSession.sparkContext.broadcast((dims, lows, highs, tops, keys))  # one row per leaf of a bounded tree

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        dims, lows, highs, tops, keys = sent.value
        rows, leaves = [], []
        last, norm, seen = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "norm", "seen"))
        for i, (dim, p) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("p").to_pylist())):
            pick = np.flatnonzero(dims == dim)
            p = np.array(p)
            far = (np.maximum(np.maximum(lows[pick] - p, p - highs[pick]), 0) ** 2).sum(1)
            order = np.lexsort((keys[pick], -tops[pick] * (1 - far / (2 * lows.shape[1]))))
            pick, far = pick[order][seen[i] :], far[order][seen[i] :]
            pick, far = pick[:step], far[:step]
            go = far <= bound * (2 - 2 * last[i] / (norm[i] * tops[pick]))
            leaves.append(keys[pick[go]])
            rows.append(np.full(go.sum(), i))
        rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        if not len(rows):
            return None
        picked = batch.select(["f1", "f2", "v", "norm", "p", "last"]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(leaves), *picked.columns], names=["leaf", *picked.schema.names])

    return map_arrow(state, run, "leaf long, f1 long, f2 long, v binary, norm double, p array<double>, last double", 1 << 18)


def _verified(block: dict, q: dict, bound: float, k: int) -> tuple[list[int], np.ndarray]:
    """Positions and scores in a block that may be among the query's k best, taken by projected distance until the test holds."""
    x, tops, n_ids = block["x"], block["most"], block["n_ids"]
    far = ((block["p"] - np.array(q["p"])) ** 2).sum(1)
    query, last = np.frombuffer(q["v"]), q["last"]
    allowed = bound * (2 - 2 * last / (q["norm"] * tops))
    pick = np.flatnonzero(far <= allowed)
    pick = pick[np.argsort(far[pick], kind="stable")]
    found, scores, size = np.zeros(0, np.int64), np.zeros(0), 64
    while len(pick):
        now, pick, size = pick[:size], pick[size:], size * 2
        found, scores = np.concatenate((found, now)), np.concatenate((scores, (x[now] * query).sum(1)))
        order = np.argsort(-scores, kind="stable")
        full = np.searchsorted(np.cumsum(n_ids[found[order]]), k)
        if full < len(order) and scores[order[full]] > last:
            last = scores[order[full]]
            pick = pick[far[pick] <= bound * (2 - 2 * last / (q["norm"] * tops[pick]))]
    keep = scores >= last
    return found[keep].tolist(), scores[keep]


def _search(points: DataFrame, visits: DataFrame, bound: float, k: int) -> DataFrame:
    """(f1, f2, score, id, g1, g2): candidates found at the visits, query by its fingerprint, candidate with its own."""
    sizes = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.col("n") / SHARE).cast("int")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("most", "double"), ("norm", "double"), ("last", "double"))]
    wanted = points.join(F.broadcast(sizes), "leaf")  # one row per leaf of a bounded tree
    wanted = wanted.select("leaf", "part", F.explode(F.sequence(F.lit(0), share - 1)).alias("share"), F.lit(0).alias("kind"), "f1", "f2", "v", "p", "ids", "most", *none[2:])
    parts = points.groupBy("leaf").agg((F.max("part") + 1).alias("parts"))
    asked = visits.join(F.broadcast(sizes), "leaf").join(F.broadcast(parts), "leaf")
    asked = asked.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("f1"), share).cast("int").alias("share"), F.lit(1).alias("kind"), "f1", "f2", "v", "p", *none[:2], "norm", "last")
    key = ["leaf", "part", "share"]
    both = wanted.union(asked).repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            out = [[] for _ in range(6)]
            for r in batch.to_pylist():
                at = (r["leaf"], r["part"], r["share"])
                if at != now:
                    now, held, block = at, [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if not held:
                    continue
                if block is None:
                    block = {"x": np.stack([np.frombuffer(h["v"]) for h in held]), "p": np.array([h["p"] for h in held]), "most": np.array([h["most"] for h in held]), "n_ids": np.array([len(h["ids"]) for h in held])}
                    for h in held:
                        del h["v"], h["p"]
                for i, s in zip(*_verified(block, r, bound, k)):
                    for x in held[i]["ids"]:
                        for c, value in zip(out, (r["f1"], r["f2"], s, x, held[i]["f1"], held[i]["f2"])):
                            c.append(value)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["f1", "f2", "score", "id", "g1", "g2"])

    return both.mapInArrow(run, "f1 long, f2 long, score double, id long, g1 long, g2 long")


def _indexed(points: DataFrame, m: int, seed: int, leaf_rows: int, sample: int) -> tuple[DataFrame, list]:
    """(points with leaf and part, boxes): the kd-tree's leaves and the box of each around all its points."""
    placed = stored(_projected(points, m, seed), "neighbour-points")
    sizes = placed.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim", "band").limit(1024).collect()
    picked = placed.orderBy(F.xxhash64("f1", "f2"), "f1").select("dim", "band", "p").limit(sample).collect()
    trees, first = {}, 1
    for r in sizes:  # groups without rows in the sample, or beyond the commonest, are one leaf
        x = np.array([s.p for s in picked if (s.dim, s.band) == (r.dim, r.band)], float).reshape(-1, m)
        depth = min(int(np.ceil(np.log2(max(r.n / leaf_rows, 1)))), int(np.log2(max(len(x) / 8, 1))))
        trees[r.dim, r.band] = (first, fit_tree(x, depth))
        first += 1 << depth
    sent = placed.sparkSession.sparkContext.broadcast(trees)  # at most an eighth of the sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = batch.column("p").values.to_numpy()[batch.column("p").offsets[0].as_py() :].reshape(-1, m)[: batch.num_rows]
        kinds = list(zip(batch.column("dim").to_pylist(), batch.column("band").to_pylist()))
        leaf = np.zeros(batch.num_rows, np.int64)
        for kind in set(kinds):
            at = np.array([i for i, x in enumerate(kinds) if x == kind])
            if kind in sent.value:
                start, tree = sent.value[kind]
                leaf[at] = start + leaf_of(tree, p[at])
            else:
                leaf[at] = -(kind[0] * 4096 + kind[1] + 2048) - 1
        return batch.append_column("leaf", pa.array(leaf))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    leaved = stored(map_arrow(placed, run, f"{fields}, leaf long"), "neighbour-leaves")
    ends = [F.array(*[agg(F.col("p")[i]) for i in range(m)]).alias(c) for agg, c in ((F.min, "low"), (F.max, "high"))]
    boxes = leaved.groupBy("leaf").agg(F.first("dim").alias("dim"), F.max("most").alias("most"), F.count(F.lit(1)).alias("n"), *ends)
    boxes = [r.asDict() for r in boxes.collect()]  # one row per leaf
    cut = {b["leaf"]: -(-b["n"] // (2 * leaf_rows)) for b in boxes if b["n"] > 2 * leaf_rows}
    part = F.lit(0)
    if cut:
        parts = F.broadcast(leaved.sparkSession.createDataFrame(list(cut.items()), "leaf long, parts int"))
        leaved = leaved.join(parts, "leaf", "left")
        part = F.pmod(F.xxhash64("f1", "f2"), F.coalesce("parts", F.lit(1))).cast("int")
    return leaved.withColumn("part", part), boxes


def nearest_by_inner_product(
    vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 12, confidence: float = 0.99,
    leaf_rows: int = 2048, sample: int = 32768, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id meets the SQL condition `queries` on `id`, its k nearest other rows.

    Nearest by largest inner product in double precision, ties to the smaller id; all candidates if fewer. A true
    neighbour is missed with probability below 1 - `confidence`. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors of different lengths don't meet. Rows that
    repeat an id are rows of their own; a query leaves out one row with its id and vector. The tree is fitted on
    `sample` vectors; all are indexed.
    """
    rows = stored(_measured(vectors, id_col, vector_col), "neighbour-rows").withColumn("asks", F.expr(queries))
    first = Window.partitionBy("f1", "f2").orderBy("id")
    low = rows.select("f1", "f2", "id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    low = low.groupBy("f1", "f2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("f1", "f2").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.max("asks").alias("asks"))
    distinct = stored(one.join(low, ["f1", "f2"]).withColumn("band", F.round(F.log2("norm")).cast("int")), "neighbour-distinct")
    most = distinct.groupBy("dim", "band").agg(F.max("norm").alias("most"))
    points, boxes = _indexed(distinct.join(most, ["dim", "band"]), projections, seed, leaf_rows, sample)
    index = points.select("leaf", "part", "f1", "f2", "v", "p", "ids", "most")
    bound = chi_square_bound(projections, confidence)
    asking = distinct.where("asks").select("f1", "f2", "v", "dim", "norm", F.col("norm").alias("most"))
    asking = stored(_projected(asking, projections, seed).drop("most"), "neighbour-queries")
    top, seen = None, 0
    best = Window.partitionBy("f1", "f2").orderBy(F.desc("score"), "id", "g1", "g2")
    for step in _STEPS if boxes else ():
        state = asking.withColumn("last", F.lit(-np.inf))
        if top is not None:
            full = top.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
            state = asking.join(full.where(F.col("n") > k), ["f1", "f2"], "left").withColumn("last", F.coalesce("kth", F.lit(-np.inf)))
        state = state.withColumn("seen", F.lit(seen).cast("long"))
        visits = stored(_visits(state, boxes, bound, step), "neighbour-visits")
        found = _search(index, visits, bound, k + 1)
        found = found if top is None else found.union(top)
        top = stored(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "neighbour-top")
        seen += step
        if seen >= len(boxes):
            break
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    lists = top.groupBy("f1", "f2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "id", "g1", "g2"))).alias("near"))  # k + 1 at most
    out = rows.where("asks").select(F.col("id").alias("query_id"), "f1", "f2").join(lists, ["f1", "f2"])
    own = F.expr("transform(near, x -> x.id = query_id and x.g1 = f1 and x.g2 = f2)")
    out = out.withColumn("own", F.coalesce(F.array_position(own, True), F.lit(0)))
    out = out.withColumn("near", F.slice(F.expr("filter(near, (x, i) -> i + 1 <> own)"), 1, k))
    out = out.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.low")).alias("score"))
