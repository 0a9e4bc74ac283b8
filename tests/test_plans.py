"""Distributed plans against brute force, with hot keys and ties, and shape checks of plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import dedup as DD
from plumbline.operators.rewards import discounted_returns, gae
from plumbline.operators.scoring import density_clusters
from plumbline.plans import ordering as O
from plumbline.plans import similarity as SIM
from plumbline.plans.graphs import connected_components


def skewed(spark, n=3000):
    """A third of the rows share one key and one value."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(20)}", 5.0 if i % 3 == 0 else float(rng.randrange(50))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double").repartition(7)


def test_ranked_global_and_per_key(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["rank"] for r in O.ranked(df, ["v", "id"]).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want
    got = {r["id"]: r["rank"] for r in O.ranked(df, ["v", "id"], ["k"]).collect()}
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def test_prefix_sums_and_rolling_rows(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["s"] for r in O.prefix_sums(df, ["id"], {"s": F.col("v")}, ["k"]).collect()}
    run = {}
    for i, k, v in rows:
        run[k] = run.get(k, 0.0) + v
        assert got[i] == pytest.approx(run[k])
    ranked = O.ranked(df, ["id"])
    roll = {r["id"]: r["m"] for r in O.rolling_rows(ranked, {"m": F.avg("v")}, 99, block=128).collect()}
    vals = [r[2] for r in rows]
    for i in range(len(vals)):
        assert roll[i] == pytest.approx(np.mean(vals[max(0, i - 99) : i + 1]))


def test_top_n_and_first_per_key(spark):
    rows, df = skewed(spark)
    got = O.top_n_per_group(df, ["k"], [F.desc("v"), "id"], 4, ["id"]).collect()
    want = set()
    for key in {r[1] for r in rows}:
        want |= {r[0] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))[:4]}
    assert {r["id"] for r in got} == want
    first = {r["id"] for r in O.first_per_key(df, [F.col("k"), F.col("v")], ["id"]).collect()}
    seen, keep = set(), set()
    for i, k, v in rows:
        if (k, v) not in seen:
            seen.add((k, v))
            keep.add(i)
    assert first == keep


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_located_equal_built_in(spark, method):
    rows, df = skewed(spark)
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["k"]: r for r in O.group_quantiles(df, ["k"], "v", probs, method=method).collect()}
    for key in {r[1] for r in rows}:
        v = sorted(r[2] for r in rows if r[1] == key)
        for n, p in probs.items():
            want = np.percentile(v, p * 100) if method == "linear" else v[min(int(len(v) * p), len(v) - 1)]
            assert got[key][n] == pytest.approx(want)
    whole = O.group_quantiles(df, [], "v", {"m": 0.5}, [F.count("v").alias("n")]).first()
    assert whole["m"] == np.median([r[2] for r in rows]) and whole["n"] == len(rows)


def test_splits_have_exact_sizes_and_ignore_layout(spark):
    df = spark.range(1003).withColumnRenamed("id", "x")
    cut = lambda d: {r["x"]: r["split"] for r in O.assign_splits(d, ["x"], [0.8, 0.1], ["a", "b", "c"]).collect()}
    one, two = cut(df.repartition(3)), cut(df.repartition(11))
    assert one == two
    sizes = [sum(v == s for v in one.values()) for s in "abc"]
    assert sizes == [802, 100, 101]
    tiny = O.assign_splits(df.limit(3), ["x"], [0.1, 0.1], ["a", "b", "c"]).select("split").collect()
    assert [r[0] for r in tiny] == ["c"] * 3


def brute_leaders(sets, t):
    kept, lead = [], {}
    for i in sorted(sets):
        hit = next((k for k in kept if (sets[i] or sets[k]) and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) > t), None) if sets[i] else None
        lead[i] = i if hit is None else hit
        if hit is None:
            kept.append(i)
    return lead


@pytest.mark.parametrize("bucket", [64, 1])
def test_similar_leaders_match_sequential_rule(spark, monkeypatch, bucket):
    """bucket 1 sends every shared token down the path for frequent tokens."""
    monkeypatch.setattr(SIM, "SMALL_BUCKET", bucket)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    sets = {}
    for i in range(120):
        words = set(base)
        for _ in range(rng.randrange(6)):
            words.discard(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words.add(f"x{rng.randrange(8)}")
        sets[i] = words if i % 2 else {f"y{rng.randrange(40)}" for _ in range(12)}
    sets[120], sets[121] = sets[0], set()
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<string>")
    got = {r["id"]: r["leader"] for r in SIM.similar_leaders(df, "id", "t", 0.9).collect()}
    kept = {i for i, k in brute_leaders({i: s for i, s in sets.items() if s}, 0.9).items() if i == k}
    assert {i for i, k in got.items() if i == k} == kept | {121}
    for i, k in got.items():
        if i != k:
            assert k < i and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) > 0.9


def test_fuzzy_keeps_first(spark):
    t = " ".join(f"word{i}" for i in range(20))
    df = spark.createDataFrame([(3, t.upper()), (1, t), (2, t + " extra"), (4, "something else entirely")], "id long, t string")
    assert sorted(r["id"] for r in DD.dedup_fuzzy(df, "id", "t").collect()) == [1, 4]


def vectors(seed=0, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 3
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.3
    v[: n // 3] = v[0]  # a third are copies
    return v


@pytest.mark.parametrize("block", [4096, 16])
def test_distance_joins(spark, monkeypatch, block):
    monkeypatch.setattr(SIM, "BLOCK", block)
    v = vectors()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = {r["id"]: r["dist"] for r in SIM.nearest_other(df, "id", "v").collect()}
    assert len(near) == len(v)
    assert all(near[i] == pytest.approx(d[i].min(), abs=1e-9) for i in range(len(v)))
    eps = 0.8
    got = {(r["a"], r["b"]) for r in SIM.pairs_within(df.where(f"id >= {len(v) // 3}"), "id", "v", eps).collect()}
    i, j = np.nonzero(np.triu(d <= eps, 1))
    assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a >= len(v) // 3}


def test_density_clusters(spark):
    v, eps, m = vectors(4), 0.8, 5
    n = len(v)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= m
    label = {}
    for i in range(n):
        if core[i] and i not in label:
            todo, label[i] = [i], i
            while todo:
                x = todo.pop()
                for y in np.nonzero((d[x] <= eps) & core)[0]:
                    if y not in label:
                        label[int(y)] = i
                        todo.append(int(y))
    for i in range(n):
        if not core[i]:
            near = [label[j] for j in np.nonzero((d[i] <= eps) & core)[0]]
            if near:
                label[i] = min(near)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in density_clusters(df, "id", "v", eps, m).collect()}
    assert got == label


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert all(got[i] == 100 for i in range(100, 140)) and got[200] == 200


def test_returns_and_advantages_across_blocks(spark):
    rng = random.Random(5)
    rows = [(e, t, rng.random(), rng.random(), rng.random() < 0.02) for e, n in ((0, 1000), (1, 1), (2, 129)) for t in range(n)]
    df = spark.createDataFrame(rows, "ep long, step long, r double, val double, done boolean").withColumn("nv", F.lit(0.5))
    ret = {(r["ep"], r["step"]): r["return"] for r in discounted_returns(df, ["ep"], "step", "r").collect()}
    adv = {(r["ep"], r["step"]): r["advantage"] for r in gae(df, ["ep"], "step", "r", "val", "done", "nv").collect()}
    for e in (0, 1, 2):
        mine = [r for r in rows if r[0] == e]
        g, a = 0.0, 0.0
        for k in range(len(mine) - 1, -1, -1):
            _, t, r, v, done = mine[k]
            g = r + 0.99 * g
            nxt = mine[k + 1][3] if k + 1 < len(mine) else 0.5
            a = (r - v) if done else (r + 0.99 * nxt - v) + 0.99 * 0.95 * a
            assert ret[(e, t)] == pytest.approx(g) and adv[(e, t)] == pytest.approx(a)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark, sf):
    from __spark_entry__ import queries

    names = [
        "adapter_breakdown", "daily_metrics", "adapter_performance", "dedup_exact", "dedup_md5", "curate", "split_three_way",
        "sample_per_group", "self_eval", "bleu", "mmd_window", "calibration_errors", "request_summary", "tiered_limit", "monitor",
    ]
    for n in names:
        p = plan_of(queries()[n](spark, sf))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, n


def test_keep_first_trims_before_the_shuffle(spark, sf):
    p = plan_of(DD.dedup_exact(B.table(spark, sf, "documents"), ["text"], ["doc_id"]))
    assert p.count("WindowGroupLimit") == 2  # partial before the exchange, final after it


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan_of(B.table(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000.0)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    p = plan_of(O.assign_splits(B.table(spark, sf, "documents").select("doc_id"), ["doc_id"], [0.8], ["a", "b"]))
    assert "text" not in p


def test_histogram_interpolation_bounds(spark):
    from plumbline.operators.timeseries import histogram_quantile

    rows = [("a", "0.1", 10), ("a", "0.5", 20), ("a", "+Inf", 20)]
    h = spark.createDataFrame(rows, "k string, le string, cumulative_count long")
    assert histogram_quantile(h, ["k"], 0.75).first()["quantile"] == pytest.approx(0.3)
    assert math.isclose(histogram_quantile(h, ["k"], 0.25).first()["quantile"], 0.05)


def test_null_groups_and_types_stay(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 7)], "k string, v long")
    near = O.group_quantiles(df, ["k"], "v", {"m": 0.5}, method="nearest")
    assert dict(near.dtypes)["m"] == "bigint"
    assert {r.k: r.m for r in near.collect()} == {"a": 2, "b": None, None: 7}
    rows = spark.range(60).selectExpr("id", "if(id < 50, null, 'x') k")
    got = O.assign_splits(rows, ["id"], [0.8], ["train", "test"], keys=["k"]).groupBy("k", "split").count().collect()
    assert {(r.k, r["split"]): r["count"] for r in got} == {(None, "train"): 40, (None, "test"): 10, ("x", "train"): 8, ("x", "test"): 2}


def test_rows_take_all_vectors_in_turn(spark):
    from plumbline.catalog.flows import with_vectors

    ids = [conv * 1000 + turn for conv in range(40) for turn in (1, 3, 5)]
    vecs = [7 * i + 600 for i in range(50)]
    samples = spark.createDataFrame([(i,) for i in reversed(ids)], "id long")
    vectors = spark.createDataFrame([(i, [float(i)], i % 3) for i in reversed(vecs)], "vec_id long, v array<double>, label int")
    vecs.sort(key=lambda i: (i % 3, i))
    got = {r.id: (r.vec_id, r.v) for r in with_vectors(samples, vectors).collect()}
    assert got == {i: (vecs[k % 50], [float(vecs[k % 50])]) for k, i in enumerate(sorted(ids))}
    assert with_vectors(samples, vectors.limit(0)).count() == 0
