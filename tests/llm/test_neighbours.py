import numpy as np
import pytest

from plumbline.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id string, leaf int, rank int"


def brute(rows, asks, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for n, (i, q) in enumerate(ok):
        if asks(i):
            near = sorted((-float((x * q).sum()), j) for m, (j, x) in enumerate(ok) if m != n and len(x) == len(q))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in near])
    return out


def searched(df, **args):
    out = {}
    for r in N.nearest_by_inner_product(df, "id % 20 = 0", **args).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return out


def recall(got, want):
    hit = total = 0
    for i, lists in want.items():
        kth = lists[0][-1][1]
        assert [x[0] for x in got[i]] == list(range(1, len(lists[0]) + 1))
        assert got[i] == sorted(got[i], key=lambda x: (-x[2], x[1]))
        hit += sum(s >= kth - 1e-12 for _, _, s in got[i])
        total += len(lists[0])
    return hit / total


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_recall_over_many_leaves(spark, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 32))
    rows = [(i, [float(np.float32(y)) for y in base[i % 30] + spread * rng.normal(size=32)]) for i in range(3000)]
    rows += [(10_000 + i, [float(np.float32(100 * y)) for y in rng.normal(size=32)]) for i in range(25)]  # far larger norms
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(searched(df, leaf_rows=64), want) >= 0.98


def test_copies_odd_vectors_and_few_candidates(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(y)) for y in rng.normal(size=8)]) for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(300)]  # copies of a query
    rows += [(1020, rows[3][1]), (1020, rows[3][1]), (1040, [1.0, 2.0]), (1041, [2.0, -1.0]), (1060, [3.0])]
    odd = [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [None] + [1.0] * 7), (2080, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], SCHEMA).repartition(3)
    want = brute(rows + odd, lambda i: i % 20 == 0, 20)
    got = searched(df)
    assert set(got) == {i for i, lists in want.items() if lists[0]} and 1060 not in got
    for i, lists in want.items():
        mine = [(j, pytest.approx(s)) for _, j, s in got.get(i, [])]
        assert mine[:20] == [(j, s) for j, s in lists[0]] if i != 1020 else len(mine) == 40


def test_empty_table(spark):
    out = N.nearest_by_inner_product(spark.createDataFrame([], SCHEMA), "id % 20 = 0")
    assert out.count() == 0 and out.columns == ["query_id", "rank", "id", "score"]


def test_given_table_against_brute_force(spark, sf):
    from plumbline.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op13_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert recall(got, brute(rows, lambda i: i % 20 == 0, 20)) >= 0.98


def test_bound_is_the_chi_square_quantile():
    x = np.random.default_rng(1).normal(size=(200_000, 12))
    assert abs(((x**2).sum(1) < N.chi_square_bound(12, 0.99)).mean() - 0.99) < 0.002


def test_leaves_hold_every_point():
    x = np.random.default_rng(2).normal(size=(1000, 4))
    tree = N.fit_tree(x, 4)
    counts = np.bincount(N.leaf_of(tree, x), minlength=16)
    assert len(tree) == 15 and counts.min() > 50 and counts.sum() == 1000
