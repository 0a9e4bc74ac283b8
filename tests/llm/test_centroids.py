import hashlib

import numpy as np
import pytest

from plumbline.llm.centroids import assign_clusters, cluster_inertia, fit_centroids, integer_vectors, per_cluster

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, v int, near int"


def brute(rows, k=16, rounds=3):
    x = {i: np.floor(np.array(v, np.float32).astype(float) * 64).astype(int) for i, v in rows}
    order = sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x[i] for i in order[:k]]

    def assign():
        return {i: min((int(((v - m) ** 2).sum()), j) for j, m in enumerate(c)) for i, v in x.items()}

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [x[i] for i, (_, n) in at.items() if n == j]
            if own:
                c[j] = sum(own) // len(own)
    return assign(), [m.tolist() for m in c]


@pytest.mark.parametrize("n", [5, 400])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 3, [float(np.float32(y)) for y in rng.normal(size=64) / 4]) for i in range(n)]
    rows += [(i * 3 + 1, rows[1][1]) for i in range(n // 2)]  # a hot vector
    odd = [(9001, None), (9002, []), (9003, [0.5] * 63), (9004, [0.5] * 65), (9005, [None] + [0.5] * 63), (9006, [float("nan")] * 64), (9007, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, "x", None, 1, 2) for r in rows + odd], SCHEMA).repartition(3)
    vectors = integer_vectors(df)
    centroids = fit_centroids(vectors)
    want, means = brute(rows)
    assert centroids == means
    got = {r.id: (r.distance, r.cluster) for r in assign_clusters(vectors, centroids).collect()}
    assert got == want
    inertia = cluster_inertia(vectors, centroids)
    assert inertia == {j: sum(d for d, c in want.values() if c == j) for j in {c for _, c in want.values()}}


def test_ties_empty_tables_and_huge_components(spark):
    tie = spark.createDataFrame([(1, [0, 0]), (2, [2, 0]), (3, [1, 0])], "id long, v array<long>")
    assert {r.id: (r.cluster, r.distance) for r in assign_clusters(tie, [[0, 0], [2, 0], [0, 0]]).collect()} == {1: (0, 0), 2: (1, 0), 3: (0, 1)}
    none = integer_vectors(spark.createDataFrame([], SCHEMA))
    assert fit_centroids(none) == [] and cluster_inertia(none, []) == {} and assign_clusters(none, []).count() == 0
    rows = [(1, [1e30] * 64), (None, [0.25] * 64), (3, [-0.01] * 64), (3, [0.5] * 64)]
    vectors = integer_vectors(spark.createDataFrame([(*r, "x", None, 1, 2) for r in rows], SCHEMA))
    centroids = fit_centroids(vectors, rounds=0)
    assert centroids == [[-1] * 64, [32] * 64, [16] * 64]
    out = assign_clusters(vectors, centroids).withColumn("big", per_cluster({0: 1 << 70, 1: 5}, "bigint")).collect()
    assert sorted((str(r.id), r.cluster, r.big) for r in out) == [("1", None, None), ("3", 0, None), ("3", 1, 5), ("None", 2, None)]


def test_plan_stays_in_the_jvm(spark, sf):
    vectors = integer_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    out = assign_clusters(vectors, fit_centroids(vectors))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "label" not in plan
