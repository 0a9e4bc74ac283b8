"""Clusters by density: what leaves the blocks follows the points, not their pairs."""

import numpy as np

from plumbline.operators import scoring as S
from plumbline.plans import similarity as SIM


def brute(rows, eps, least):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows])
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, ids, np.iinfo("int64").max)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], np.iinfo("int64").max).min(1), label)
        if (new == label).all():
            break
        label = new
    out = {}
    for k, i in enumerate(ids):
        at = label[near[k] & core] if not core[k] else label[k : k + 1]
        if len(at):
            out[i] = int(at.min())
    return out


def test_dense_points_give_off_a_forest(spark, monkeypatch):
    """300 points all within reach of each other make 44,850 pairs; a forest per block and one link per point suffice."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.01, 4)).tolist()) for i in range(300)] + [(300 + i, (rng.normal(0, 0.01, 4) + 9).tolist()) for i in range(3)]
    monkeypatch.setattr(SIM, "BLOCK", 64)
    monkeypatch.setattr(SIM, "_block_rows", lambda pts: 64)
    pts = spark.createDataFrame([(i, v, i < 300) for i, v in rows], "id long, v array<double>, core boolean")
    links = SIM.core_links(pts, 0.5).collect()
    assert 300 <= len(links) <= 2 * 300 * 6 and all(r.core for r in links)
    weights = {r.id: r.nw for r in SIM.weights_within(pts.selectExpr("id", "v", "id % 2 + 1 AS w"), 0.5).collect()}
    total = sum(i % 2 + 1 for i in range(300))
    assert all(weights[i] == total - (i % 2 + 1) for i in range(300)) and len(weights) == 303


def test_clusters_are_those_of_all_pairs(spark, monkeypatch):
    """Chains, border points between two clusters, copies and several blocks, against all pairs."""
    rng = np.random.default_rng(3)
    rows = [(1000 - i, [0.1 * i, 0.0]) for i in range(60)] + [(2000 + i, [8 + 0.1 * i, 0.0]) for i in range(30)]
    rows += [(3000 + i, rng.uniform(0, 12, 2).tolist()) for i in range(150)] + [(4000 + i, [3.0, 3.0]) for i in range(5)] + [(5000, [3.0, 3.35])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(SIM, "_block_rows", lambda pts: 40)
    for eps, least in ((0.4, 4), (0.7, 5), (0.1 + 1e-9, 3)):
        got = {r.id: r.cluster for r in S.density_clusters(df, "id", "v", eps, least).collect()}
        assert got == brute(rows, eps, least)
