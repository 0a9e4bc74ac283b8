"""Distance joins: a query leaves once per bin of cells; the score of a selection computes its diversity once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import active as AL
from plumbline.plans import similarity as SIM


@pytest.fixture
def points(spark):
    v = np.random.default_rng(2).normal(size=(400, 6))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>").cache()


def brute(points):
    v = np.array([r.v for r in points.orderBy("id").collect()])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("block", [64, 8192])
def test_queries_leave_once_per_bin(points, monkeypatch, block):
    monkeypatch.setattr(SIM, "BLOCK", block)
    monkeypatch.setattr(SIM, "CHUNK", 16)
    pivots = SIM._pivots(points)
    placed = SIM._in_cells(points, pivots)
    met = SIM._block_join(
        placed, points.withColumn("reach", F.lit(1e9)), pivots, lambda q, m: pd.DataFrame({"n": [len(q)], "m": [len(m)], "nm": [len(q) * len(m)]}),
        "n long, m long, nm long",
    ).agg(F.sum("n").alias("n"), F.sum("nm").alias("nm")).first()
    assert len(pivots) > 1 and met.nm == 400 * 400  # every query meets every member, once
    assert block < 400 or met.n == 400
    d = brute(points)
    near = {r.id: r.dist for r in SIM.nearest_other(points, "id", "v").collect()}
    assert np.allclose([near[i] for i in range(400)], d.min(1))
    got = {(r.a, r.b) for r in SIM.pairs_within(points, "id", "v", 1.0).collect()}
    assert got == {(a, b) for a, b in zip(*np.nonzero(d <= 1.0)) if a < b}


def test_selection_reads_its_diversity_once(points):
    probs = points.select("id", F.array(F.lit(0.25), F.lit(0.75)).alias("p"))
    out = AL.hybrid_select(probs, "id", "p", AL.coreset_diversity(points, "id", "v"), 3)
    assert "CoGroup" not in out._jdf.queryExecution().toString()
    d = brute(points).min(1)
    assert {r.id for r in out.collect()} == set(map(int, np.argsort(-d, kind="stable")[:3]))
