"""Keep-first at blocks of tokens: what moves through shuffles stays small, and the rule stays exact."""

import numpy as np
import pytest

from plumbline.plans import similarity as SIM
from tests.test_plans import brute_leaders


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<string>")


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_keep_first_across_sizes(spark, threshold):
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(300)])
    sets = {}
    for g in range(40):  # families around every band edge, members some tokens apart
        base = list(rng.choice(words, int(rng.integers(5, 120)), replace=False))
        for j in range(6):
            size = max(1, int(len(base) * rng.uniform(0.75, 1.0)))
            sets[int(g * 10 + j)] = set(map(str, base if j == 0 else [*base[:size], f"x{g}-{j}"]))
    got = {r["id"] for r in SIM.similar_leaders(table(spark, sets), "id", "t", threshold).collect() if r["id"] == r["leader"]}
    assert got == {i for i, k in brute_leaders(sets, threshold).items() if i == k}


def test_unlike_sets_of_common_words_make_no_pairs(spark, monkeypatch):
    """400 sets over 150 words share every word with hundreds of others; the tokens of none but the near copies move."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    sets = {i: set(map(str, rng.choice(words, 60, replace=False))) for i in range(400)}
    sets[1000] = (sets[7] - {next(iter(sorted(sets[7])))}) | {"other"}
    seen, real = [], SIM.stored

    def counted(df, label):
        out = real(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(SIM, "stored", counted)
    lead = {r["id"]: r["leader"] for r in SIM.similar_leaders(table(spark, sets), "id", "t", 0.9).collect()}
    assert lead[1000] == 7 and all(lead[i] == i for i in range(400))
    assert sum(n for label, n in seen if label == "set-pairs") == 1 and sum(n for label, n in seen if label == "set-posts") < 1000
