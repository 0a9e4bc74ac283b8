"""Keep-first under similarity on frequent tokens: exact against the sequential rule, few rounds."""

import numpy as np

from plumbline.plans import similarity as SIM
from tests.test_plans import brute_leaders


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<string>")


def kept_of(df, threshold):
    return {r["id"] for r in SIM.similar_leaders(df, "id", "t", threshold).collect() if r["id"] == r["leader"]}


def test_chains_on_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(SIM, "SMALL_BUCKET", 3)  # nearly every shared token counts as frequent
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(14)]
    sets = {int(i): set(map(str, rng.choice(words, rng.integers(3, 9), replace=False))) for i in rng.permutation(150)}
    sets |= {200 + j: {f"c{k}" for k in range(j, j + 6)} for j in range(30)}  # each is like the next, not like the one after
    df = table(spark, sets)
    for threshold in (0.5, 0.7):
        want = {i for i, k in brute_leaders(sets, threshold).items() if i == k}
        assert kept_of(df, threshold) == want


def test_unlike_rows_under_one_token_take_few_rounds(spark, monkeypatch):
    sets = {i: {"hot", f"a{i}"} for i in range(364)}
    sets |= {1000 + i: {"hot", "b0", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8", "b9", f"x{i}"} for i in range(100)}
    calls, real = [], SIM._verified
    monkeypatch.setattr(SIM, "_verified", lambda *a: calls.append(1) or real(*a))
    kept = kept_of(table(spark, sets), 0.8)
    assert kept == set(range(364)) | {1000} and len(calls) - 1 < 10
