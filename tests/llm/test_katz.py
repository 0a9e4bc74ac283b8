import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import katz
from plumbline.llm.katz import discounts, katz_scores

SCHEMA = "doc_id long, text string, score string, chunk int"


def brute(rows, held):
    """Scores per row, and p(w | u) for the sum over all words."""
    texts = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() + [None], h) for (i, t), h in zip(rows, held)]
    uni, bi = Counter(), defaultdict(Counter)
    for _, w, h in texts:
        if not h:
            uni.update(w)
            for a, b in zip(["<s>", *w], w):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    of = lambda cs: np.array([sum(c == r for c in cs) for r in range(1, 7)])
    d1, d2 = discounts(of(list(uni.values()))), discounts(of([c for x in bi.values() for c in x.values()]))
    cut = lambda c, d: c * (d[c] if c <= 5 else 1)
    left = n - sum(cut(c, d1) for c in uni.values())

    def p1(w):
        if left > 1e-12:
            return cut(uni[w], d1) / n if uni[w] else left / n
        return max(uni[w], 1) / (n + 1)

    def p2(u, w):
        x = bi.get(u)
        if not x:
            return p1(w)
        total, kept = sum(x.values()), sum(cut(c, d2) for c in x.values())
        total += kept >= total
        return cut(x[w], d2) / total if x[w] else (1 - kept / total) / (1 - sum(map(p1, x))) * p1(w)

    out = []
    for i, w, h in texts:
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), n, base, sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], w))))
    for u in [*list(bi)[:20], "never"]:
        assert sum(p2(u, w) for w in uni) + p2(u, "never seen") == pytest.approx(1)
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("sizes", [(4_000_000, 3_000_000, 4096), (500, 700, 20)])
def test_against_brute_force(spark, monkeypatch, sizes):
    rng = np.random.default_rng(8)
    vocab = np.array([f"W{i}" for i in range(400)])
    p = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60), p=p / p.sum()))) for i in range(150)]
    rows += [(500, None), (None, "w1 w2"), (501, "W1 " * 3000), (502, "new words only"), (3, "w1"), (3, "w1")]
    for name, x in zip(("TOKENS", "PART", "SPREAD"), sizes):
        monkeypatch.setattr(katz, name, x)
    held = [i is not None and i % 4 == 1 for i, _ in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    same(katz_scores(df, F.col("doc_id") % 4 == 1).collect(), brute(rows, held))


def test_no_training_rows_and_empty_table(spark):
    one = spark.createDataFrame([(1, "a b", None, None)], SCHEMA)
    r = katz_scores(one, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert katz_scores(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0


def test_a_batch_is_let_go_before_its_rows_are_worked_on():
    import weakref

    import numpy as np
    import pyarrow as pa

    from plumbline.llm import katz

    batches = [pa.RecordBatch.from_pydict({"a": [1, 2, 3]})]
    first = weakref.ref(batches[0])
    rows = katz._each(batches.pop() for _ in range(1))
    assert next(rows)["a"] == 1 and first() is None
    assert [r["a"] for r in rows] == [2, 3]
    numbers = np.array([0, 255, 256, 70_000, 2**32 - 1])
    assert (katz._joined(katz._planes(numbers)) == numbers).all()
