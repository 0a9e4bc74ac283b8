import numpy as np

from plumbline.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, n_words string, groups int"


def brute(rows, width):
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def check(spark, rows, width):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = remove_repeats(df, width=width).collect()
    assert all(r.groups == 1 for r in got)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in got), key=str) == brute(rows, width)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, shared = [], [list(rng.choice(vocab, k)) for k in (8, 11, 20, 60)]
    for i in range(150):
        w = list(rng.choice(vocab, rng.integers(0, 60)))
        for s in shared:
            if rng.random() < 0.4:
                a = rng.integers(0, len(s))
                w[int(rng.integers(0, len(w) + 1)) : 0] = s[a // 3 :] if rng.random() < 0.5 else s
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 150, 7)]
    rows += [(2000 + i, rows[3][1].replace("w1", "w2") + " end") for i in range(40)]
    check(spark, rows, 10)


def test_low_entropy_ties_nulls_and_long_rows(spark):
    rows = [(1, "a " * 30), (2, "a " * 25 + "b"), (3, None), (4, ""), (None, "a " * 30), (5, "a b " * 40), (6, "a b " * 5000), (2, "a " * 25 + "b"), (2, "b " * 40), (7, "b\n\t" * 40)]
    check(spark, rows, 10)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
