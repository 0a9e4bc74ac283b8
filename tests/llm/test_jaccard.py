import numpy as np

from plumbline.llm.jaccard import _open_pairs, allowed, distance, drop_near_copies, folded, shingles, signatures, sketch, similar_groups

SCHEMA = "doc_id long, text string, sketch string, n int"
NONE = np.zeros(0, np.uint64)


def brute(rows):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append((i, {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= 75 * len(x | y):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return sorted((i, len(s), find(i)) for i, s in sets)


def fixture(seed=2, n=260):
    rng = np.random.default_rng(seed)
    vocab = [f"W{i}" for i in range(4000)]
    passage = list(rng.choice(vocab, 60))
    rows, base = [], [list(rng.choice(vocab, k)) for k in (3, 4, 5, 8, 30, 95, 100, 140, 190, 260, 600)]
    for i in range(n):
        if i % 3:
            w = list(base[int(rng.integers(len(base)))])
            for _ in range(int(rng.integers(0, max(2, len(w) // 25)))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))] or w
        else:
            w = passage + list(rng.choice(vocab, int(rng.integers(10, 90))))
        rows.append((i * 3, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    got = similar_groups(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_every_pair_at_the_threshold_shares_a_signature():
    rng = np.random.default_rng(1)
    for a in (1, 2, 3, 7, 20, 72, 73, 96, 97, 128, 144, 145, 200, 385, 900, 3000):
        for _ in range(30):
            b = int(rng.integers(a, 4 * a // 3 + 1))
            both = -(-3 * (a + b) // 7)
            pool = np.unique(rng.integers(0, 1 << 63, 3 * b + 9, dtype=np.uint64) * np.uint64(2))[: a + b - both]
            pool = rng.permutation(pool)
            x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a:]]))
            assert len(x) + len(y) - 2 * both <= allowed(a, b) or both == 0
            assert len(np.intersect1d(signatures(x, NONE), signatures(y, NONE)))
            assert distance(sketch(x), sketch(y)) <= len(x) + len(y) - 2 * both
            common = np.concatenate([signatures(x, NONE), signatures(y, NONE)])[::2]
            assert len(np.intersect1d(signatures(x, np.sort(common)), signatures(y, np.sort(common))))


def test_edge_rows_and_empty_table(spark):
    rows = [(5, None, "a", 1), (3, "", None, None), (9, " \n", "b", 1), (None, "a b c d e f", None, 1), (7, "A b", None, 1), (2, "a\tB", None, 1), (8, "x y z " * 4000, None, 1), (8, "x y z " * 4000, None, 1), (1, "x y z " * 3000, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.n_shingles): r.component_id for r in similar_groups(df).collect()}
    assert got == {(5, 0): 5, (3, 0): 3, (9, 0): 9, (None, 2): None, (7, 1): 2, (2, 1): 2, (8, 3): 1, (1, 3): 1}
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "9", "None"]
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(shingles(b"")) == 0


def test_one_passage_in_2000_unlike_texts_and_a_loose_family(spark):
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(30_000)]
    passage, body = list(rng.choice(vocab, 70)), list(rng.choice(vocab, 300))
    rows = [(i, " ".join(passage + list(rng.choice(vocab, int(rng.integers(25, 40)))))) for i in range(2000)]
    for i in range(2000, 2150):  # pairs of this family lie on both sides of the threshold
        w = list(body)
        for at in rng.choice(300, 6, replace=False):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, similar_groups(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()))
    assert got[:2000] == [(i, len({tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)}), i) for i, t in rows[:2000]]
    assert got[2000:] == brute(rows[2000:])


def test_columns_of_any_name_and_table_of_copies(spark):
    df = spark.createDataFrame([(i, f"same words in each of these texts {i % 2}", i) for i in range(40)], "doc_id int, text string, __gone int")
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} in ({0, 1}, {0})


def test_open_pairs_tell_long_texts_apart(spark):
    """Long texts under common signatures, too unlike to link: a narrow sketch is full and lets all their pairs through."""
    from pyspark.sql import functions as F

    from plumbline.llm import jaccard as J

    texts = [(i, " ".join(f"w{i}x{j}" for j in range(1500 + i))) for i in range(12)]
    texts.append((20, texts[0][1] + " one more"))
    sets = J._profiles(spark.createDataFrame(texts, "id long, text string"), np.zeros(0, np.uint64))
    rows = sets.select(F.lit(1).cast("long").alias("sig"), "id", F.col("id").alias("comp"), "n", "fold")
    assert [(r.x, r.y) for r in J._open_pairs(rows).collect()] == [(0, 20)]


def test_open_pairs_are_compared_in_compiled_code(spark):
    """Unlike sets on one signature: the pairs found by plain counting, in a method that the JVM compiles (8000 bytes at most)."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - i % 9], rng.integers(1, 1 << 62, i % 5, dtype=np.uint64)])) for i in range(20)]
    sets += [rng.integers(1, 1 << 62, 58, dtype=np.uint64) for _ in range(20)]
    rows = [(7, i, i, len(s), folded(s).tolist()) for i, s in enumerate(sets)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = _open_pairs(spark.createDataFrame(rows, "sig long, id long, comp long, n long, fold array<long>"))
        code = pairs._jdf.queryExecution().debug().codegenToSeq()
        got = sorted(map(tuple, pairs.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000

    def close(a, b):
        apart = int(np.bitwise_count((folded(a) ^ folded(b)).view(np.uint64)).sum())
        return 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)) and 7 * apart <= len(a) + len(b)

    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40) if close(sets[i], sets[j])] and len(got) > 20
