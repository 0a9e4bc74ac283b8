import numpy as np

from plumbline.llm.embeddings import similar_vectors

SCHEMA = "vec_id long, embedding array<float>, n_links string, cells int"


def brute(rows):
    ok = {k: np.array(v, float) for k, v in enumerate(r[1] for r in rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = [r[0] for r in rows]
    links = {k: {j for j in ok if j != k and len(ok[j]) == len(x) and x @ ok[j] / np.linalg.norm(x) / np.linalg.norm(ok[j]) >= 0.95} for k, x in ok.items()}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out.append((ids[k], len(links.get(k, ())), min(ids[j] for j in seen)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(900):
        x = base[i % 40] + rng.normal(size=24) * (0.25 if i % 5 else 0.1)
        rows.append((i * 2, [float(np.float32(v)) for v in x], "x", 1))
    rows += [(5001 + i, rows[3][1], None, None) for i in range(50)]
    rows += [(6001, None, None, 1), (6003, [], None, 1), (6005, [0.0] * 24, None, 1), (6007, [None] + [1.0] * 23, None, 1), (6009, [float("nan")] * 24, None, 1), (6011, [1.0, 2.0], None, 1), (6013, [2.0, 4.0], None, 1)]
    want = brute(rows)
    got = sorted(map(tuple, similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [r[0] for r in got] == [r[0] for r in want]
    n = sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(r[1] for r in got) >= 0.998 * n
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_empty_table_and_null_ids(spark):
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = similar_vectors(spark.createDataFrame([(None, [1.0, 0.0], "x", 1), (4, [1.0, 0.0], None, None)], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(None, 0, None)", "(4, 0, 4)"])
