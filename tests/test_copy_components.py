"""Components of near copies: over all pairs above the threshold, also those whose rows were displaced by different kept rows."""

import random

import pytest

from __spark_entry__ import oracle_sql, queries
from plumbline.plans import similarity as SIM
from plumbline.plans.graphs import connected_components

NAME = "connected_components"


def drifting(rng, families, length, names):
    """Families of sets in which each is like the one before and ever less like the first; some copies; some unlike."""
    sets = []
    for g in range(families):
        now = [f"g{g}-{i}" for i in range(rng.choice(names))]
        for v in range(length):
            sets.append(set(now))
            if rng.random() < 0.2:
                sets.append(set(now))
            for _ in range(rng.randrange(3)):
                now[rng.randrange(len(now))] = f"v{g}-{v}-{rng.randrange(10**6)}"
    sets += [{f"u{i}-{j}" for j in range(rng.randrange(1, 30))} for i in range(10)]
    rng.shuffle(sets)
    return sets


def brute_components(sets, threshold):
    """Smallest id reachable by pairs above the threshold, of every id that has such a pair."""
    near, ids = {}, [i for i, s in sets.items() if s]
    for x in ids:
        for y in ids:
            if x != y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) > threshold:
                near.setdefault(x, set()).add(y)
    label = {}
    for i in sorted(near):
        todo = [i] if i not in label else []
        label.setdefault(i, i)
        while todo:
            for y in near[todo.pop()]:
                if y not in label:
                    label[y] = i
                    todo.append(y)
    return label


def components(spark, sets, threshold):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, t array<string>")
    return {r["node"]: r["component"] for r in connected_components(SIM.similar_links(df, "id", "t", threshold), "a", "b").collect()}


@pytest.mark.parametrize(("threshold", "rounds", "meeting"), [(0.9, 8, 2048), (0.9, 1, 2), (0.75, 0, 4), (0.5, 8, 2048)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, threshold, rounds, meeting):
    """With no or one round of stars most pairs are found by blocks of few rows."""
    monkeypatch.setattr(SIM, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(SIM, "MEETING", meeting)
    sets = dict(enumerate(drifting(random.Random(7), 6, 10, (8, 20, 21, 60, 150)))) | {900: set(), 901: set()}
    want = brute_components(sets, threshold)
    assert len(set(want.values())) > 3
    assert components(spark, sets, threshold) == want


def test_large_group_of_near_copies_is_linear(spark, monkeypatch):
    """500 near copies of one set make 124,750 pairs; about one a row is looked at."""
    base = {f"w{i}" for i in range(60)}
    sets = {i: base | {f"x{i}"} for i in range(500)}
    seen, real = [], SIM.stored

    def counted(df, label):
        out = real(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(SIM, "stored", counted)
    assert components(spark, sets, 0.9) == dict.fromkeys(sets, 0)
    assert sum(n for label, n in seen if label == "set-pairs") < 1500


def test_large_sets_near_the_threshold(spark, monkeypatch):
    """Large sets fill up a small sketch; the wide one keeps unlike ones apart and loses no pair."""
    rng, pairs, real = random.Random(5), [], SIM.stored
    words = [f"w{i}" for i in range(6000)]
    base = {g: set(rng.sample(words, 2600 + 300 * g)) for g in range(3)}
    sets = {}
    for i in range(36):
        gone = rng.sample(sorted(base[i % 3]), 115 + 3 * (i // 3))  # around a similarity of 0.9 with the whole
        sets[i] = base[i % 3] - set(gone) | {f"x{i}-{j}" for j in range(len(gone))} if i > 2 else base[i]
    sets |= {100 + i: set(rng.sample(words, rng.choice((1000, 2500, 3000)))) for i in range(40)}

    def counted(df, label):
        out = real(df, label)
        pairs.extend([(r["a"], r["b"]) for r in out.select("a", "b").collect()] if label == "set-pairs" else [])
        return out

    monkeypatch.setattr(SIM, "stored", counted)
    want = brute_components(sets, 0.9)
    assert 5 < len(want) < 36 and components(spark, sets, 0.9) == want
    assert all(a < 100 and b < 100 for a, b in pairs)


def documents(spark, d, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")


def by_sql(d):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    return sorted(con.execute(oracle_sql()[NAME]).fetchall())


def test_a_dropped_row_still_links_others(spark, tmp_path):
    """2 is like 1 and 3, but 3 is not like 1: 1 displaces 2, and 3 is kept."""
    first = [f"word{i}" for i in range(40)]
    second, third = ["new0", "new1", *first[2:]], ["new0", "new1", "new2", "new3", *first[4:]]
    documents(spark, tmp_path, [(i, " ".join(w)) for i, w in enumerate((first, second, third), 1)])
    got = sorted(map(tuple, queries()[NAME](spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (2, 1), (3, 1)] == by_sql(tmp_path)


def test_odd_rows_as_in_sql(spark, tmp_path):
    """Rows that come twice, ids with two texts, null ids, null and blank texts."""
    rng = random.Random(3)
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(drifting(rng, 8, 9, (9, 25, 40, 90)))]
    texts = [t for _, t in rows]
    rows += rows[:20] + [(rng.randrange(60), rng.choice(texts)) for _ in range(6)] + [(None, t) for t in rng.sample(texts, 5)]
    rows += [(1000, None), (1001, None), (1002, ""), (1003, " \n"), (1004, "alone"), (1004, "alone")]
    documents(spark, tmp_path, rows)
    got = sorted(map(tuple, queries()[NAME](spark, str(tmp_path)).collect()))
    assert got == by_sql(tmp_path) and len({c for _, c in got}) > 3
