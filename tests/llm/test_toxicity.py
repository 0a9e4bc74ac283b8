import numpy as np

from plumbline.llm.toxicity import fit_toxicity, score_toxicity, subwords

SCHEMA = "doc_id long, text string, label string, score string"


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    out, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = list(rng.choice(words, 40))
        if toxic:
            w[3], w[20] = "moron", "pathetic"
        out.append((i, " ".join(w), None, None))
        labels.append((i, int(toxic)))
    return out, labels


def test_learns_words_and_misspellings(spark):
    docs, labels = rows()
    d = spark.createDataFrame(docs, SCHEMA)
    model = fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    base = " ".join(docs[1][1].split()[:38])
    got = model.score([base.encode(), f"{base} moron pathetic".encode(), f"{base} morron patthetic".encode(), f"{base} MORON! Pathetic?".encode(), b""])
    assert got[0] < 0.3 < got[1] and got[2] > 0.3 and abs(got[3] - got[1]) < 1e-9
    assert got[4] == model.prior


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    model = fit_toxicity(docs, labels.where("doc_id % 4 <> 2"))
    got = score_toxicity(docs.join(labels.where("doc_id % 4 = 2"), "doc_id"), model).select("toxic", "score").toPandas()
    hit = (got.score >= 0.3) == (got.toxic == 1)
    assert hit.mean() > 0.98 and hit[got.toxic == 1].mean() > 0.9


def test_edge_rows(spark):
    docs, labels = rows(60)
    model = fit_toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(1, None), (None, 1), (1, 0)], "doc_id long, toxic int"))
    odd = [(1, None, "a", "x"), (2, "", "b", None), (None, "...", None, None), (3, "word " * 100_000, None, None), (3, "w", None, None), (3, "w", None, None)]
    got = score_toxicity(spark.createDataFrame(odd, SCHEMA), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.label for r in got} == {"a", "b", None}


def test_empty_tables_and_one_class(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(none, labels)
    assert score_toxicity(none, model).count() == 0
    one = spark.createDataFrame([(1, "abc", None, None)], SCHEMA)
    assert score_toxicity(one, model).first().score < 0.3
    assert score_toxicity(one, fit_toxicity(one, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).first().score < 0.3


def test_subwords_stay_inside_words():
    a, _ = subwords([b"ab cd"])
    b, _ = subwords([b"ab"])
    c, _ = subwords([b"cd"])
    assert sorted(a) == sorted(np.concatenate([b, c]))


def test_sixty_labels_rank_held_out_texts(spark):
    import numpy as np

    from plumbline.llm import toxicity as T

    rng = np.random.default_rng(9)
    calm, rude = [f"calm{i} word" for i in range(60)], ["stupid idiot", "awful idiots", "stupidest fool", "foolish moron"]
    make = lambda toxic: " ".join(list(rng.choice(calm, 12)) + ([str(rng.choice(rude))] if toxic else []))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = T.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = [make(i % 2) for i in range(40)] + ["calm3 word st_upid idi0ts foools"]
    s = model.score([t.encode() for t in held])
    assert len(set(np.round(s, 6))) > 20 and s[1:40:2].min() > s[0:40:2].max() and s[40] > np.median(s[0:40:2])


def test_scores_are_the_average_over_every_subword():
    import numpy as np

    from plumbline.llm import toxicity as T

    rng = np.random.default_rng(1)
    model = T.ToxicityModel(rng.normal(size=1 << T.BITS), -0.3, 0.2)
    texts = [b"Some words, here!", b"", b"a", b"x" * 50_000, b"Some words, here!"]
    got = model.score(texts)
    for t, g in zip(texts, got):
        ids, _ = T.subwords([t])
        want = 1 / (1 + np.exp(-(model.weights[ids].mean() + model.bias))) if len(ids) else model.prior
        assert abs(g - want) < 1e-9
