from plumbline.llm.langid import fit_languages, predict_languages

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = predict_languages(docs.where("doc_id % 3 = 1"), fit_languages(docs.where("doc_id % 3 <> 1"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_edge_rows_and_empty_tables(spark):
    rows = [(i, "the cat and the dog sat with us " * (i % 3 + 1) if i % 2 else "der hund und die katze sitzen bei uns", "en" if i % 2 else "de", None) for i in range(20)]
    model = fit_languages(spark.createDataFrame(rows + [(None, "x", "en", None), (99, None, "en", None), (98, "x", None, None)], SCHEMA))
    odd = [(1, None, None, "x"), (2, "", "en", "x"), (3, "12 !?", None, None), (4, "THE DOG AND THE CAT " * 9000, None, None), (None, "die katze und der hund", None, None), (None, "die katze und der hund", None, None)]
    got = predict_languages(spark.createDataFrame(odd, SCHEMA), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("None", "de"), ("None", "de")]
    none = spark.createDataFrame([], SCHEMA)
    assert predict_languages(none, model).count() == 0
    assert {r.lang_pred for r in predict_languages(spark.createDataFrame(odd, SCHEMA), fit_languages(none)).collect()} == {"und"}


def test_against_the_kernel_matrix(spark):
    """Scores by the folded table equal those of the landmark features and dual weights written out."""
    import numpy as np

    from plumbline.llm import langid as L

    texts = {"en": "the cat and the dog were in the house with them", "de": "der hund und die katze waren in dem haus mit ihnen", "fr": "le chien et le chat dans la maison avec eux"}
    rng = np.random.default_rng(4)
    rows = [(x, " ".join(rng.permutation(t.split())[:7])) for x, t in texts.items() for _ in range(12)]
    langs, sets = [x for x, _ in rows], [L.presence(t) for _, t in rows]
    model = L.train(langs, sets, landmarks=5)
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    labels = sorted(texts)
    marks = [i for x in labels for i in [j for j, y in enumerate(langs) if y == x][:5]]
    k = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    val, vec = np.linalg.eigh(k[marks])
    root = vec / np.sqrt(np.maximum(val, 1e-6))
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.where(np.array(langs)[:, None] == np.array(labels), 1.0, -1.0)
    w = np.linalg.solve(z.T @ z / 12 + 1e-3 * np.eye(z.shape[1]), z.T @ y / 12)
    want = [labels[i] for i in (k @ root @ w[:-1]).argmax(1)]
    names, scores = model.predict([t for _, t in rows])
    assert names == want == langs and ((scores > 1 / 3) & (scores <= 1)).all()


def test_letters_long_texts_and_clashing_columns(spark):
    from plumbline.llm import langid as L

    rows = [(1, "the house is big", "en", 1), (2, "das haus ist gross", "de", 1), (3, "the dog is here", "en", 2), (4, "der hund ist hier", "de", 2)]
    rows += [(5, "½ ² Ⅷ ① 12 _", None, 3), (6, None, None, 3), (7, "", None, 3), (8, "the house is here " * 40_000, None, 3), (8, "the house is here " * 40_000, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, score int")
    out = L.predict_languages(docs.drop("lang"), L.fit_languages(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in out if r.doc_id > 4) == [(5, "und"), (6, "und"), (7, "und"), (8, "en"), (8, "en")]
    many = spark.createDataFrame([(i, f"word{i % 50} text of language", f"l{i % 50}") for i in range(500)], "doc_id int, text string, lang string")
    assert len(L.fit_languages(many, max_rows=100).labels) == 50
