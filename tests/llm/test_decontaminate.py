from plumbline.llm.decontaminate import flag_contaminated

SCHEMA = "doc_id long, text string, n_items string, h int"
ITEMS = [
    (1, "A train leaves at 8 and covers 120 km before 8 trucks from Paris and 3 from Rome meet it near the old bridge."),
    (2, "Which river flows slowly through seven quiet valleys?"),
    (6, "At 5 the old clerk counts 5 boxes and then 7 bags before lunch."), (3, None), (4, ""), (5, "12 34 56"),
]


def flags(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = flag_contaminated(docs, bench)
    assert set(out.columns) == {*docs.columns, "contaminated", "first_item"}
    return {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in out.collect()}


def test_slots_and_windows(spark):
    filler = "nothing of interest stands here, only many common words in a row that say little. " * 3
    got = flags(spark, [
        filler + ITEMS[0][1] + filler,
        "A train leaves at 9 and covers 75 miles before 9 trucks from Lyon and 4 from Bonn meet it near the old bridge.",
        "At 6 the old clerk counts 9 boxes and then",  # 5 and 5 became 6 and 9
        filler, "which RIVER flows, slowly through seven quiet valleys", "seven quiet valleys", None, "", "12 34 56",
        filler * 400 + ITEMS[1][1], filler * 400 + ITEMS[1][1],
        "At 6 the old clerk counts 6 boxes and then",
    ])
    assert [got[i][0] for i in range(12)] == [True, True, False, False, True, False, False, False, False, True, True, True]
    assert got[0][1:] == (1, 1) and got[4][1:] == (1, 2) and got[3][1:] == (0, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert flag_contaminated(none, bench).count() == 0
    one = spark.createDataFrame([(1, "some text", "x", 1), (None, "more", None, None)], SCHEMA)
    assert {r.contaminated for r in flag_contaminated(one, bench.limit(0)).collect()} == {False}


def test_items_with_few_literals(spark):
    items = ["What is 17 plus 25?", "Sam buys 3 pens and 4 books", "Add 3 and 4 and 5 and 6 and 7 and 8 and 9 now", "compute 4 5 6 7 8 9 10 11 12 13 14", "17 + 25 + 8 + 9", "Bob met 3"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [*items, *[f"they were asked {t} before lunch" for t in items], *[f"First. {t}. Then more." for t in items]]
    texts += ["What is 4 plus 9?", "What is 4 plus 4?", "Add 2 and 9 and 1 and 3 and 4 and 6 and 5 now", "compute 4 5 6 7 8 9 10 11 12 13 15", "compute 4 5 6 7 8 9 10 11 13", "17 + 25 + 8 + 1", "what is said plus 25 or compute", "Tom met 4"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in flag_contaminated(docs, bench).collect()}
    n = len(items)
    assert [got[i][1:] for i in range(3 * n)] == [(1, i) for i in range(n)] * 3
    assert [got[3 * n + i][0] for i in range(8)] == [True, False, True, True, False, False, False, False]
    # an item with the id of another one keeps its own windows
    both = spark.createDataFrame([(1, items[0]), (1, ITEMS[0][1])], "item_id long, text string")
    assert {r.contaminated for r in flag_contaminated(docs.where("doc_id = 0"), both).collect()} == {True}
