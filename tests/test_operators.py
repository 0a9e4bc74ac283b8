"""Hand-computed fixtures for paths the test tables do not reach."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.operators import augment as AU
from plumbline.operators import calibration as CA
from plumbline.operators import cleaning as C
from plumbline.operators import judge as J
from plumbline.operators import metrics as M
from plumbline.operators import scoring as S
from plumbline.operators import synthesis as Y
from plumbline.operators import timeseries as TS
from plumbline.operators import validation as V


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, t string")


def column(df, c="x"):
    return [r[c] for r in df.orderBy("id").collect()]


def test_clean_text(spark):
    df = texts(
        spark, "see https://a.b/c?d=1 now", "www.site.org/x end", "mail me.you+x@host.example.com today", "a\u00a0b\u2003c\x1cd\n\te ",
        "Cafe\u0301", "", None, "A\u030a \u1112\u1161\u11ab \u212b",
    )
    got = column(df.select("id", C.clean_text("t").alias("x")))
    assert got == ["see now", "end", "mail today", "a b c d e", "Caf\u00e9", "", "", "\u00c5 \ud55c \u00c5"]
    assert column(df.select("id", C.clean_text("t", max_length=4).alias("x")))[0] == "see "


def test_every_character_nfc_changes_is_recognised(spark):
    changed = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    df = texts(spark, *changed)
    assert df.where(~F.col("t").rlike(C.MAY_CHANGE)).count() == 0
    assert [c for c in "aéüßçñ漢字" if spark.range(1).select(F.lit(c).rlike(C.MAY_CHANGE)).first()[0]] == []


def test_html_and_broken_utf8(spark):
    df = texts(spark, "<p>Hi <b>you</b></p>\n\n<br/>x", "1 < 2 and 3 > 2")
    assert column(df.select("id", C.strip_html("t").alias("x"))) == ["Hi you x", "1 2"]
    raw = spark.createDataFrame([(0, bytearray(b"ab\xffcd"))], "id long, b binary").select("id", F.col("b").cast("string").alias("t"))
    assert column(raw.select("id", C.strip_html("t").alias("x"))) == ["abcd"]


def test_filters_and_reasons(spark):
    rows = [
        (0, "Explain this please", "", "A long enough answer with several words", "code"),
        (1, "", "", "A long enough answer with several words", "code"),
        (2, "Explain this please", "", None, "code"),
        (3, "Short", "", "A long enough answer with several words", "code"),
        (4, "Explain this please", "", "I'm unable to help with that, my friend", "code"),
        (5, "Explain this please", "", "fourwords but long enoughtopass", "code"),
    ]
    df = spark.createDataFrame(rows, "id long, instruction string, input string, output string, adapter string")
    got = column(df.select("id", C.reject_reason().alias("x")))
    assert got == [None, "missing_fields", "missing_fields", "invalid_length", "low_quality", "low_quality"]
    stats = C.validation_stats(df, C.reject_reason()).first().asDict()
    assert stats == {"total": 6, "valid": 1, "missing_fields": 2, "invalid_length": 1, "low_quality": 2}
    assert C.filter_examples(df, min_length=0, max_length=None).count() == 4  # 0 falls back to 10


def test_repetition_and_quality(spark):
    df = texts(spark, "a b c a b c a b c", "a b c d", "one two three four five six", "bad � char in the text", "tiny")
    assert column(df.select("id", V.ngram_repetition("t").alias("x"))) == [pytest.approx(1 - 3 / 7), 0.0, 0.0, 0.0, 0.0]
    q = column(V.text_quality(df, "t").withColumn("x", F.col("quality")))
    assert q == ["medium", "invalid", "high", "medium", "invalid"]


def test_null_and_empty_digests_differ(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "")], "p string, q string")
    assert V.duplicate_ratio(df).first()["duplicates"] == 1


def test_exact_match_f1_winrate(spark):
    p = spark.createDataFrame([(0, " Hello", "hello"), (1, "a b", "a b"), (2, "x", "y")], "id long, pred string, ref string")
    assert M.exact_match(p).first()[0] == pytest.approx(2 / 3)
    f = M.token_f1(spark.createDataFrame([(0, "the cat sat", "the cat ran"), (1, "", "x")], "id long, pred string, ref string")).first()
    assert f["f1"] == pytest.approx(1 / 3) and f["precision"] == pytest.approx(1 / 3)
    a = spark.createDataFrame([(0, 0.9), (1, 0.5), (2, 0.7), (3, 0.8)], "id long, s double")
    b = spark.createDataFrame([(0, 0.8), (1, 0.6), (2, 0.7), (3, 0.6)], "id long, s double")
    assert tuple(M.win_rate(a, b, "id", "s").first()) == (0.5, 0.25, 0.25)


def test_bleu_with_several_references(spark):
    df = spark.createDataFrame([(0, "the the the cat", ["the cat sat here now", "the the dog"])], "id long, pred string, refs array<string>")
    r = M.bleu(df, refs=F.col("refs")).first()
    # unigrams: the clipped to 2, cat 1 -> 3/4; bigrams: the-the 1, the-cat 1 of 3; none above; closest length 5 or 3 -> 3
    import math

    want = math.exp((math.log(3 / 4) + math.log(2 / 3) + math.log(0.1 / 2) + math.log(0.1 / 1)) / 4)
    assert r["bleu"] == pytest.approx(want) and r["bleu_mean"] == pytest.approx(want)
    none = spark.createDataFrame([(0, "a", ["b"]), (1, "", ["b"])], "id long, pred string, refs array<string>")
    assert M.bleu(none, refs=F.col("refs")).first()["bleu"] == 0.0


def test_rouge(spark):
    df = spark.createDataFrame([(0, "The cat, sat on it", "the cat is on the mat")], "id long, pred string, ref string")
    r = M.rouge_n(df).first()
    assert r["rouge1_p"] == pytest.approx(3 / 5) and r["rouge1_r"] == pytest.approx(3 / 6)
    assert r["rouge2_p"] == pytest.approx(1 / 4)
    lcs = M.rouge_l(df).first()
    assert lcs["rougeL_p"] == pytest.approx(3 / 5) and lcs["rougeL_r"] == pytest.approx(3 / 6)
    stemmed = M.stem_tokens(df, "pred", "id", lambda w: w[:2]).first()
    assert stemmed["pred"] == "th ca sa on it"


def test_perplexity_of_nothing(spark):
    df = spark.createDataFrame([(0.0, 0)], "l double, n int")
    assert M.perplexity(df, "l", "n").first()[0] == float("inf")


def test_scores(spark):
    df = spark.createDataFrame(
        [
            (0, "What is it?", "I hate this stupid idiot, mail a@b.com or 555-123-4567"),
            (1, "Define x", "Maybe? It might be. Could be? Not sure? unclear"),
        ],
        "id long, q string, r string",
    )
    r = df.select("id", S.safety(F.col("r")).alias("s"), S.text_uncertainty(F.col("r")).alias("u")).orderBy("id").collect()
    assert r[0]["s"] == pytest.approx(0.0) and r[1]["s"] == pytest.approx(1.0)
    assert r[0]["u"] == 0.0 and r[1]["u"] == pytest.approx(0.3 + 0.4 + 0.3)
    kinds = spark.createDataFrame([(0.2, 0.2, 0.9, 0.9, 0.0), (0.5, 0.5, 0.5, 0.5, 0.8), (0.5, 0.5, 0.5, 0.5, 0.1)], "c double, r double, f double, s double, u double")
    got = [x[0] for x in kinds.select(S.failure_type(*[F.col(c) for c in "crfsu"])).collect()]
    assert got == ["severe_coherence_failure", "high_uncertainty", "general_quality_issue"]


def test_custom_scorer_clamps_and_survives_errors(spark):
    df = spark.createDataFrame([("a", "2"), ("a", "-1"), ("a", "x"), ("a", "0.3")], "q string, r string")
    got = [x[0] for x in df.select(S.custom_scorer(lambda q, r: float(r), F.col("q"), F.col("r"))).collect()]
    assert got == [1.0, 0.0, 0.5, 0.3]


def test_judge_answers(spark):
    df = texts(spark, 'x {"scores": {"a": 8}, "overall_score": 7} y', "nothing", '{"broken": ')
    assert [r["overall"] for r in column(df.select("id", J.judge_parse(F.col("t")).alias("x")))] == [0.7, 0.5, 0.5]
    rated = texts(spark, "Overall: 8.5", "Overall: 99", "none")
    assert column(rated.select("id", J.rating_parse(F.col("t")).alias("x"))) == [0.85, 1.0, 0.5]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (0.1, 1), (0.1000001, 0), (1.0, 1)], "c double, y int")
    b = {r["bin"]: r for r in CA.calibration_bins(df, F.col("c"), F.col("y") == 1).collect()}
    assert set(b) == {0, 1, 9} and b[0]["count"] == 1 and b[9]["accuracy"] == 1.0
    e = CA.calibration_errors(df, F.col("c"), F.col("y") == 1).first()
    assert e["ece"] == pytest.approx((0.9 + 0.1000001 + 0.0) / 4) and e["mce"] == pytest.approx(0.9)
    empty = spark.createDataFrame([], "s double, id long")
    assert CA.conformal_threshold(empty, "s", "id").first()[0] == pytest.approx(0.9)


def test_alert_rules_and_fingerprint(spark):
    pts = [("latency_p99", t * 60.0, v) for t, v in enumerate([900.0, 1100.0, 1200.0, 1300.0, 900.0, 1500.0])]
    df = spark.createDataFrame(pts, "metric string, sec double, value double")
    f = A.rule_for_duration(A.rule_eval(df), [], "sec").orderBy("sec").collect()
    assert [r["firing"] for r in f] == [False, False, False, True, False, False]
    life = A.alert_lifecycle(A.rule_for_duration(A.rule_eval(df), [], "sec"), [], "sec").collect()
    assert len(life) == 1 and life[0]["started_at"] == 180.0 and life[0]["resolved_at"] == 240.0
    import hashlib

    want = hashlib.md5(f"n|{sorted({'b': '2', 'a': '1'}.items())}".encode()).hexdigest()[:16]
    m = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert spark.range(1).select(A.fingerprint(F.lit("n"), m)).first()[0] == want


def test_silence_moves_the_last_sent_time(spark):
    rows = [("f", 0.0, 0, "alert"), ("f", 100.0, 1, "alert"), ("f", 200.0, 2, "silence"), ("f", 3700.0, 3, "alert"), ("f", 4000.0, 4, "alert"), ("f", 4150.0, 5, "alert"), ("g", 5.0, 6, "alert")]
    df = spark.createDataFrame(rows, "fingerprint string, sec double, seq long, action string")
    got = {r["seq"]: r["sent"] for r in A.alert_dedup_window(df).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_counter_reset(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "c", t0 + dt.timedelta(seconds=10 * i), v) for i, v in enumerate([5.0, 9.0, 2.0, 6.0])]
    df = spark.createDataFrame(rows, "event_id long, name string, ts timestamp, value double")
    r = TS.counter_rate(df, ["name"]).first()
    assert r["inc"] == 10.0 and r["rate"] == pytest.approx(10 / 30)
    assert TS.metric_rate(df.limit(1), ["name"]).first()["rate"] == 0.0


def test_augmentation_invariants(spark):
    df = texts(spark, "Good plans help us create a big show.", "one two three", "is " * 30)
    syn = column(df.select("id", AU.synonym(F.col("id"), F.col("t"), ratio=1.0).alias("x")))
    assert syn[0].split()[0] in {"Great", "Excellent", "Fine", "Nice"} and syn[0].endswith(".")
    assert syn[1] == "one two three"
    ins = column(df.select("id", AU.insert_fillers(F.col("id"), F.col("t")).alias("x")))
    assert len(ins[0].split()) == 9 and ins[0].split()[0] == "Good" and len(ins[2].split()) == 33
    dele = column(df.select("id", AU.delete_words(F.col("id"), F.col("t"), prob=0.9).alias("x")))
    assert dele[1] == "one two three" and dele[2].split() == ["is"] * 30
    swap = column(df.select("id", AU.swap_neighbours(F.col("id"), F.col("t")).alias("x")))
    assert sorted(swap[0].split()) == sorted("Good plans help us create a big show.".split())
    var = spark.range(1).select(AU.lexicon_variants(F.lit("a good use of good"))).first()[0]
    assert var == ["a good use of good", "a excellent use of good", "a great use of good", "a positive use of good"]


def test_generated_rows_and_weakness(spark):
    df = texts(spark, '[{"instruction": "a", "output": "b"}]', "broken [", "```json\n[{\"instruction\": \"c\"}]\n```")
    got = Y.parse_generated(df, "t", ["id"]).orderBy("id").collect()
    assert [(r["id"], r["instruction"], r["output"]) for r in got] == [(0, "a", "b"), (2, "c", "")]
    ids = spark.range(20).withColumnRenamed("id", "x")
    assert Y.template_rows(ids, "x", "analysis", "easy").count() == 0
    assert {r["expected"] for r in Y.from_weakness(ids, "x", "math_errors", "easy").collect()} == {"12", "7"}
    hard = Y.from_weakness(ids, "x", "factual_errors", "hard").collect()
    assert all(r["query"] != r["original"] for r in hard)


def test_records(spark):
    from plumbline.functions import records as R

    df = spark.createDataFrame([(1, ((2, "x"), 3))], "a int, b struct<c: struct<d: int, e: string>, f: int>")
    flat = R.flatten_struct(df)
    assert flat.columns == ["a", "b.c.d", "b.c.e", "b.f"]
    assert R.unflatten(flat).first() == df.first()
    assert spark.range(1).select(R.mask_key(F.lit("sk_1234567890"))).first()[0] == "sk_12345..."


def test_constants():
    assert A.DEFAULT_RULES[0].for_seconds == 120 and [r.metric for r in A.DEFAULT_RULES] == ["latency_p99", "error_rate", "quality_score", "gpu_memory_utilization"]
    assert sum(S.METRIC_WEIGHTS.values()) == pytest.approx(1.0)
    assert len(AU.SYNONYMS) == 14 and len(AU.FILLERS) == 10 and len(S.TOXIC) == 9 and len(Y.EDGE_CASES) == 8


def test_bounds_above_a_million_and_null_groups(spark):
    from plumbline.operators.splitting import balance_dataset
    from plumbline.operators.timeseries import histogram_quantile

    b = spark.createDataFrame([("s", "1000000", 5), ("s", "2000000.0", 9), ("s", "+Inf", 10)], "k string, le string, cumulative_count long")
    assert histogram_quantile(b, ["k"], 0.5).first().quantile == 1_000_000
    rows = spark.range(30).selectExpr("id", "if(id < 20, null, 'x') g")
    assert {r.g: r["count"] for r in balance_dataset(rows, "g", "id").groupBy("g").count().collect()} == {None: 10, "x": 10}


def test_long_texts_stay_whole(spark):
    from plumbline import flows
    from plumbline.operators import formatting as FM

    long = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, long + " a", long + " a"), (2, long + " b", long + " b"), (3, "", None)], "id long, instruction string, output string")
    got = {r.id: r for r in C.clean_example(df).collect()}
    assert got[1].output == long + " a" and got[3].output == ""
    assert sorted(r.id for r in flows.preprocess_batch(df, "id").collect()) == [1, 2]
    assert [len(r.output) for r in flows.preprocess_batch(df, "id", max_length=2048).collect()] == [2048]
    rows = FM.tokenize_pad(df, "output").orderBy("id", "piece").collect()
    assert [(r.id, r.piece, sum(r.attention_mask or [])) for r in rows] == [(i, p, 128 if p < 7 else 105) for i in (1, 2) for p in range(8)] + [(3, 0, 0)]
    assert all(len(r.input_ids) == 128 for r in rows[:16])
    assert len({x for r in rows[:8] for x in r.input_ids if x}) > 950 and rows[7].input_ids[104] != rows[15].input_ids[104]
