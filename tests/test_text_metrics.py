"""Metrics inside the row against plain counting, stems against published examples."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from plumbline.functions.stemming import porter_stem
from plumbline.operators import metrics as M

WORDS = "caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky".split()
STEMS = "caress poni cat feed agre plaster motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky".split()
MORE = {
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
}


def test_published_stems():
    assert [porter_stem(w) for w in WORDS] == STEMS
    assert {w: porter_stem(w) for w in MORE} == MORE


def grams(text, n):
    w = (text or "").split()
    return Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))


def texts(seed, n=60):
    rng = random.Random(seed)
    make = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(rng.choice("a b c dd running runs".split()) for _ in range(rng.randrange(1, 30)))
    return [(i, make(), make(), make()) for i in range(n)]


def test_counts_against_plain_bags_with_several_references(spark):
    rows = texts(3) + [(99, "x y " * 3000, "y x " * 2500, "")]
    df = spark.createDataFrame(rows, "id long, pred string, ref string, other string")
    refs = F.array(F.coalesce("ref", F.lit("")), F.coalesce("other", F.lit("")))
    got = {r.id: r for r in M.gram_matches(df, F.coalesce("pred", F.lit("")), refs, [1, 2, 4], ["id"]).collect()}
    for i, p, r, o in rows:
        for n in (1, 2, 4):
            bag, most = grams(p, n), grams(r, n) | grams(o, n)
            assert (got[i][f"h{n}"], got[i][f"t{n}"], got[i][f"r{n}"]) == (sum((bag & most).values()), sum(bag.values()), sum(most.values()))


@pytest.mark.parametrize("stems", [False, True])
def test_rouge_against_plain_counting(spark, stems):
    rows = texts(5)
    df = spark.createDataFrame(rows, "id long, pred string, ref string, other string")
    cut = lambda t: " ".join(porter_stem(w) if stems and len(w) > 3 else w for w in (t or "").split())
    want = {}
    for n in (1, 2):
        parts = []
        for _, p, r, _ in rows:
            a, b = grams(cut(p), n), grams(cut(r), n)
            hit = sum((a & b).values())
            pr, rc = hit / max(1, sum(a.values())), hit / max(1, sum(b.values()))
            parts.append((2 * pr * rc / (pr + rc) if hit else 0.0, pr, rc))
        want |= {f"rouge{n}_{k}": pytest.approx(sum(x[j] for x in parts) / len(rows)) for j, k in enumerate("fpr")}
    assert M.rouge_n(df, stems=stems).first().asDict() == want


def test_no_gram_is_shuffled(spark):
    df = spark.createDataFrame(texts(7), "id long, pred string, ref string, other string")
    for out in (M.bleu(df), M.rouge_n(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "hashpartitioning" not in plan


def test_distinct_grams_are_dealt_out_in_buckets(spark, monkeypatch):
    rng = random.Random(9)
    some = ["\u2003".join(rng.choice("a b é ï c\x00 dd ü-x 1".split(" ")) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " \x1c\n", "one"]
    want = {n: grams("", n) for n in (1, 2)}
    for t in some:
        for n in want:
            want[n] += grams(t, n)
    df = spark.createDataFrame([(t,) for t in some], "text string").repartition(5)
    got = M.distinct_n(df, "text")
    u, t = ({n: f(want[n]) for n in want} for f in (len, lambda c: sum(c.values())))
    assert [tuple(r) for r in got.collect()] == [(u[1] / t[1], u[2] / t[2], u[1], u[2])]
    assert got.dtypes == [("distinct_1", "double"), ("distinct_2", "double"), ("unique_unigrams", "bigint"), ("unique_bigrams", "bigint")]
    assert "Generate" not in got._jdf.queryExecution().toString()  # no gram is a row of its own
    assert [tuple(r) for r in M.distinct_n(df.where("text is null"), "text").collect()] == [(0.0, 0.0, 0, 0)]
    # many chunks in one task: a gram keeps its bucket
    monkeypatch.setattr(M, "GRAM_CHUNK", 200)
    made = pa.Table.from_batches(M._grams_in_buckets([pa.record_batch({"text": some[:100]}), pa.record_batch({"text": some[100:]})]))
    assert made.num_rows > 20 * M.GRAM_BUCKETS
    parts = [M._distinct_in_bucket(made.filter(pc.equal(made["bucket"], k))).to_pylist()[0] for k in range(M.GRAM_BUCKETS)]
    assert {c: sum(p[c] for p in parts) for c in parts[0]} == {"u1": u[1], "t1": t[1], "u2": u[2], "t2": t[2]}
