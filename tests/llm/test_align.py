import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import align as A
from plumbline.llm.common import stored

SPEC, MODEL = A.vocabularies()
TOOLS = A.ByteLevel(SPEC), A.Pieces(MODEL)
SCHEMA = "doc_id long, text string, id string, pairs int, row int, groups int"


def plain(texts):
    """Groups and counts by walking tokens one by one."""
    per = []
    for t in texts:
        spans = []
        for tool in TOOLS if t else ():
            at, out = 0, []
            for i in tool.encode([t])[0]:
                out.append((at, at + len(tool.bytes[i]), i))
                at = out[-1][1]
            spans.append(out)
        if t and any(b"".join(tool.bytes[i] for i in tool.encode([t])[0]) != b" " + t.encode() for tool in TOOLS):
            spans = []
        a, b = spans or ([], [])
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if s >= lo and e <= hi) for side in (a, b)))
            lo = hi
        links = [(i, j) for s, e, i in a for x, y, j in b if s < y and x < e]
        per.append((len(a), len(b), ";".join(groups), links))
    docs = Counter(p for x in per for p in set(x[3]))
    best = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, g.count(";") + 1 if g else 0, len(k), sum(docs[p] == best[p[0]] for p in k), sum(docs[p] for p in k), g) for na, nb, g, k in per]


TEXTS = [
    None, "", " ", "a", "Hello, world!  Twice  spaced\n\n\ttabs", "<|endoftext|> and </s> <s> <0x41> are text", "a▁b", "Übergröße straße 中文字符 и кириллица 😀😀 ​\x00x",
    "x" * 700, "12345678901234567890" * 9, "Hello, world!  Twice  spaced\n\n\ttabs", "the cat sat on the mat. " * 40, "café ﬁn ½ …",
]


@pytest.mark.parametrize("max_sent", [4_000_000, 40, 0])
def test_against_plain_walk(spark, max_sent):
    rows = [(None if i == 3 else i, t, "x", 1, None, 2) for i, t in enumerate(TEXTS)]
    aligned = A.align_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), SPEC, MODEL)
    aligned = stored(aligned, "t")
    out = A.link_scores(aligned, stored(A.pair_counts(aligned), "t"), max_sent).collect()
    got = sorted((str(r.id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, plain(TEXTS)))


def test_texts_without_tokens_and_empty_table(spark):
    bad = spark.createDataFrame([(1,)], "doc_id int").selectExpr("doc_id", "cast(x'61ff62' as string) text").union(spark.createDataFrame([(2, "a▁b")], "doc_id int, text string"))
    got = A.align_tokens(bad, SPEC, MODEL).collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.pairs) for r in got] == [(0, 0, 0, 0, "", [])] * 2
    none = stored(A.align_tokens(spark.createDataFrame([], SCHEMA), SPEC, MODEL), "t")
    assert A.link_scores(none, stored(A.pair_counts(none), "t")).count() == 0


def test_very_long_text():
    rng = np.random.default_rng(1)
    text = " ".join("".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 12, 60_000))
    a, b = A._tokens(*TOOLS, [text.encode(), b"", b"short"])
    x = A.align(a, b, *[np.array([len(t) for t in tool.bytes]) for tool in TOOLS])
    ends = [np.cumsum([len(tool.bytes[i]) for i in side[0]]) for tool, side in zip(TOOLS, (a, b))]
    assert x.group_at.tolist()[1] == len(np.intersect1d(*ends)) and x.link_at[1] == len(np.union1d(*ends)) and x.group_at[1] == x.group_at[2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), max_size=5))
def test_cuts_are_the_common_ends(texts):
    ends, at = ([], []), ([0], [0])
    for n, pair in enumerate(texts):
        for side, cuts, own in zip(ends, at, pair):
            side += [61 * n + e for e in sorted(own | {61})]
            cuts.append(len(side))
    ea, eb, a_at, b_at = (np.array(x, np.int64) for x in (*ends, *at))
    assert A.shared_cuts(ea, eb, a_at, b_at).tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))


def test_both_encoders_agree(spark, sf):
    tool = TOOLS[0]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text] + [t for t in TEXTS if t]
    texts += ["".join(map(chr, range(i, i + 24))) + " x" for i in range(1, 0x530, 24)] + ["a\u00a0\u2003 b", " " * 99 + "y", "it's they'LL 'd"]
    assert tool.quick is not None
    assert tool.encode(texts) == [e.ids for e in tool.tool.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def test_query_digests(spark, sf):
    from plumbline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    docs = [r for r in docs if len(r.text or "") < 1500]
    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, sf).collect()}
    for r, w in zip(docs, plain([r.text for r in docs])):
        x = got[r.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links) == w[:4]
        assert x.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
