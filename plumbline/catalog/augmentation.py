"""Augmentation and synthetic-row queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.curation import sq, words_sql
from plumbline.catalog.registry import query
from plumbline.catalog.scoring import self_evaluated, wset
from plumbline.operators import augment as A
from plumbline.operators import scoring as S
from plumbline.operators import synthesis as Y

W = B.with_ctes

# the given texts hold no lexicon words, so each gets a sentence that does
LEAD = "Good plans help. Please show me how to use it, "
_T = f", tx AS (SELECT id, '{LEAD}' || instruction AS t FROM samples) "


def texts(spark, d):
    return B.samples(spark, d).select("id", F.concat(F.lit(LEAD), "instruction").alias("t"))


def u_sql(row, op, i="0"):
    return f"('0x'||substr(md5(concat_ws('|', {row}::VARCHAR, '{op}', ({i})::VARCHAR, '42')),1,8))::BIGINT/4294967296e0"


def pick_sql(row, op, n, i="0"):
    return f"floor({u_sql(row, op, i)} * ({n}))::INT"


def list_sql(values):
    return "[" + ",".join("'" + sq(v) + "'" for v in values) + "]"


def _both(fn):
    def run(spark, d):
        return texts(spark, d).select("id", fn(F.col("id"), F.col("t")).alias("text"))

    return run


_BARE = "trim(lower({w}), '.,!?;:')"
_KEYS = list_sql(A.SYNONYMS)
_LEX = "MAP {" + ",".join(f"'{k}': {list_sql(v)}" for k, v in A.SYNONYMS.items()) + "}"
_SYN = f"""{_T}, w AS (SELECT id, {words_sql('t')} AS w FROM tx), x AS (SELECT id, i, w[i+1] AS word, len(w) AS n, {_BARE.format(w='w[i+1]')} AS bare, {u_sql('id', 'syn', 'i')} AS u FROM w, range(100000) r(i) WHERE i < len(w)),
c AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY u, i) <= greatest(1, floor(n*0.1e0)) AS hit FROM x WHERE list_contains({_KEYS}, bare)),
o AS (SELECT x.id, x.i, word, hit, ({_LEX}[bare])[floor({u_sql('x.id', 'synpick', 'x.i')} * len({_LEX}[bare]))::INT + 1] AS syn FROM x LEFT JOIN c ON c.id = x.id AND c.i = x.i)
SELECT id, string_agg(CASE WHEN hit THEN CASE WHEN regexp_matches(word, '^[A-Z]') THEN upper(syn[1]) || substr(syn,2) ELSE syn END || CASE WHEN right(word,1) IN ('.',',','!','?',';',':') THEN right(word,1) ELSE '' END ELSE word END, ' ' ORDER BY i) AS text FROM o GROUP BY id"""

query("aug_synonym", W("samples", _SYN))(_both(A.synonym))
query("aug_insert")(_both(A.insert_fillers))
query(
    "aug_delete",
    W("samples", _T + f""", w AS (SELECT id, t, {words_sql('t')} AS w FROM tx), k AS (SELECT id, t, w, list_transform(list_filter(range(len(w)), lambda i: list_contains({list_sql(A.PROTECTED)}, {_BARE.format(w='w[i+1]')}) OR {u_sql('id', 'del', 'i')} > 0.1e0), lambda i: w[i+1]) AS l FROM w)
SELECT id, CASE WHEN len(w) <= 3 OR len(l) < len(w)*0.5e0 THEN t ELSE array_to_string(l, ' ') END AS text FROM k"""),
)(_both(A.delete_words))
query("aug_swap")(_both(A.swap_neighbours))


@query("aug_case", W("samples", _T + f"SELECT id, md5(lower(t)) AS lo, CASE WHEN {pick_sql('id', 'case', '2')} = 0 THEN lower(t) END AS rnd FROM tx"))
def _(spark, d):
    t = texts(spark, d)
    made = A.change_case(F.col("id"), F.col("t"))
    return t.select("id", F.md5(A.change_case(F.col("id"), F.col("t"), mode="lower")).alias("lo"), F.when(made == F.lower("t"), made).alias("rnd"))


_VAR = "MAP {" + ",".join(f"'{k}': {list_sql(v)}" for k, v in A.VARIANTS.items()) + "}"


@query(
    "aug_lexicon_variants",
    W("samples", _T + f""", w AS (SELECT id, t, list_filter({words_sql('t')}, lambda x: list_contains({list_sql(A.VARIANTS)}, lower(x)))[1] AS h FROM tx)
SELECT id, array_to_string(list_concat([t], CASE WHEN h IS NULL THEN [] ELSE list_transform({_VAR}[lower(h)], lambda s: substr(t,1,instr(t,h)-1) || s || substr(t,instr(t,h)+length(h))) END), '##') AS variants FROM w"""),
)
def _(spark, d):
    return texts(spark, d).select("id", F.array_join(A.lexicon_variants(F.col("t")), "##").alias("variants"))


@query("augment_dataset")
def _(spark, d):
    return A.augment_dataset(texts(spark, d), "id", "t").select("id", "copy", "augmentation", "confidence", F.col("t").alias("text"))


@query("custom_strategy", W("samples", _T + "SELECT id, 1 AS copy, 'shout' AS augmentation, md5(upper(replace(t, 'ß', 's'))) AS digest FROM tx"))
def _(spark, d):
    A.register_strategy("shout", lambda row_id, text, copy: F.upper(F.replace(text, F.lit("ß"), F.lit("s"))))
    a = A.augment_dataset(texts(spark, d), "id", "t", 1, ["shout"], include_original=False)
    return a.select("id", "copy", "augmentation", F.md5("t").alias("digest"))


_HEADS = list_sql([t.split("{action}")[0] for t in A.REPHRASE])
_PRE = "|".join(sq(p) for p in A.PREFIXES)


@query(
    "rephrase_instruction",
    W("samples", f"""SELECT id, copy::INT AS copy, {_HEADS}[{pick_sql('id', 'rephrase', '7', 'copy')} + 1] || regexp_replace(lower(CASE WHEN id % 2 = 0 THEN 'Please ' ELSE '' END || instruction), '^({_PRE})', '') AS instruction FROM samples, range(1,3) r(copy)"""),
)
def _(spark, d):
    s = B.samples(spark, d).select("id", F.concat(F.when(F.col("id") % 2 == 0, "Please ").otherwise(""), "instruction").alias("instruction"))
    return A.instruction_versions(s, "id", 2).select("id", "copy", "instruction")


for _name, _fn in Y.PERTURBATIONS.items():
    _sql = None
    if _name in ("paraphrase", "complexity"):
        _op, _pairs = ("para", Y.PARAPHRASES) if _name == "paraphrase" else ("complex", Y.COMPLEXITY)
        _k = f"[{pick_sql('id', _op, str(len(_pairs)))} + 1]"
        _sql = W("samples", _T + f"SELECT id, {list_sql([p[0] for p in _pairs])}{_k} || t || {list_sql([p[1] for p in _pairs])}{_k} AS text FROM tx")
    elif _name == "distractor":
        _sql = W("samples", _T + f"SELECT id, t || ' ' || {list_sql(Y.DISTRACTORS)}[{pick_sql('id', 'distract', '5')} + 1] || ' ' || {list_sql(Y.NOISE)}[{pick_sql('id', 'noise', '4')} + 1] AS text FROM tx")
    elif _name == "ambiguity":
        _sql = W("samples", _T + f", w AS (SELECT id, {words_sql('t')} AS w FROM tx), p AS (SELECT *, {pick_sql('id', 'ambpos', 'len(w)+1')} AS p FROM w) SELECT id, array_to_string(list_concat(w[1:p], [{list_sql(Y.AMBIGUITY)}[{pick_sql('id', 'ambword', '6')} + 1]], w[p+1:len(w)]), ' ') AS text FROM p")
    elif _name == "negation":
        _sql = W("samples", _T + f""", w AS (SELECT id, t, {words_sql('t')} AS w FROM tx), p AS (SELECT *, {pick_sql('id', 'negpos', 'greatest(1, len(w)-1)')} + 1 AS p, {u_sql('id', 'negcoin')} AS u FROM w)
SELECT id, CASE WHEN u > 0.5e0 THEN CASE WHEN contains(lower(t), 'not') THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[1:p], ['not'], w[p+1:len(w)]), ' ') END ELSE array_to_string(list_filter(w, lambda x: NOT list_contains({list_sql(Y.NEGATIONS)}, lower(x))), ' ') END AS text FROM p""")
    query(f"perturb_{_name}", _sql)(_both(_fn))


@query("perturb_compose")
def _(spark, d):
    p = Y.perturb_compose(texts(spark, d), "id", "t", 2)
    return p.select("id", F.array_join("applied", ",").alias("applied"), F.col("t").alias("text"))


def _ids(spark, d):
    return B.table(spark, d, "documents").select("doc_id")


_WK = Y.WEAKNESSES["math_errors"]


@query("from_weakness", f"SELECT doc_id, {list_sql([p[0] for p in _WK])}[k] AS query, {list_sql([p[1] for p in _WK])}[k] AS expected FROM (SELECT doc_id, {pick_sql('doc_id', 'weak', '2')} + 1 AS k FROM documents)")
def _(spark, d):
    return Y.from_weakness(_ids(spark, d), "doc_id", "math_errors", "easy").select("doc_id", "query", "expected")


@query("from_weakness_hard")
def _(spark, d):
    return Y.from_weakness(_ids(spark, d), "doc_id", "logic_errors", "hard")


@query("from_failures")
def _(spark, d):
    f = self_evaluated(spark, d).where("is_failure").select("id", F.col("instruction").alias("query"))
    return Y.from_failures(f, "id", "query").select("id", "copy", "query", "original_query", "expected_output", "target_weakness", "difficulty")


@query(
    "edge_cases",
    f"SELECT lang, no::INT AS no, {list_sql([q for q, _ in Y.EDGE_CASES])}[no+1] AS query, {list_sql([k for _, k in Y.EDGE_CASES])}[no+1] AS kind FROM (SELECT DISTINCT lang FROM documents), range(8) r(no)",
)
def _(spark, d):
    return Y.edge_cases(B.table(spark, d, "documents"), "lang")


@query("escalate")
def _(spark, d):
    s = B.samples(spark, d).select("id", F.col("instruction").alias("query"), F.col("complexity").alias("difficulty"), F.lit("template_based").alias("perturbation_type"))
    return Y.escalate(s, "id", "query")


_TPL = Y.TEMPLATES[("reasoning", "easy")]


def _fill_sql(text):
    for mark, options in Y.FILL.items():
        text = f"replace({text}, '{mark}', {list_sql(options)}[{pick_sql('doc_id', 'fill' + mark, str(len(options)))} + 1])"
    return f"replace({text}, '{{number}}', ({pick_sql('doc_id', 'fill{number}', '100')} + 1)::VARCHAR)"


def _tpl_sql(rows, level, src):
    k = f"[{pick_sql('doc_id', 'template', str(len(rows)))} + 1]"
    col = lambda j: f"{list_sql([r[j] for r in rows])}{k}"
    return f"SELECT doc_id, {col(0)} AS template_id, {_fill_sql(col(1))} AS instruction, {_fill_sql(col(2))} AS input, {col(3)} AS output, '{level}' AS difficulty FROM {src}"


@query("template_rows", _tpl_sql(_TPL, "easy", "documents"))
def _(spark, d):
    return Y.template_rows(_ids(spark, d), "doc_id", "reasoning", "easy")


_MIXED = "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents), t AS (" + " UNION ALL ".join(
    _tpl_sql(Y.TEMPLATES[("reasoning", lv)], lv, f"(SELECT doc_id FROM n WHERE {cond})")
    for lv, cond in (
        ("easy", "rn <= floor(n*0.3e0)"),
        ("medium", "rn > floor(n*0.3e0) AND rn <= floor(n*0.3e0) + floor(n*0.4e0)"),
        ("hard", "rn > floor(n*0.3e0) + floor(n*0.4e0) AND rn <= floor(n*0.3e0) + floor(n*0.4e0) + floor(n*0.3e0)"),
    )
) + ") SELECT *, row_number() OVER (ORDER BY CASE difficulty WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END, doc_id) AS position FROM t"


@query("curriculum_mix", _MIXED)
def _(spark, d):
    return Y.curriculum_mix(_ids(spark, d), "doc_id", "reasoning")


@query(
    "parse_generated",
    """SELECT event_id, p::INT AS pos, 'do ' || event_id || '-' || p AS instruction, '' AS input, CASE WHEN p = 0 THEN event_type ELSE '' END AS output FROM events, range(2) r(p) WHERE event_id % 3 < 2""",
)
def _(spark, d):
    e = B.table(spark, d, "events")
    i = F.col("event_id").cast("string")
    js = F.concat(F.lit('[{"instruction": "do '), i, F.lit('-0", "input": "", "output": "'), "event_type", F.lit('"}, {"instruction": "do '), i, F.lit('-1"}]'))
    t = F.when(F.col("event_id") % 3 == 0, js).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), js, F.lit("\n```\n"))).otherwise(F.substring(js, 1, 20))
    return Y.parse_generated(e.select("event_id", t.alias("t")), "t", ["event_id"])


_VS = f""", v AS (SELECT id, (CASE WHEN length(instruction) > 10 AND length(instruction) < 500 THEN 2 ELSE 0 END + CASE WHEN length(output) > 20 AND length(output) < 3000 THEN 2 ELSE 0 END
 + CASE WHEN len(list_intersect({wset('instruction', S.STOP_WORDS)}, {wset('output', S.STOP_WORDS)})) >= 2 THEN 3 ELSE 0 END
 + CASE WHEN NOT ({' OR '.join(f"contains(lower(output), '{sq(p)}')" for p in S.GENERIC)}) AND len(list_filter(string_split(output,'.'), lambda s: trim(s,' \n') <> '')) >= 1 THEN 3 ELSE 0 END)::INT AS tenths FROM samples)
SELECT id, tenths, tenths/10e0 AS validation_score FROM v WHERE tenths >= 5"""


@query("validate_synthetic", W("samples", _VS))
def _(spark, d):
    return Y.validate_synthetic(B.samples(spark, d), "id").select("id", "tenths", "validation_score")


@query("validate_synthetic_top", W("samples", _VS + " ORDER BY tenths DESC, id LIMIT 50"))
def _(spark, d):
    return Y.validate_synthetic(B.samples(spark, d), "id", 50).select("id", "tenths", "validation_score")


@query(
    "cross_model_agreement",
    """WITH v AS (SELECT event_id // 4 AS id, value > 20 AS valid FROM events WHERE event_id // 4 % 9 <> 0), a AS (SELECT id, avg(valid::INT::DOUBLE) AS agreement FROM v GROUP BY 1), x AS (SELECT DISTINCT event_id // 4 AS id FROM events)
SELECT id, agreement, coalesce(agreement >= 0.7e0, true) AS valid FROM x LEFT JOIN a USING (id)""",
)
def _(spark, d):
    e = B.table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("id"), (F.col("value") > 20).alias("valid"))
    return Y.cross_model_agreement(e.select("id").distinct(), e.where("id % 9 <> 0"), "id")
