"""Quality, safety and text-metric queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.curation import docs, refusal_sql, sq, words_sql
from plumbline.catalog.registry import query
from plumbline.operators import judge as J
from plumbline.operators import metrics as ME
from plumbline.operators import scoring as S

W = B.with_ctes


def io():
    return F.col("instruction"), F.col("output")


def n_of(c, phrases):
    return "(" + " + ".join(f"contains({c}, '{sq(p)}')::INT" for p in phrases) + ")"


def any_of(c, phrases):
    return "(" + " OR ".join(f"contains({c}, '{sq(p)}')" for p in phrases) + ")"


def wset(c, stop=()):
    s = f"list_distinct({words_sql(f'lower({c})')})"
    if stop:
        s = f"list_filter({s}, lambda x: x NOT IN ({','.join(repr(w) for w in stop)}))"
    return s


def pt(cond, v):
    return f"CASE WHEN {cond} THEN {v}e0 ELSE 0e0 END"


_IN, _ON = wset("instruction", S.RELEVANCE_STOP), wset("output", S.RELEVANCE_STOP)
_RUBRIC = f""", r0 AS (SELECT *, {_IN} AS iw, {_ON} AS ow, len({words_sql('output')}) AS n, lower(output) AS lo, lower(instruction) AS li, len(string_split(output,'.')) AS pc FROM samples),
r1 AS (SELECT id, least(greatest(1e0 - {pt('length(instruction) < 20', 0.3)} - {pt('length(instruction) > 500', 0.2)} + {pt("contains(instruction,'?') OR " + any_of('li', S.ACTION_VERBS), 0.1)},0),1) AS clarity,
 least(greatest(CASE WHEN n >= 50 THEN 0.4e0 WHEN n >= 20 THEN 0.2e0 ELSE 0e0 END + {pt(any_of('output', S.STRUCTURE_MARKS), 0.3)} + {pt(any_of('lo', S.CLOSINGS), 0.2)} + {pt("contains(lo,'example') OR contains(lo,'for instance')", 0.1)},0),1) AS completeness,
 least(greatest(1e0 - {n_of('lo', S.HEDGES_RUBRIC)}*0.1e0 - {pt("contains(lo,'however') AND contains(lo,'but') AND contains(lo,'although')", 0.2)},0),1) AS accuracy,
 CASE WHEN len(iw) = 0 THEN 0.5e0 ELSE least(1e0, len(list_intersect(iw,ow))/len(iw)*1.5e0) END AS relevance,
 least(greatest(1e0 - {pt('pc < 2', 0.3)} - {pt("list_sum(list_transform(string_split(output,'.'), lambda s: len(list_filter(string_split_regex(s,'[ \n]+'), lambda w: w <> '')))) / pc > 50", 0.2)},0),1) AS coherence FROM r0)
SELECT *, (clarity+completeness+accuracy+relevance+coherence)/5 AS overall FROM r1"""


@query("rubric_scores", W("samples", _RUBRIC))
def _(spark, d):
    r = S.rubric_scores(*io())
    base = B.samples(spark, d).select("id", *[r[k].alias(k) for k in ("clarity", "completeness", "accuracy", "relevance", "coherence")])
    return base.withColumn("overall", (F.col("clarity") + F.col("completeness") + F.col("accuracy") + F.col("relevance") + F.col("coherence")) / 5)


_LEN = """CASE WHEN lr < mn THEN lr/mn WHEN lr <= mx THEN 1e0 ELSE greatest(0e0, 1e0 - (lr-mx)/mx) END"""
_SPEC = f"""least(1e0, 0.5e0 + {pt("regexp_matches(output,'\\d+')", 0.1)} + {pt("regexp_matches(output,'\\b\\d{4}\\b')", 0.1)} + {pt("len(regexp_extract_all(output,'\\b[A-Z][a-z]+\\b')) > 3", 0.15)} + {pt(any_of('lower(output)', S.TECH_TERMS), 0.15)})"""
_STRU = f"""least(1e0, 0.5e0 + {pt("len(list_filter(string_split(output,'.'), lambda s: trim(s,' \n') <> '')) >= 2", 0.2)} + {pt("len(list_filter(string_split(output,'\n\n'), lambda s: trim(s,' \n') <> '')) >= 2", 0.15)} + {pt(any_of('output', S.LIST_MARKS), 0.15)})"""
_DIMS = f""", q0 AS (SELECT id, instruction, output, length(output) AS lr, CASE WHEN length(instruction) < 50 THEN 50 WHEN length(instruction) < 200 THEN 100 ELSE 200 END AS mn,
 CASE WHEN length(instruction) < 50 THEN 300 WHEN length(instruction) < 200 THEN 500 ELSE 1000 END AS mx FROM samples),
q1 AS (SELECT id, {_LEN} AS length, {_SPEC} AS specificity, {_STRU} AS structure FROM q0),
q2 AS (SELECT *, length*0.25e0 + specificity*0.35e0 + structure*0.4e0 AS overall, array_to_string(list_filter([CASE WHEN length < 0.3e0 THEN 'length' END, CASE WHEN specificity < 0.4e0 THEN 'specificity' END, CASE WHEN structure < 0.3e0 THEN 'structure' END], lambda z: z IS NOT NULL), ',') AS below_threshold FROM q1)
"""


def _dims(spark, d):
    return S.weighted_quality(B.samples(spark, d), S.default_dimensions(*io()))


@query("length_score", W("samples", _DIMS + "SELECT id, length AS score FROM q1"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.length_score(*io()).alias("score"))


@query("specificity_score", W("samples", _DIMS.replace("regexp_extract_all(output,'\\b[A-Z][a-z]+\\b')", "regexp_extract_all(regexp_replace(output,'[^\\x00-\\x7F]','_','g'),'\\b[A-Z][a-z]+\\b')") + "SELECT id, specificity AS score FROM q1"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.specificity_score(F.col("output")).alias("score"))


@query("structure_score", W("samples", _DIMS + "SELECT id, structure AS score FROM q1"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.structure_score(F.col("output")).alias("score"))


_DIMS_U = _DIMS.replace("regexp_extract_all(output,'\\b[A-Z][a-z]+\\b')", "regexp_extract_all(regexp_replace(output,'[^\\x00-\\x7F]','_','g'),'\\b[A-Z][a-z]+\\b')")


@query("weighted_quality", W("samples", _DIMS_U + "SELECT *, below_threshold = '' AS passed FROM q2"))
def _(spark, d):
    w = _dims(spark, d)
    return w.select("id", "length", "specificity", "structure", "overall", F.array_join("below_threshold", ",").alias("below_threshold"), "passed")


@query(
    "aggregate_quality",
    W("samples", _DIMS_U + """, u AS (UNPIVOT (SELECT id, length, specificity, structure, overall FROM q2) ON length, specificity, structure, overall INTO NAME dimension VALUE v)
SELECT dimension, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, (SELECT avg((below_threshold='')::INT::DOUBLE) FROM q2) AS pass_rate FROM u GROUP BY dimension"""),
)
def _(spark, d):
    return S.aggregate_quality(_dims(spark, d), ["length", "specificity", "structure", "overall"])


_COH = f"""least(1e0, 0.5e0 + {pt('length(output) > 20 AND length(output) < 2000', 0.1)} + {pt("contains(output,'.')", 0.1)} + 0.2e0*least(1e0, len(list_intersect({wset('instruction')},{wset('output')}))/greatest(len({wset('instruction')}),1)) + CASE WHEN {refusal_sql('output', S.FAILURE_PHRASES)} THEN 0e0 ELSE 0.2e0 END)"""
_EM = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"


def _safe(c):
    return f"""greatest(0e0, 1e0 - {n_of(f'lower({c})', S.TOXIC)}*0.15e0 - {pt(f"regexp_matches({c},'{_EM}')", 0.3)} - {pt(f"regexp_matches({c},'\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b')", 0.3)})"""


_FH = n_of("lower(output)", S.HEDGES_FACT)
_FACT = f"""least(1e0, 0.5e0 + CASE WHEN {_FH} BETWEEN 1 AND 3 THEN 0.2e0 WHEN {_FH} > 5 THEN -0.2e0 ELSE 0e0 END + {pt("regexp_matches(output,'\\d+')", 0.15)} + {pt("regexp_matches(output,'\\b\\d{4}\\b')", 0.15)})"""
_UNC = f"""least(1e0, {pt('length(output) < 50', 0.3)} + least(0.4e0, {n_of('lower(output)', S.HEDGES_UNSURE)}*0.1e0) + least(0.3e0, (length(output) - length(replace(output,'?','')))*0.1e0))"""


@query("coherence", W("samples", f"SELECT id, {_COH} AS coherence FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.coherence(*io()).alias("coherence"))


@query("relevance", W("vectors", "SELECT a.vec_id, (list_cosine_similarity(a.v,b.v)+1)/2 AS relevance FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"))
def _(spark, d):
    v = B.vectors(spark, d)
    j = v.select("vec_id", "v").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return j.select("vec_id", S.relevance(F.col("v"), F.col("w")).alias("relevance"))


@query("safety", f"SELECT doc_id, {_safe('text')} AS safety FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", S.safety(F.col("text")).alias("safety"))


@query("factuality_heuristic", W("samples", f"SELECT id, {_FACT} AS factuality FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.factuality_heuristic(F.col("output")).alias("factuality"))


@query(
    "factuality_reference",
    """WITH p AS (SELECT a.doc_id, a.text AS r, b.text AS t, (a.doc_id % 200 - 100)/100e0 AS sim FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
f AS (SELECT *, list_distinct(regexp_extract_all(r,'\\b\\d+\\.?\\d*\\b')) AS rf, list_distinct(regexp_extract_all(t,'\\b\\d+\\.?\\d*\\b')) AS tf FROM p)
SELECT doc_id, 0.7*(sim+1)/2 + 0.3*CASE WHEN len(tf) > 0 THEN len(list_intersect(rf,tf))/len(tf) ELSE 1 END AS factuality FROM f""",
)
def _(spark, d):
    x = docs(spark, d)
    j = x.select("doc_id", F.col("text").alias("r")).join(x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t")), "doc_id")
    sim = (F.col("doc_id") % 200 - 100) / 100.0
    return j.select("doc_id", S.factuality_reference(F.col("r"), F.col("t"), sim).alias("factuality"))


@query("text_uncertainty", W("samples", f"SELECT id, {_UNC} AS uncertainty FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", S.text_uncertainty(F.col("output")).alias("uncertainty"))


_SELF = f""", s0 AS (SELECT id, adapter, {_COH} AS coherence, {_safe('output')} AS safety, {_FACT} AS factuality, {_UNC} AS uncertainty, (id*7919 % 1000)/1000e0 AS judge FROM samples),
s1 AS (SELECT *, coherence AS relevance, round(0.6e0*(0.2e0*coherence + 0.3e0*coherence + 0.25e0*factuality + 0.15e0*safety + 0.1e0*(1-uncertainty)) + 0.4e0*judge, 12) AS overall_score FROM s0),
s2 AS (SELECT *, overall_score < 0.6e0 AS is_failure, least(coherence, factuality, safety) AS low FROM s1),
s3 AS (SELECT *, CASE WHEN NOT is_failure THEN NULL WHEN low < 0.3e0 THEN 'severe_' || CASE WHEN coherence = low THEN 'coherence' WHEN factuality = low THEN 'factuality' ELSE 'safety' END || '_failure'
 WHEN uncertainty > 0.7e0 THEN 'high_uncertainty' ELSE 'general_quality_issue' END AS failure_type FROM s2)
"""


def self_evaluated(spark, d):
    judge = (F.col("id") * 7919 % 1000) / 1000.0
    return S.self_eval(B.samples(spark, d), "instruction", "output", judge=judge)


@query("self_eval", W("samples", _SELF + "SELECT id, coherence, relevance, factuality, safety, uncertainty, overall_score, is_failure, failure_type, 1 - uncertainty AS confidence FROM s3"))
def _(spark, d):
    return self_evaluated(spark, d).select(
        "id", "coherence", "relevance", "factuality", "safety", "uncertainty", "overall_score", "is_failure", "failure_type", "confidence"
    )


_FT = """CASE WHEN least(a,b,c,s) < 0.3e0 THEN 'severe_' || CASE WHEN a = least(a,b,c,s) THEN 'coherence' WHEN b = least(a,b,c,s) THEN 'relevance' WHEN c = least(a,b,c,s) THEN 'factuality' ELSE 'safety' END || '_failure' WHEN u > 0.7e0 THEN 'high_uncertainty' ELSE 'general_quality_issue' END"""


@query(
    "failure_type",
    f"WITH x AS (SELECT event_id, (event_id % 10)/10e0 AS a, (event_id % 7)/7e0 AS b, (event_id % 11)/11e0 AS c, (event_id % 13)/13e0 AS s, (event_id % 17)/17e0 AS u FROM events) SELECT event_id, {_FT} AS failure_type FROM x",
)
def _(spark, d):
    m = lambda k: F.col("event_id") % k / float(k)
    return B.table(spark, d, "events").select("event_id", S.failure_type(m(10), m(7), m(11), m(13), m(17)).alias("failure_type"))


def failures(spark, d):
    v = B.vectors(spark, d)
    kind = F.element_at(F.array(F.lit("severe_relevance_failure"), F.lit("severe_safety_failure"), F.lit("high_uncertainty"), F.lit("general_quality_issue")), (F.col("vec_id") % 4 + 1).cast("int"))
    return v.select("vec_id", "v", "adapter", kind.alias("failure_type"), (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("score"))


EPS = 1.2
_CLUST = f""", pr AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_distance(a.v,b.v) <= {EPS}e0),
core AS MATERIALIZED (SELECT vec_id FROM vectors LEFT JOIN (SELECT a, count(*) AS k FROM pr GROUP BY a) ON a = vec_id WHERE 1 + coalesce(k,0) >= 5),
ce AS MATERIALIZED (SELECT a, b FROM pr WHERE a IN (FROM core) AND b IN (FROM core)),
rc AS (SELECT vec_id AS node, vec_id AS c FROM core UNION SELECT ce.b, rc.c FROM rc JOIN ce ON ce.a = rc.node),
cl AS (SELECT node, min(c) AS cluster FROM rc GROUP BY node), bd AS (SELECT a AS node, min(cluster) AS cluster FROM pr JOIN cl ON cl.node = pr.b WHERE a NOT IN (FROM core) GROUP BY a),
al AS (SELECT * FROM cl UNION ALL SELECT * FROM bd),
f AS (SELECT vec_id, adapter, ['severe_relevance_failure','severe_safety_failure','high_uncertainty','general_quality_issue'][CAST(vec_id % 4 AS INT)+1] AS ft, (vec_id*7919 % 1000)/1000e0 AS score FROM vectors),
j AS (SELECT * FROM al JOIN f ON f.vec_id = al.node),
ma AS (SELECT cluster, adapter FROM (SELECT cluster, adapter, count(*) AS n FROM j GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, adapter) = 1),
mf AS (SELECT cluster, ft FROM (SELECT cluster, ft, count(*) AS n FROM j GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, ft) = 1),
fc AS (SELECT cluster, count(*) AS size, avg(score) AS avg_score, any_value(ma.adapter) AS most_common_adapter, any_value(mf.ft) AS most_common_failure_type, CASE WHEN count(*) > 20 THEN 'high' ELSE 'medium' END AS severity FROM j JOIN ma USING (cluster) JOIN mf USING (cluster) GROUP BY cluster)
"""


@query("failure_clusters", W("vectors", _CLUST + "SELECT * FROM fc").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    return S.failure_clusters(failures(spark, d), "vec_id", "v", eps=EPS)


def _act_sql():
    out = "CASE"
    for k, v in S.ACTIONS.items():
        out += f" WHEN contains(most_common_failure_type,'{k}') THEN '{sq('; '.join(v))}'"
    return out + " ELSE '' END"


@query(
    "improvement_actions",
    W("vectors", f""", f AS (SELECT adapter, ['severe_relevance_failure','severe_safety_failure','high_uncertainty','general_quality_issue'][CAST(vec_id % 4 AS INT)+1] AS ft, label FROM vectors),
p AS (SELECT label AS cluster, mode(adapter) AS most_common_adapter, ft AS most_common_failure_type, CASE WHEN count(*) > 20 THEN 'high' ELSE 'medium' END AS severity FROM f GROUP BY label, ft)
SELECT cluster AS pattern_id, severity AS priority, most_common_adapter AS affected_adapter, most_common_failure_type AS failure_type, {_act_sql()} AS recommended_actions FROM p"""),
)
def _(spark, d):
    f = failures(spark, d).join(B.vectors(spark, d).select("vec_id", "label"), "vec_id")
    p = f.groupBy(F.col("label").alias("cluster"), F.col("failure_type").alias("most_common_failure_type")).agg(
        F.min("adapter").alias("most_common_adapter"), F.when(F.count(F.lit(1)) > 20, "high").otherwise("medium").alias("severity")
    )
    return S.improvement_actions(p).withColumn("recommended_actions", F.array_join("recommended_actions", "; "))


@query("custom_scorer")
def _(spark, d):
    """User function per row: share of the query's length, an error for short responses."""

    def fn(q, r):
        if len(r) < 40:
            raise ValueError("too short")
        return len(q) / len(r)

    return B.samples(spark, d).select("id", S.custom_scorer(fn, *io()).alias("score"))


# --- metrics


@query("exact_match", W("pairs", "SELECT avg((lower(trim(pred,' \n')) = lower(trim(CASE WHEN id % 3 = 0 THEN '  ' || pred || ' ' ELSE ref END,' \n')))::INT::DOUBLE) AS exact_match FROM pairs"))
def _(spark, d):
    p = B.pairs(spark, d).withColumn("ref", F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), "pred", F.lit(" "))).otherwise(F.col("ref")))
    return ME.exact_match(p)


_F1 = f""", s AS (SELECT {wset('pred')} AS p, {wset('ref')} AS r FROM pairs), o AS (SELECT len(p) AS np, len(r) AS nr, len(list_intersect(p,r)) AS o FROM s),
m AS (SELECT CASE WHEN np > 0 AND nr > 0 THEN o/np ELSE 0e0 END AS p, CASE WHEN np > 0 AND nr > 0 THEN o/nr ELSE 0e0 END AS r FROM o)
SELECT avg(p) AS precision, avg(r) AS recall, avg(CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0 END) AS f1 FROM m"""


@query("token_f1", W("pairs", _F1))
def _(spark, d):
    return ME.token_f1(B.pairs(spark, d))


def _grams(src, c, n):
    body = " || ' ' || ".join(f"w[i+{k}]" if k else "w[i]" for k in range(n))
    return f"SELECT id, '{c}' AS side, {n} AS n, unnest(list_transform(range(1, greatest(len(w)-{n - 1}+1,1)), lambda i: {body})) AS g FROM (SELECT id, {c} AS w FROM {src})"


_BLEU = f""", tk AS (SELECT id, {words_sql('pred')} AS pred, {words_sql('ref')} AS ref FROM pairs),
gr AS ({' UNION ALL '.join(_grams('tk', c, n) for c in ('pred', 'ref') for n in (1, 2, 3, 4))}),
gc AS (SELECT id, n, g, count(*) FILTER (side='pred') AS p, count(*) FILTER (side='ref') AS r FROM gr GROUP BY 1,2,3),
m AS (SELECT id, n, sum(least(p,r)) AS hit, sum(p) AS tot FROM gc GROUP BY 1,2),
x AS (SELECT tk.id, len(pred) AS pl, len(ref) AS rl, o.n, coalesce(hit,0) AS hit, greatest(coalesce(tot,0),1) AS tot FROM tk CROSS JOIN (SELECT unnest([1,2,3,4]) AS n) o LEFT JOIN m ON m.id = tk.id AND m.n = o.n),
sb AS (SELECT id, CASE WHEN max(hit) FILTER (n=1) = 0 THEN 0e0 ELSE CASE WHEN any_value(pl) > any_value(rl) THEN 1e0 ELSE exp(1-any_value(rl)/any_value(pl)) END * exp(avg(ln(CASE WHEN hit > 0 THEN hit::DOUBLE ELSE 0.1e0 END/tot))) END AS b FROM x GROUP BY id),
cb AS (SELECT n, sum(hit) AS hit, sum(tot) AS tot, sum(pl) AS pl, sum(rl) AS rl FROM x GROUP BY n)
"""
_BLEU_OUT = """SELECT CASE WHEN any_value(pl) > any_value(rl) THEN 1e0 ELSE exp(1-any_value(rl)/any_value(pl)) END * exp(avg(ln(CASE WHEN hit > 0 THEN hit::DOUBLE ELSE 0.1e0 END/tot))) AS bleu, (SELECT avg(b) FROM sb) AS bleu_mean, (SELECT stddev_pop(b) FROM sb) AS bleu_std FROM cb"""


@query("bleu", W("pairs", _BLEU + _BLEU_OUT))
def _(spark, d):
    return ME.bleu(B.pairs(spark, d))


_ROUGE = f""", rt AS (SELECT id, regexp_extract_all(lower(pred),'[a-z0-9]+') AS pred, regexp_extract_all(lower(ref),'[a-z0-9]+') AS ref FROM pairs),
rg AS ({' UNION ALL '.join(_grams('rt', c, n) for c in ('pred', 'ref') for n in (1, 2))}),
rc AS (SELECT id, n, g, count(*) FILTER (side='pred') AS p, count(*) FILTER (side='ref') AS r FROM rg GROUP BY 1,2,3),
rm AS (SELECT id, n, sum(least(p,r)) AS hit, sum(p) AS np, sum(r) AS nr FROM rc GROUP BY 1,2),
rs AS (SELECT n, CASE WHEN np > 0 THEN hit/np ELSE 0 END AS p, CASE WHEN nr > 0 THEN hit/nr ELSE 0 END AS r FROM rm),
rf AS (SELECT *, CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0 END AS f FROM rs), k AS (SELECT count(*) AS k FROM pairs)
"""
_ROUGE_OUT = "SELECT " + ", ".join(f"sum({k}) FILTER (n={n})/any_value(k) AS rouge{n}_{k}" for n in (1, 2) for k in "fpr") + " FROM rf, k"


@query("rouge_1_2", W("pairs", _ROUGE + _ROUGE_OUT))
def _(spark, d):
    return ME.rouge_n(B.pairs(spark, d))


@query("rouge_1_2_stems")
def _(spark, d):
    return ME.rouge_n(B.pairs(spark, d), stems=True)


@query("rouge_l")
def _(spark, d):
    return ME.rouge_l(B.pairs(spark, d))


@query("perplexity", "SELECT exp(-sum(-value)/sum(event_id % 50 + 1)) AS perplexity FROM events")
def _(spark, d):
    e = B.table(spark, d, "events").select((-F.col("value")).alias("ll"), (F.col("event_id") % 50 + 1).alias("n"))
    return ME.perplexity(e, "ll", "n")


@query(
    "distinct_n",
    f"""WITH w AS (SELECT {words_sql('text')} AS w FROM documents), u AS (SELECT unnest(w) AS g FROM w), b AS (SELECT unnest(list_transform(range(1, greatest(len(w),1)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM w)
SELECT (SELECT count(DISTINCT g)/count(*) FROM u) AS distinct_1, (SELECT count(DISTINCT g)/count(*) FROM b) AS distinct_2, (SELECT count(DISTINCT g) FROM u) AS unique_unigrams, (SELECT count(DISTINCT g) FROM b) AS unique_bigrams""",
)
def _(spark, d):
    return ME.distinct_n(docs(spark, d), "text")


@query("metrics_report")
def _(spark, d):
    return ME.metrics_report(B.pairs(spark, d))


@query(
    "win_rate",
    """WITH a AS (SELECT event_id, value AS s FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id - 1 AS event_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE value END AS s FROM events WHERE event_id % 2 = 1)
SELECT avg((a.s > b.s)::INT::DOUBLE) AS model_a_win_rate, avg((b.s > a.s)::INT::DOUBLE) AS model_b_win_rate, avg((a.s = b.s)::INT::DOUBLE) AS tie_rate FROM a JOIN b USING (event_id)""",
)
def _(spark, d):
    e = B.table(spark, d, "events")
    a = e.where("event_id % 2 = 0").select("event_id", "value")
    b = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("event_id"), F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(F.col("value")).alias("value"))
    return ME.win_rate(a, b, "event_id", "value")


# --- judge

_CRIT = "".join(J._criterion(c) for c in J.DEFAULT_CRITERIA)
_JP = f"""'You are an expert evaluator of AI responses. Your task is to evaluate the following response to a query based on specific criteria.\n\nQUERY:\n' || instruction || '\n\nRESPONSE:\n' || output || '\n\nEVALUATION CRITERIA:\n{sq(_CRIT)}\n\nPlease provide:\n1. A score from 1-10 for each criterion\n2. Brief feedback for each criterion\n3. An overall score (weighted average)\n4. Overall reasoning\n\nRespond in JSON format:\n{{\n    "scores": {{"criterion_name": score, ...}},\n    "feedback": {{"criterion_name": "feedback text", ...}},\n    "overall_score": score,\n    "reasoning": "overall assessment"\n}}\n'"""


@query("judge_prompt", W("samples", f"SELECT id, md5({_JP}) AS digest, length({_JP}) AS n FROM samples"))
def _(spark, d):
    p = B.samples(spark, d).select("id", J.judge_prompt(*io()).alias("p"))
    return p.select("id", F.md5("p").alias("digest"), F.length("p").cast("bigint").alias("n"))


def answers(spark, d):
    """Judge answers as text: JSON, JSON inside prose, broken text."""
    e = B.table(spark, d, "events")
    s = (F.col("event_id") % 10).cast("string")
    js = F.concat(F.lit('{"scores": {"relevance": '), s, F.lit(', "safety": 7}, "feedback": {"relevance": "ok"}, "overall_score": '), s, F.lit(', "reasoning": "r'), s, F.lit('"}'))
    t = F.when(F.col("event_id") % 3 == 0, js).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n"), js, F.lit("\nDone"))).otherwise(F.concat(F.lit("Overall: "), s, F.lit(".5")))
    return e.select("event_id", t.alias("t"))


@query(
    "judge_parse",
    """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (event_id % 10)/10e0 ELSE 0.5e0 END AS overall, CASE WHEN event_id % 3 < 2 THEN (event_id % 10)::DOUBLE END AS relevance,
 CASE WHEN event_id % 3 < 2 THEN 'r' || event_id % 10 ELSE '' END AS reasoning, CASE WHEN event_id % 3 = 2 THEN (event_id % 10 + 0.5e0)/10e0 ELSE 0.5e0 END AS rating FROM events""",
)
def _(spark, d):
    a = answers(spark, d).withColumn("r", J.judge_parse(F.col("t")))
    rel = F.try_element_at("r.scores", F.lit("relevance"))
    return a.select("event_id", "r.overall", rel.alias("relevance"), "r.reasoning", J.rating_parse(F.col("t")).alias("rating"))


@query(
    "judge_cache_reuse",
    W("samples", """, k AS (SELECT id, md5(instruction || '|' || output || '|[''coherence'', ''helpfulness'', ''relevance'']') AS key FROM samples)
SELECT id, key, id % 4 = 0 AS reused FROM k"""),
)
def _(spark, d):
    k = B.samples(spark, d).select("id", J.cache_key(*io(), J.DEFAULT_CRITERIA).alias("key"))
    cache = k.where("id % 4 = 0").select("key").distinct()
    hit, todo = J.judge_cache_reuse(k, cache, "key")
    return hit.select("id", "key", F.lit(True).alias("reused")).union(todo.select("id", "key", F.lit(False)))


@query(
    "score_rows",
    W("samples", "SELECT id, CASE WHEN coalesce(length(output) % 5, 0) = 0 THEN 0.5e0 ELSE least(1e0, length(output)/1000e0) END AS judge_score, CASE WHEN coalesce(length(output) % 5, 0) = 0 THEN 'fallback' ELSE 'judge' END AS judge_model FROM samples"),
)
def _(spark, d):
    def fn(q, r):
        if len(r) % 5 == 0:
            raise RuntimeError("no answer")
        return min(1.0, len(r) / 1000)

    return J.score_rows(B.samples(spark, d).select("id", "instruction", "output"), fn, "instruction", "output", in_flight=4).select("id", "judge_score", "judge_model")


_JL = """WITH l AS (SELECT event_id // 4 AS item, event_id % 4 AS judge_no, ['a','b','c','d'][CAST(event_id % 4 AS INT)+1] AS judge, value/100 AS score, event_type AS feedback FROM events WHERE event_id % 9 <> 0),
w AS (SELECT * FROM (VALUES ('a',0.4e0),('b',0.3e0),('c',0.2e0),('d',0.1e0)) t(judge,w)) """


def judged(spark, d):
    e = B.table(spark, d, "events").where("event_id % 9 <> 0")
    name = F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.floor(F.col("event_id") / 4).alias("item"), (F.col("event_id") % 4).alias("judge_no"), name.alias("judge"),
        F.lit("quality").alias("criterion"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("feedback"),
    )


@query("judge_ensemble", _JL + "SELECT item, 'quality' AS criterion, sum(score*w) AS score, string_agg(feedback, ' | ' ORDER BY judge_no) AS feedback FROM l JOIN w USING (judge) GROUP BY item")
def _(spark, d):
    return J.judge_ensemble(judged(spark, d), {"a": 4, "b": 3, "c": 2, "d": 1})


@query("judge_ensemble_overall", _JL + "SELECT item, sum(score*w) AS overall, string_agg(judge || ': ' || feedback, ' | ' ORDER BY judge_no) AS reasoning FROM l JOIN w USING (judge) GROUP BY item")
def _(spark, d):
    r = judged(spark, d).select("item", "judge_no", "judge", F.col("score").alias("overall"), F.col("feedback").alias("reasoning"))
    return J.ensemble_overall(r, {"a": 4, "b": 3, "c": 2, "d": 1})
