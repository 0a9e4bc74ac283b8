"""Cleaning, validation, deduplication, splitting and formatting queries."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.operators import cleaning as C
from plumbline.operators import dedup as DD
from plumbline.operators import formatting as FM
from plumbline.operators import splitting as SP
from plumbline.operators import validation as VA
from plumbline.plans.runtime import spread

W = B.with_ctes


def sq(text: str) -> str:
    return text.replace("'", "''")


def clean_sql(c: str, limit: int = 2048) -> str:
    t = f"nfc_normalize(coalesce({c},''))"
    t = f"regexp_replace({t}, 'https?://\\S+|www\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', '', 'g')"
    return f"substr(trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' '), 1, {limit})"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def html_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), ' ')"


def refusal_sql(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{sq(p)}')" for p in phrases) + ")"




def docs(spark, d):
    return spread(B.table(spark, d, "documents"))



@query("clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS digest, length({clean_sql('text')}) AS n FROM documents")
def _(spark, d):
    c = docs(spark, d).select("doc_id", C.clean_text("text", max_length=2048).alias("c"))
    return c.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


# the SQL above holds the first 2,048 characters; whole texts have a query of their own
_WHOLE = clean_sql("text", 1 << 30)


@query("clean_text_whole", f"SELECT doc_id, md5({_WHOLE}) AS digest, length({_WHOLE}) AS n FROM documents")
def _(spark, d):
    c = docs(spark, d).select("doc_id", C.clean_text("text").alias("c"))
    return c.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


@query("clean_example", W("samples", f"SELECT id, {clean_sql('instruction')} AS instruction, {clean_sql('input')} AS input, {clean_sql('output')} AS output FROM samples"))
def _(spark, d):
    return C.clean_example(B.samples(spark, d)).select("id", "instruction", "input", "output")


@query("strip_html_clean", f"SELECT page_id, md5({html_sql('html')}) AS digest, length({html_sql('html')}) AS n FROM pages")
def _(spark, d):
    p = spread(B.table(spark, d, "pages")).select("page_id", C.strip_html("html").alias("c"))
    return p.select("page_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


@query("filter_examples", W("samples", "SELECT id FROM samples WHERE instruction <> '' AND output <> '' AND length(output) BETWEEN 40 AND 600"))
def _(spark, d):
    return C.filter_examples(B.samples(spark, d), min_length=40, max_length=600).select("id")


@query("custom_filter", W("samples", "SELECT id FROM samples WHERE instruction <> '' AND output <> '' AND length(output) BETWEEN 10 AND 2048 AND adapter = 'code'"))
def _(spark, d):
    return C.filter_examples(B.samples(spark, d), custom=F.col("adapter") == "code").select("id")


@query(
    "content_filter",
    f"""SELECT doc_id FROM documents WHERE len({words_sql('text')}) >= 3 AND length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(text) <= 0.3e0 AND NOT regexp_matches(text, '@[a-z]+[.]')""",
)
def _(spark, d):
    return docs(spark, d).where(C.content_ok("text", blocked=["@[a-z]+[.]"])).select("doc_id")


_REASON = f"""CASE WHEN coalesce(instruction,'') = '' OR coalesce(output,'') = '' THEN 'missing_fields'
 WHEN length(instruction) < 10 OR length(instruction) > CASE WHEN adapter = 'code' THEN 400 ELSE 1000 END OR length(output) < 20 OR length(output) > 5000 THEN 'invalid_length'
 WHEN {refusal_sql('output', C.REFUSALS)} OR len({words_sql('output')}) < 5 THEN 'low_quality' END"""
_LIMITS = {"code": (10, 400, 20, 5000)}


@query("train_quality_filter", W("samples", f"SELECT id, {_REASON} AS reason FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", C.reject_reason(by_adapter=_LIMITS).alias("reason"))


@query(
    "validation_stats",
    W("samples", f""", r AS (SELECT {_REASON} AS r FROM samples) SELECT count(*) AS total, count(*) FILTER (WHERE r IS NULL) AS valid, count(*) FILTER (WHERE r='missing_fields') AS missing_fields,
 count(*) FILTER (WHERE r='invalid_length') AS invalid_length, count(*) FILTER (WHERE r='low_quality') AS low_quality FROM r"""),
)
def _(spark, d):
    return C.validation_stats(B.samples(spark, d), C.reject_reason(by_adapter=_LIMITS))


# --- deduplication


@query("dedup_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return DD.dedup_exact(docs(spark, d), ["text"], ["doc_id"]).select("doc_id")


@query("dedup_md5", W("samples", "SELECT min(id) AS id FROM samples GROUP BY md5(instruction || input || output)"))
def _(spark, d):
    return DD.dedup_md5(B.samples(spark, d), ["id"]).select("id")


# keep-first over all pairs: a row stays unless some earlier kept row is more similar than 0.9
_FUZZY = f""", t AS MATERIALIZED (SELECT doc_id, list_distinct({words_sql('lower(text)')}) AS s FROM documents),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.doc_id < b.doc_id AND least(len(a.s),len(b.s)) >= 0.9*greatest(len(a.s),len(b.s)) AND len(a.s) > 0
 WHERE len(list_intersect(a.s,b.s))::DOUBLE / (len(a.s)+len(b.s)-len(list_intersect(a.s,b.s))) > 0.9e0)"""


@query(
    "dedup_fuzzy",
    "WITH " + _FUZZY[2:] + """, n0 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p)),
n1 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p WHERE a IN (SELECT * FROM n0))),
n2 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p WHERE a IN (SELECT * FROM n1))),
n3 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p WHERE a IN (SELECT * FROM n2))),
n4 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p WHERE a IN (SELECT * FROM n3))),
n5 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM p WHERE a IN (SELECT * FROM n4))) SELECT doc_id FROM n5""",
)
def _(spark, d):
    return DD.dedup_fuzzy(docs(spark, d), "doc_id", "text").select("doc_id")


@query(
    "connected_components",
    "WITH RECURSIVE " + _FUZZY[2:] + """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""",
)
def _(spark, d):
    """Components of near-copy documents over all pairs above the threshold."""
    from plumbline.plans.graphs import connected_components

    return connected_components(DD.fuzzy_links(docs(spark, d), "doc_id", "text"), "a", "b")


@query(
    "duplicate_ratio",
    """WITH s AS (SELECT count(*) AS total, count(*) - count(DISTINCT text) AS duplicates FROM documents) SELECT *, duplicates/total AS ratio, duplicates/total > 0.05 AS warn FROM s""",
)
def _(spark, d):
    return VA.duplicate_ratio(docs(spark, d).select("text"))


# --- splits

_H = "md5(doc_id::VARCHAR || '|42')"
_RN = f"(SELECT *, row_number() OVER (ORDER BY {_H}) AS rn, count(*) OVER () AS n FROM documents)"


@query("split_train_val", f"SELECT doc_id, CASE WHEN rn <= floor(n*0.9e0) THEN 'train' ELSE 'validation' END AS split FROM {_RN}")
def _(spark, d):
    return SP.split_train_val(docs(spark, d).select("doc_id"), "doc_id")


@query("split_three_way", f"SELECT doc_id, CASE WHEN rn <= floor(n*0.8e0) THEN 'train' WHEN rn <= floor(n*0.8e0) + floor(n*0.1e0) THEN 'validation' ELSE 'test' END AS split FROM {_RN}")
def _(spark, d):
    return SP.split_three_way(docs(spark, d).select("doc_id"), "doc_id")


@query(
    "sample_per_group",
    W("samples", """, s AS (SELECT id, adapter FROM samples QUALIFY row_number() OVER (PARTITION BY adapter ORDER BY md5(id::VARCHAR || '|42')) <= 30),
r AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR || '|42')) AS rn, count(*) OVER () AS n FROM s)
SELECT id, adapter, CASE WHEN rn <= floor(n*0.8e0) THEN 'train' WHEN rn <= floor(n*0.8e0) + floor(n*0.1e0) THEN 'validation' ELSE 'test' END AS split FROM r"""),
)
def _(spark, d):
    s = SP.sample_per_group(B.samples(spark, d).select("id", "adapter"), "adapter", "id", 30)
    return SP.split_three_way(s, "id")


@query(
    "balance_dataset",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents),
g AS (SELECT DISTINCT lang, n FROM r WHERE n < 200), dr AS (SELECT lang, unnest(range(1, 200 - n + 1)) AS draw, n FROM g)
SELECT doc_id, lang, 0::BIGINT AS draw FROM r WHERE rk <= 200
UNION ALL SELECT r.doc_id, dr.lang, dr.draw FROM dr JOIN r ON r.lang = dr.lang AND r.rk = floor(('0x'||substr(md5(dr.lang || '|balance|' || dr.draw || '|42'),1,8))::BIGINT/4294967296e0 * dr.n)::BIGINT + 1""",
)
def _(spark, d):
    return SP.balance_dataset(docs(spark, d).select("doc_id", "lang"), "lang", "doc_id", 200, spread=16)


@query(
    "fan_out_by_config",
    """WITH f AS (SELECT doc_id, 'short' AS target FROM documents WHERE n_chars < 2000 UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en'),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn, count(*) OVER (PARTITION BY target) AS n FROM f)
SELECT doc_id, target, CASE WHEN rn <= floor(n*CASE target WHEN 'short' THEN 0.8e0 ELSE 0.7e0 END) THEN 'train'
 WHEN rn <= floor(n*CASE target WHEN 'short' THEN 0.8e0 ELSE 0.7e0 END) + floor(n*CASE target WHEN 'short' THEN 0.1e0 ELSE 0.2e0 END) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def _(spark, d):
    cfg = {"short": (F.col("n_chars") < 2000, 0.8, 0.1), "english": (F.col("lang") == "en", 0.7, 0.2)}
    return SP.fan_out_by_config(docs(spark, d), "doc_id", cfg).select("doc_id", "target", "split")


@query(
    "curriculum_order",
    W("samples", "SELECT id, complexity, row_number() OVER (ORDER BY CASE complexity WHEN 'easy' THEN 0 WHEN 'hard' THEN 2 ELSE 1 END, id) AS position FROM samples"),
)
def _(spark, d):
    return SP.curriculum_order(B.samples(spark, d).select("id", "complexity"), "complexity", "id")


@query(
    "train_fraction",
    f"SELECT doc_id, CASE WHEN rn <= floor(n*10/100) THEN 10 WHEN rn <= floor(n*25/100) THEN 25 WHEN rn <= floor(n*50/100) THEN 50 WHEN rn <= floor(n*75/100) THEN 75 ELSE 100 END::BIGINT AS fraction FROM {_RN}",
)
def _(spark, d):
    return SP.train_fraction(docs(spark, d).select("doc_id"), "doc_id")


@query("self_paced_subset", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE rn <= floor(n*0.5e0)")
def _(spark, d):
    return SP.self_paced_subset(B.table(spark, d, "events").select("event_id", "value"), "value", "event_id", 2)


@query(
    "dataset_stats",
    W("samples", "SELECT adapter AS source, count(*) AS count, avg(length(instruction)) AS avg_instruction_length, 'id,conv_id,instruction,input,output,adapter,complexity' AS fields FROM samples GROUP BY adapter"),
)
def _(spark, d):
    return SP.dataset_stats(B.samples(spark, d), F.col("adapter"))


# --- formats

_ALP = f"""CASE WHEN input <> '' THEN '{sq(FM.ALPACA_INPUT)}' ELSE '{sq(FM.ALPACA_PLAIN)}' END || '### Instruction:\n' || instruction || '\n\n' || CASE WHEN input <> '' THEN '### Input:\n' || input || '\n\n' ELSE '' END || '### Response:\n' || output"""
_CHAT = f"""'<|im_start|>system\n{FM.SYSTEM}<|im_end|>\n<|im_start|>user\n' || instruction || CASE WHEN input <> '' THEN '\n\n' || input ELSE '' END || '<|im_end|>\n<|im_start|>assistant\n' || output || '<|im_end|>'"""


@query("format_alpaca", W("samples", f"SELECT id, {_ALP} AS prompt FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", FM.format_alpaca().alias("prompt"))


@query("format_chatml", W("samples", f"SELECT id, {_CHAT} AS prompt FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", FM.format_chatml().alias("prompt"))


@query(
    "format_sharegpt",
    """SELECT conv_id, trim(string_agg(CASE role WHEN 'user' THEN 'Human: ' ELSE 'Assistant: ' END || text, '\n\n' ORDER BY turn), ' \n') AS formatted FROM conversations WHERE role IN ('user','assistant') GROUP BY conv_id""",
)
def _(spark, d):
    return FM.format_sharegpt(B.table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("format_plain", W("samples", "SELECT id, instruction || '\n\n' || input || '\n\nResponse: ' || output AS prompt, '### Instruction:\n' || instruction || '\n\n### Response:\n' || output AS short_prompt FROM samples"))
def _(spark, d):
    return B.samples(spark, d).select("id", FM.format_plain().alias("prompt"), FM.format_sft_short().alias("short_prompt"))


@query(
    "tokenize_pad",
    f"""WITH i AS (SELECT doc_id, list_transform({words_sql('text')}[1:128], lambda w: ('0x'||substr(md5(w),1,8))::BIGINT % 31999 + 1) AS ids FROM documents)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(128-len(ids)), lambda x: 0)), ' ') AS ids, len(ids) AS mask_sum FROM i""",
)
def _(spark, d):
    return _ids(FM.tokenize_pad(docs(spark, d).select("doc_id", "text"), "text", truncate=True), "doc_id")


def _ids(t, *keys):
    total = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint")
    return t.select(*keys, F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"), total.alias("mask_sum"))


@query(
    "tokenize_pieces",
    f"""WITH w AS (SELECT doc_id, {words_sql('text')} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(greatest((len(ws) + 127) // 128, 1)))::INT AS piece FROM w),
i AS (SELECT doc_id, piece, list_transform(ws[piece*128+1:piece*128+128], lambda w: ('0x'||substr(md5(w),1,8))::BIGINT % 31999 + 1) AS ids FROM p)
SELECT doc_id, piece, array_to_string(list_concat(ids, list_transform(range(128-len(ids)), lambda x: 0)), ' ') AS ids, len(ids) AS mask_sum FROM i""",
)
def _(spark, d):
    """All words of a text, in pieces of 128."""
    return _ids(FM.tokenize_pad(docs(spark, d).select("doc_id", "text"), "text"), "doc_id", "piece")
