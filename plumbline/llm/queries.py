"""The corpus operators with production parameters over the whole given tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * size) AS DOUBLE) AS squares,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2, 1][CAST((nth - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS lim FROM per
), share AS (
  SELECT max(CAST(left_words AS DOUBLE) / left_weight) AS share FROM (
    SELECT sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
      sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM w)
), t AS (
  SELECT *, least(share * weight, CAST(lim AS DOUBLE)) AS target FROM w, share
), p AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS INT) AS copies FROM t
), g AS (
  SELECT *, greatest(target - copies * source_size, 0) AS gap FROM p
), r0 AS (
  SELECT d.doc_id, g.nth, d.size, copies, gap,
    (u / (1 - u)) / (greatest(least(coalesce(gap / nullif(squares, 0), 0) * size, 1 - 1e-9::DOUBLE), 1e-12::DOUBLE) / (1 - greatest(least(coalesce(gap / nullif(squares, 0), 0) * size, 1 - 1e-9::DOUBLE), 1e-12::DOUBLE))) AS rank,
    g.source_size, g.target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), a1 AS (
  SELECT *, size > 0 AND size <= gap AND sum(CASE WHEN size <= gap THEN size ELSE 0 END) OVER (PARTITION BY nth ORDER BY rank RANGE UNBOUNDED PRECEDING) <= gap AS c1 FROM r0
), r1 AS (
  SELECT *, gap - coalesce(sum(CASE WHEN c1 THEN size END) OVER (PARTITION BY nth), 0) AS gap1 FROM a1
), a2 AS (
  SELECT *, NOT c1 AND size > 0 AND size <= gap1 AND sum(CASE WHEN NOT c1 AND size <= gap1 THEN size ELSE 0 END) OVER (PARTITION BY nth ORDER BY rank RANGE UNBOUNDED PRECEDING) <= gap1 AS c2 FROM r1
), r2 AS (
  SELECT *, gap1 - coalesce(sum(CASE WHEN c2 THEN size END) OVER (PARTITION BY nth), 0) AS gap2 FROM a2
), a3 AS (
  SELECT *, NOT c1 AND NOT c2 AND size > 0 AND size <= gap2 AND sum(CASE WHEN NOT c1 AND NOT c2 AND size <= gap2 THEN size ELSE 0 END) OVER (PARTITION BY nth ORDER BY rank RANGE UNBOUNDED PRECEDING) <= gap2 AS c3 FROM r2
)
SELECT doc_id, size, source_size, target, CAST(copies + CASE WHEN c1 OR c2 OR c3 THEN 1 ELSE 0 END AS INT) AS repeats,
  CAST(size * (copies + CASE WHEN c1 OR c2 OR c3 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a3
"""


@query("op2_source_mix", OP2_SQL)
def _(spark, d):
    from plumbline.llm.mixing import mix_sources

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "repeats", "taken")


@query("op4_toxicity")
def _(spark, d):
    from plumbline.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").where(crc_mod("doc_id", 4) != 2).select("doc_id", "toxic")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), own AS (
  SELECT h, min(doc_id) AS low FROM win GROUP BY h
), hit AS (
  SELECT win.doc_id, list(win.i) AS starts FROM win JOIN own USING (h) WHERE win.doc_id > own.low GROUP BY win.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS i FROM hit)) GROUP BY doc_id
), word AS (
  SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t FROM word
  LEFT JOIN (SELECT doc_id, unnest(p) AS i FROM gone) g ON g.doc_id = word.doc_id AND g.i = word.i
  WHERE g.i IS NULL GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", OP9_SQL)
def _(spark, d):
    from plumbline.llm.substrings import normal_text, remove_repeats

    out = remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(normal_text(F.col("text")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT md5(string_agg(h, '' ORDER BY h)) AS f, doc_id FROM s GROUP BY doc_id
), head AS (
  SELECT f, min(doc_id) AS doc_id FROM sets GROUP BY f
), hs AS (
  SELECT s.* FROM s JOIN head USING (doc_id)
), e AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM hs a JOIN hs b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2) p
  JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)
  UNION SELECT head.doc_id, sets.doc_id FROM sets JOIN head USING (f) WHERE sets.doc_id > head.doc_id
), both_ways AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), reach AS (
  SELECT x AS doc_id, x AS r FROM both_ways UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.doc_id
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op5_jaccard_join", OP5_SQL)
def _(spark, d):
    from plumbline.llm.jaccard import similar_groups

    return similar_groups(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def _template_sql(table_name: str, key: str) -> str:
    from plumbline.llm.decontaminate import DROPPED, SPACE, UNITS

    quoted = "'" + DROPPED.replace("'", "''") + "'"
    space = " || ".join(f"chr({ord(c)})" for c in SPACE)
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
  SELECT {key}, list_transform(range(1, len(w) + 1), lambda i: struct_pack(core := rtrim(w[i], '.,!?:'), prev := CASE WHEN i > 1 THEN w[i - 1] END)) AS w
  FROM (SELECT {key}, list_filter(string_split(translate(coalesce(text, ''), {space} || {quoted}, '     '), ' '), lambda x: x <> '') AS w FROM {table_name})
), {table_name}_k AS (
  SELECT {key}, list_transform(w, lambda x: struct_pack(core := x.core, kind := CASE
    WHEN x.core >= '0' AND x.core <= '9~' THEN '<1>'
    WHEN lower(x.core) IN ({units}) AND x.prev >= '0' AND x.prev <= '9~' THEN '<2>'
    WHEN lower(x.core) <> x.core AND x.prev IS NOT NULL AND right(x.prev, 1) NOT IN ('.', '!', '?', ':') AND regexp_full_match(x.core, '\\p{{Lu}}\\p{{Ll}}+') THEN '<3>' END)) AS w FROM {table_name}_w
), {table_name}_t AS (
  SELECT {key}, list_transform(w, lambda x: coalesce(x.kind, lower(x.core))) AS t, list_transform(w, lambda x: CASE WHEN x.kind IS NULL THEN NULL ELSE x.core END) AS v FROM {table_name}_k
), {table_name}_x AS (
  SELECT {key}, t[i:i + n - 1] AS t, list_filter(v[i:i + n - 1], lambda x: x IS NOT NULL) AS f, n
  FROM (SELECT {key}, t, v, n, unnest(range(1, greatest(len(t) - n + 2, 1))) AS i FROM {table_name}_t, {table_name}_n)
), {table_name}_p AS (
  SELECT DISTINCT {key}, n, array_to_string(t, ' ') AS t, CASE WHEN len(f) > 1 THEN list_transform(f, lambda x: list_position(f, x)) ELSE [] END AS p
  FROM {table_name}_x WHERE n - len(f) >= least(6, n)
)"""


OP10_SQL = f"""
WITH benchmark_w AS ({_template_sql("benchmark", "item_id").replace("FROM benchmark_t, benchmark_n", "FROM (SELECT *, least(len(t), 10) AS n FROM benchmark_t WHERE len(t) > 0)")},
documents_n AS (SELECT DISTINCT n FROM benchmark_p),
documents_w AS ({_template_sql("documents", "doc_id")},
m AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item
  FROM documents_p d JOIN benchmark_p b ON d.n = b.n AND d.t = b.t AND d.p = b.p GROUP BY doc_id
)
SELECT documents.doc_id, m.doc_id IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, first_item
FROM documents LEFT JOIN m USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def _(spark, d):
    from plumbline.llm.decontaminate import flag_contaminated

    docs = table(spark, d, "documents").select("doc_id", "text")
    return flag_contaminated(docs, table(spark, d, "benchmark")).select("doc_id", "contaminated", "n_items", "first_item")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT x AS vec_id, x AS r FROM l UNION SELECT l.y, reach.r FROM reach JOIN l ON l.x = reach.vec_id
), c AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op1_embedding_dedup", OP1_SQL)
def _(spark, d):
    from plumbline.llm.embeddings import similar_vectors

    out = similar_vectors(table(spark, d, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op8_chat_format", OP8_SQL)
def _(spark, d):
    from plumbline.llm.chat import format_chats, read_back, records_from_turns

    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_back(format_chats(records_from_turns(rows)), "conv_id")


@query("op7_language_id")
def _(spark, d):
    from plumbline.llm.langid import fit_languages, predict_languages

    docs = table(spark, d, "documents")
    model = fit_languages(docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    out = predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op6_html_text")
def _(spark, d):
    from plumbline.llm.html import extract_text

    out = extract_text(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op3_katz_score")
def _(spark, d):
    from plumbline.llm.katz import katz_scores

    return katz_scores(table(spark, d, "documents"), crc_mod("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")


@query("op11_token_alignment")
def _(spark, d):
    from plumbline.llm.align import align_tokens, link_scores, pair_counts, vocabularies
    from plumbline.llm.common import stored

    aligned = align_tokens(table(spark, d, "documents"), *vocabularies())
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = stored(aligned.withColumn("groups_sha256", sha).drop("groups"), "aligned")
    out = link_scores(aligned, stored(pair_counts(aligned), "aligned-counts"))
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _centroid_sql(rounds: int = 3) -> str:
    near = """SELECT id, v, m.cluster, m.distance FROM (SELECT k.id, any_value(k.v) AS v, min(struct_pack(
    distance := CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT), cluster := c.cluster)) AS m FROM k, c{r} c GROUP BY k.id)"""
    steps = "".join(
        f"""), a{r} AS (
  {near.format(r=r)}
), c{r + 1} AS (
  SELECT c{r}.cluster, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r}) GROUP BY cluster, i
    ) GROUP BY cluster) n USING (cluster)
"""
        for r in range(rounds)
    )
    return f"""
WITH k AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS INT) AS cluster, v FROM k QUALIFY cluster < 16
{steps}), a AS (
  {near.format(r=rounds)}
)
SELECT id AS vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.cluster = a.cluster
"""


@query("op12_centroid_clusters", _centroid_sql())
def _(spark, d):
    from plumbline.llm.centroids import assign_clusters, cluster_inertia, fit_centroids, integer_vectors, per_cluster

    rows = integer_vectors(table(spark, d, "embeddings"))
    centroids = fit_centroids(rows)
    per = cluster_inertia(rows, centroids)
    out = assign_clusters(rows, centroids)
    sha = {i: ",".join(map(str, c)) for i, c in enumerate(centroids)}
    return out.select(
        F.col("id").alias("vec_id"), "cluster", "distance", per_cluster(per, "bigint").alias("cluster_inertia"), F.lit(str(sum(per.values()))).try_cast("bigint").alias("inertia"),
        F.sha2(per_cluster(sha, "string").cast("binary"), 256).alias("centroid_sha256"),
    )


@query("op13_nearest_neighbours")
def _(spark, d):
    from plumbline.llm.neighbours import nearest_by_inner_product

    out = nearest_by_inner_product(table(spark, d, "embeddings"), "id % 20 = 0", k=20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
