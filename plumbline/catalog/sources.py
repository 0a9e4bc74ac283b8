"""Readers, writers and record functions over the given tables."""

from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.catalog.registry import query
from plumbline.functions import records as R
from plumbline.plans.runtime import scratch_path
from plumbline.sources import readers as RD
from plumbline.sources import writers as WR

W = B.with_ctes


@query("detect_format")
def _(spark, d):
    f = RD.object_inventory(spark, d, checksum=False).select("name")
    return f.withColumn("folder_format", F.lit(RD.detect_format(spark, d)))


@query("read_jsonl", "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def _(spark, d):
    path = scratch_path(spark, "jsonl")
    docs = B.table(spark, d, "documents")
    WR.write_jsonl(docs, path, split=None)
    r = RD.read_jsonl(spark, path, "doc_id bigint, text string, lang string, n_chars bigint")
    return r.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("read_json", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    """Orders as files that each hold one JSON array of about 1,000 objects, read back."""
    path = scratch_path(spark, "json-arrays")
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    files = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.to_json(F.collect_list(F.struct(*o.columns))).alias("value"))
    # one row per file of about 1,000 objects
    files.write.partitionBy("file").text(path)
    return RD.read_json(spark, path, o.schema)


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch_path(spark, "csv")
    c = B.table(spark, d, "customer")
    c.write.csv(path, header=True)
    return RD.read_csv(spark, path, c.schema)


@query("read_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def _(spark, d):
    return RD.load(spark, f"{d}/orders.parquet").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("stream_jsonl", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    from plumbline.streaming.streams import run_to_files

    path = scratch_path(spark, "stream-jsonl")
    B.table(spark, d, "events").select("event_id", "user_id", "event_type", "value").repartition(4).write.json(path)
    return run_to_files(RD.stream_jsonl(spark, path, "event_id bigint, user_id bigint, event_type string, value double"), "jsonl-out")


_SPLIT = """(SELECT doc_id, lang, CASE WHEN rn <= floor(n*0.8e0) THEN 'train' WHEN rn <= floor(n*0.8e0) + floor(n*0.1e0) THEN 'validation' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn, count(*) OVER () AS n FROM documents))"""


@query("read_split", f"SELECT doc_id, lang, split FROM {_SPLIT} WHERE split = 'validation'")
def _(spark, d):
    from plumbline.operators.splitting import split_three_way

    path = scratch_path(spark, "splits")
    split_three_way(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").write.partitionBy("split").parquet(path)
    return RD.read_split(spark, path, "validation")


@query("write_jsonl", f"SELECT split, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM {_SPLIT} GROUP BY split")
def _(spark, d):
    from plumbline.operators.splitting import split_three_way

    path = scratch_path(spark, "split-jsonl")
    WR.write_jsonl(split_three_way(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), path)
    back = spark.read.schema("doc_id bigint, lang string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))


@query("write_json_report", """SELECT '{"lang":"' || lang || '","rows":' || count(*) || '}' AS value FROM documents GROUP BY lang""")
def _(spark, d):
    path = scratch_path(spark, "report")
    WR.write_json_report(B.table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), path)
    return spark.read.text(path)


@query("append_event_log", "SELECT adapter, count(*) AS rows FROM (SELECT event_id, ['reasoning','code','creative','analysis'][CAST(event_id % 4 AS INT)+1] AS adapter FROM events WHERE event_type = 'error') GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "retrain-log")
    r = B.requests(spark, d).where(~F.col("success")).select("request_id", "adapter", F.lit("error").alias("reason"))
    for part in (0, 1):
        WR.append_event_log(r.where(F.col("request_id") % 2 == part), path)
    return spark.read.schema("request_id bigint, adapter string, reason string").json(path).groupBy("adapter").agg(F.count(F.lit(1)).alias("rows"))


@query("object_inventory")
def _(spark, d):
    return RD.object_inventory(spark, d).select("name", "size_bytes", "md5")


@query("batch_map")
def _(spark, d):
    """A batched user function over Arrow record batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.utf8_length(b.column("text"))], names=["doc_id", "n"])

    return B.table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n int")


# --- record functions


@query("hash_record", """SELECT event_id, substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'),1,16) AS h FROM events""")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", R.hash_record(["user_id", "event_type"]).alias("h"))


@query("mask_key", "SELECT c_custkey, substr(sha256(c_name),1,8) || '...' AS masked, sha256(sha256(c_name)) AS hashed FROM customer")
def _(spark, d):
    k = F.sha2("c_name", 256)
    return B.table(spark, d, "customer").select("c_custkey", R.mask_key(k).alias("masked"), R.hash_key(k).alias("hashed"))


@query("flatten_struct", """SELECT event_id AS "id", user_id AS "who.user", event_type AS "what.kind.name", value AS "what.value" FROM events""")
def _(spark, d):
    e = B.table(spark, d, "events")
    flat = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("who.user"), F.col("event_type").alias("what.kind.name"), F.col("value").alias("what.value"))
    return R.flatten_struct(R.unflatten(flat))
