"""Folds over streams in event time: files in any order, late rows, idle keys; greedy marks against a walk."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.operators import alerts as A
from plumbline.plans import ordering as O
from plumbline.streaming import limits as L
from plumbline.streaming import streams as S

SCHEMA = "seq long, key string, sec double, success boolean"
BATCH = {
    "bucket": (lambda e: L.token_bucket(e, "key", 20, 5, 60), lambda e, d: L.token_bucket_stream(e, "key", 20, 5, 60, d), ["allowed", "remaining", "retry_after"]),
    "log": (lambda e: L.sliding_log_limit(e, "key", 6, 60), lambda e, d: L.sliding_log_stream(e, "key", 6, 60, d), ["allowed", "remaining", "retry_after"]),
    "cache": (lambda e: L.ttl_cache_hits(e, "key", 100), lambda e, d: L.ttl_cache_stream(e, "key", 100, d), ["hit"]),
    "breaker": (lambda e: L.failure_breaker(e, "key", 3, 60), lambda e, d: L.breaker_stream(e, "key", 3, 60, d), ["proceeded", "state"]),
    "window": (lambda e: L.sliding_window_limit(e.withColumn("n", F.lit(4)), ["key"], "n", 60.0), lambda e, d: L.sliding_window_stream(e, ["key"], 4, 60.0, delay=d), ["allowed", "remaining"]),
}


def timeline(seed, n=500):
    rng, t, out = random.Random(seed), {"a": 0.0, "b": 0.0, None: 0.0}, []
    for i in range(n):
        k = "a" if i % 3 else rng.choice(["b", None])
        t[k] += rng.choice([0.5, 1.0, 5.0, 70.0, 200.0])
        out.append((i, k, t[k], rng.random() > 0.4))
    return sorted(out, key=lambda r: (r[2], r[0]))


def files(spark, parts, tmp):
    path = str(tmp / uuid.uuid4().hex)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


@pytest.mark.parametrize("name", sorted(BATCH))
def test_files_in_shuffled_order_give_the_batch_result(spark, tmp_path, name):
    rows = timeline(3)
    batch, stream, cols = BATCH[name]
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i in range(0, len(parts) - 1, 2):  # neighbours swapped, and rows inside a file shuffled
        parts[i], parts[i + 1] = parts[i + 1], parts[i]
    for p in parts:
        random.Random(5).shuffle(p)
    delay = max(r[2] for r in rows)
    src = files(spark, [*parts, [(10**6, "end", 3 * delay, True)]], tmp_path)
    got, late = S.run_counted(stream(src, f"{int(delay) + 1} seconds"), name)
    pick = lambda d: {r["seq"]: tuple(r[c] for c in cols) for r in d.collect() if r["key"] != "end"}
    want = pick(batch(spark.createDataFrame(rows, SCHEMA)))
    assert late == 0 and pick(got) == want and len(want) == len(rows)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    parts = [[(1, "a", 10.0, True), (2, "a", 100.0, True)], [(3, "a", 1000.0, True)], [(4, "a", 50.0, True), (5, "a", 1001.0, True)], [(6, "b", 9000.0, True)]]
    got, late = S.run_counted(L.sliding_log_stream(files(spark, parts, tmp_path), "key", 9, 60.0, "30 seconds"), "late")
    assert late == 1 and sorted(r.seq for r in got.collect()) == [1, 2, 3, 5]


def test_state_of_idle_keys_goes(spark, tmp_path):
    parts = [[(i, f"k{i}", 1.0 + i, True) for i in range(20)], [(100, "z", 10_000.0, True)], [(101, "z", 20_000.0, True)], [(102, "z", 20_001.0, True)]]
    sdf = L.ttl_cache_stream(files(spark, parts, tmp_path), "key", 60.0, "0 seconds")
    out = str(tmp_path / "out")
    q = sdf.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "state").load(out + "-state").collect()
    assert spark.read.parquet(out).count() == 23 and {r.key[0] for r in left} == {"z"}


def walk(rows, width, pause):
    out, sent = {}, {}
    for seq, key, sec, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "silence":
            sent[key], out[seq] = sec + pause, False
        else:
            out[seq] = key not in sent or sec - sent[key] >= width
            if out[seq]:
                sent[key] = sec
    return out


@pytest.mark.parametrize("width, pause", [(30.0, 100.0), (0.0, 10.0), (1000.0, 0.0)])
def test_alert_window_against_a_walk(spark, width, pause):
    rng = random.Random(int(width))
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(400)), "silence" if rng.random() < 0.05 else rng.choice(["alert", "alert", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, fingerprint string, sec double, action string")
    got = {r.seq: r.sent for r in A.alert_dedup_window(df, width, pause).collect()}
    assert got == walk(rows, width, pause) and len(set(got.values())) == 2
    assert A.alert_dedup_window(df.limit(0)).count() == 0


def test_one_busy_key_spreads_over_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    events = spark.range(0, 200_000, 1, 8).selectExpr("id seq", "'k' key", "id * 1.0D sec")
    out = L.ttl_cache_hits(events, "key", 50.0)
    assert out.where("not hit").count() == 4000 and out.where("not hit and seq % 50 <> 0").count() == 0
    per = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(per) == 8 and max(r["count"] for r in per) < 50_000


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_are_exact_beyond_the_sketch(spark, method):
    import numpy as np

    rng = np.random.default_rng(2)
    big = np.round(rng.lognormal(size=60_000), 3)
    rows = {"hot": big, "small": big[:7], "ties": np.repeat([1.0, 2.0, 3.0], 4000), "one": big[:1], None: big[:500], "nan": np.array([float("nan"), 1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in rows.items() for v in x] + [("none", None)], "k string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    got = {r.k: r for r in O.group_quantiles(df, ["k"], "v", probs, method=method).collect()}
    assert set(got) == {*rows, "none"} and got["none"].c is None
    for k, x in rows.items():
        if k == "nan":
            assert got[k].a == 1.0 and np.isnan(got[k].f)
            continue
        for n, p in probs.items():
            want = np.quantile(x, p) if method == "linear" else np.sort(x)[min(int(len(x) * p), len(x) - 1)]
            assert got[k][n] == pytest.approx(want, rel=1e-12), (k, n)
    total = O.group_quantiles(df.where("k = 'hot'"), [], "v", {"m": 0.5}, method=method).first().m
    assert total == pytest.approx(np.quantile(big, 0.5) if method == "linear" else np.sort(big)[30_000])


def test_points_of_one_second_have_one_order(spark):
    rows = [("a", float(s), bool(m), 0.0) for s in range(40) for m in (True, False, True)]
    got = set()
    for n in (1, 3, 7):
        df = spark.createDataFrame(rows, "rule string, sec double, met boolean, for_seconds double").repartition(n, "met", "sec")
        out = A.rule_for_duration(df, [], "sec").collect()
        got.add(tuple(sorted((r.sec, r.met, r.island, r.pending_since or -1.0, r.firing) for r in out)))
    assert len(got) == 1
