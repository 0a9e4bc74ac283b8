"""Series cut into blocks, and scoring with calls in flight, pauses and deadlines."""

import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import judge as J
from plumbline.operators import timeseries as TS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minute):
    return F.lit((T0 + timedelta(minutes=minute)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def series(spark, rows):
    made = [(n, None if m is None else T0 + timedelta(minutes=m), v) for n, m, v in rows]
    return spark.createDataFrame(made, "name string, ts timestamp, value double")


def joined(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (str(r.target), r.block)):
        got = json.loads(r.datapoints)
        assert len(got) == r.n <= 4 and r.block == len(out.setdefault(r.target, [])), r
        out[r.target].append(got)
    return {k: [p for block in v for p in block] for k, v in out.items()}


def test_blocks_in_order_are_the_series(spark):
    rows = [("hot", m, float(m % 7)) for m in range(0, 300, 2)] + [("gap", 3, 1.0), ("gap", 250, 2.0), (None, 5, 4.0)]
    points = series(spark, rows + [("hot", None, 9.0), ("void", 4, None), ("gap", 3, 2.0)])
    whole = {r.target: json.loads(r.datapoints) for r in TS.grafana_series(points.where("ts is not null and value is not null"), 60).collect()}
    got = joined(TS.grafana_blocks(points, 60, per_block=4))
    assert got == whole and set(got) == {"hot", "gap", None} and got["gap"][0][0] == 1.5
    part = joined(TS.grafana_blocks(points, 60, at(60), at(180), per_block=4))
    assert part == {"hot": whole["hot"][30:91]}  # both ends belong to the range
    assert TS.grafana_blocks(points.limit(0), 60).count() == 0


def test_time_range_of_a_series_reaches_the_scan(spark, sf):
    c = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-20")]
    for plan in (TS.grafana_series(B.metrics(spark, sf), 3600, *c), TS.grafana_blocks(B.metrics(spark, sf), 3600, *c)):
        text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "GreaterThanOrEqual(ts,2024-01-05" in text and "LessThanOrEqual(ts,2024-01-20" in text


def asked(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("q"), F.col("id")).alias("q"), F.concat(F.lit("r"), F.col("id")).alias("r")).coalesce(1)


def test_calls_in_flight_are_faster_and_keep_order(spark):
    def slow(q, r):
        time.sleep(0.05)
        if int(r[1:]) % 10 == 3:
            raise RuntimeError("no answer")
        return int(r[1:]) / 100

    def run(**k):
        t = time.perf_counter()
        rows = J.score_rows(asked(spark, 64), slow, "q", "r", retries=2, **k).collect()
        return time.perf_counter() - t, [tuple(x) for x in rows]

    run(in_flight=2)  # starts the worker
    one, want = run()
    eight, got = run(in_flight=8)
    assert got == want and [x[0] for x in got] == list(range(64))
    assert [x[4] for x in got[:5]] == ["judge", "judge", "judge", "fallback", "judge"] and got[3][3] == 0.5
    assert one > 3.2 and one / eight > 3


def test_pauses_deadlines_and_odd_input(spark):
    def sometimes(q, r):
        calls = sometimes.__dict__.setdefault("calls", {})
        calls[r] = calls.get(r, 0) + 1
        if calls[r] < 3:
            raise RuntimeError("busy")
        return 0.9

    marks = lambda fn, **k: [x["judge_model"] for x in J.score_rows(asked(spark, 2), fn, "q", "r", **k).collect()]
    assert marks(sometimes, backoff=0.01) == ["judge", "judge"]
    assert marks(sometimes, backoff=0.01, retries=2) == ["fallback", "fallback"]
    assert marks(sometimes, backoff=30.0, deadline=0.5) == ["fallback", "fallback"]  # the pause would pass the deadline

    def late(q, r):
        time.sleep(0.3)
        return 1.0

    assert marks(late, deadline=0.1) == ["fallback", "fallback"] and marks(late, deadline=5.0, in_flight=2) == ["judge", "judge"]
    empty = spark.createDataFrame([(None, None), ("q", "q")], "q string, r string")
    got = J.score_rows(empty, lambda q, r: len(r) / 2, "q", "r", in_flight=3).collect()
    assert sorted((x.judge_score, x.judge_model) for x in got) == [(0.5, "fallback"), (0.5, "judge")]
    assert J.score_rows(empty.limit(0), late, "q", "r", in_flight=3).count() == 0
    with pytest.raises(ValueError):
        J.score_rows(empty, late, "q", "r", in_flight=0)
