"""Stream folds keep what waits as sorted runs in bounded blocks of state and hand results on in bounded frames."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import types as T

from plumbline.plans import folds
from plumbline.streaming import limits as L
from plumbline.streaming import streams as S


class Cell:
    def __init__(self):
        self.rows = {}

    exists = lambda self: None in self.rows
    get = lambda self: self.rows[None]
    clear = lambda self: self.rows.clear()
    update = lambda self, v: self.rows.update({None: v})
    getValue = lambda self, k: self.rows[k]
    updateValue = lambda self, k, v: self.rows.update({k: v})
    removeKey = lambda self, k: self.rows.pop(k)


class Handle:
    """One key's state and timers, in memory."""

    def __init__(self):
        self.timers, self.now, self.at = set(), 0, 0

    getValueState = getMapState = lambda self, *a: Cell()
    registerTimer = lambda self, ms: self.timers.add(ms)
    getCurrentWatermarkInMs = lambda self: self.now
    getExpiryTimeInMs = lambda self: self.at

    def fire(self, fold, now):
        self.now = now
        while self.timers and min(self.timers) < now:
            self.at = min(self.timers)
            yield from fold.handleExpiredTimer(("k",), self, self)
            self.timers.remove(self.at)


def test_a_busy_key_is_merged_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(folds, "RUN", 300)
    monkeypatch.setattr(folds, "BLOCK", 20)
    monkeypatch.setattr(folds, "SMALL", 50)
    monkeypatch.setattr(folds, "FRAME", 70)
    out = T._parse_datatype_string("sec double, seq long, __null0 long, n int, __none0 boolean")
    step = lambda st, row: ({"n": st["n"] + 1}, (st["n"] + 1 if row.seq is not None else None,))
    fold = folds._EventTimeFold(["sec", "seq"], 4, [["seq"]], lambda: {"n": 0}, step, out, 1, [0, 1], 3, 0, lambda st: 5.0)
    handle, rng, got, given = Handle(), random.Random(1), [], []
    fold.init(handle)
    for batch in range(12):
        size = rng.choice([30, 1000])
        rows = [(rng.randrange(batch * 1000, batch * 1000 + 3000) / 10, batch * 10_000 + i) for i in range(size)]
        given += rows
        frames = [pd.DataFrame([(s, q, int(q % 7 == 0), int(s * 1000)) for s, q in rows[a : a + 40]]) for a in range(0, size, 40)]
        fold.handleInputRows(("k",), iter(frames), handle)
        assert max((len(v[0]) for v in fold.blocks.rows.values()), default=0) < 2000 and len(fold._load()["small"]) <= 50
        got += list(handle.fire(fold, batch * 100_000))
    got += list(handle.fire(fold, 10**7))
    assert max(map(len, got)) <= 70
    rows = [r for f in got for r in f.itertuples(index=False, name=None)]
    assert [(r[0], r[1]) for r in rows] == sorted(given)
    assert [r[3] for r in rows] == [None if r[1] % 7 == 0 else i + 1 for i, r in enumerate(rows)]
    assert not fold.blocks.rows and not fold.state.exists() and not handle.timers


def test_a_row_without_event_time_is_an_error(spark):
    out = T._parse_datatype_string("sec double, seq long, __null0 long, n int, __none0 boolean")
    fold = folds._EventTimeFold(["sec", "seq"], 4, [["seq"]], dict, None, out, 1, [0, 1], 3, 0, lambda st: None)
    fold.init(handle := Handle())
    with pytest.raises(ValueError, match="event time"):
        fold.handleInputRows(("k",), iter([pd.DataFrame([(1.0, 1, 0, 1000.0), (None, 2, 0, None)])]), handle)


def test_null_numbers_and_null_keys_come_through(spark, tmp_path):
    schema = "seq long, key long, sec double, success boolean, note string, x double"
    rows = [(2**60 + i, None if i % 3 else 2**55 + i % 2, i + 1.0, None if i % 5 == 0 else i % 2 == 0, None if i % 4 else "n", [None, float("nan"), 1.5][i % 3]) for i in range(30)]
    rows += [(None, 1, 50.0, True, "z", None), (None, None, 51.0, True, None, 1.0)]
    path = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    src = spark.readStream.schema(schema).parquet(path)
    got = S.run_to_files(L.sliding_log_stream(src, "key", 1000, 20.0, "0 seconds"), "nulls").collect()
    plain = lambda r: tuple("nan" if v != v else v for v in tuple(r)[:6])
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, rows)))
    left = {(r.key, r.sec): r.remaining for r in got}
    for seq, key, sec, *_ in rows:
        assert left[(key, sec)] == 1000 - sum(1 for r in rows if r[1] == key and sec - 20.0 < r[2] <= sec)
