"""Per-key sequential state, split at points where the state is known to start afresh.

Rows stream through Python in Arrow batches, sorted inside each partition, so no group is ever
held in memory. A key's timeline is first cut wherever a gap between two events is long enough
to reset the state; a heavy key thus becomes many independent pieces.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from plumbline.plans.ordering import null_safe_join

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a stream fold that are sorted at once, rows of a block of state, rows kept beside a key's state, rows of a result frame.
RUN, BLOCK, SMALL, FRAME = 65_536, 1_024, 512, 8_192


def reset_segments(
    df: DataFrame,
    keys: Sequence[str],
    seconds: str,
    horizon: float,
    strict: bool = False,
    reset_if: Column | None = None,
    name: str = "__seg",
) -> DataFrame:
    """Number the pieces of each key's timeline separated by gaps of at least `horizon` seconds.

    Events are first summarised per (key, slot of one horizon). A gap that long always crosses
    a slot edge, so first and last event per slot find every reset. The window runs over
    occupied slots only: its size follows the length of the timeline, not the traffic.
    """
    slot = F.floor(F.col(seconds) / F.lit(float(horizon)))
    starts_ok = F.min_by(reset_if if reset_if is not None else F.lit(True), F.col(seconds))
    occupied = df.groupBy(*keys, slot.alias("__slot")).agg(
        F.min(seconds).alias("__first"), F.max(seconds).alias("__last"), starts_ok.alias("__ok")
    )
    w = Window.partitionBy(*keys).orderBy("__slot")
    gap = F.col("__first") - F.lag("__last").over(w)
    fresh = gap.isNull() | (((gap > horizon) if strict else (gap >= horizon)) & F.col("__ok"))
    runs = occupied.withColumn("__new", fresh.cast("int")).select(
        *keys, "__slot", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name)
    )
    return null_safe_join(df.withColumn("__slot", slot), runs, [*keys, "__slot"]).drop("__slot")


def fold_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], dict],
    step: Callable, outputs: str, pieces: Sequence[str] = ("__seg",),
) -> DataFrame:
    """Run step(state, row) -> (state, output tuple) over each key's rows in order."""
    group = [*keys, *[p for p in pieces if p in df.columns]]
    extra = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    names = extra.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name="Row"):
                key = tuple(getattr(row, g) if not g.startswith("_") else row[pdf.columns.get_loc(g)] for g in group)
                key = tuple(None if v != v else v for v in key)  # nulls of one key are one key
                if key != current:
                    current, state = key, start()
                state, out = step(state, row)
                rows.append(out)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    ready = df.repartition(*group).sortWithinPartitions(*group, *order)
    return ready.mapInPandas(run, schema).drop(*[p for p in pieces if p in df.columns])


class _EventTimeFold(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them in order.

    What waits is kept as sorted runs, cut into blocks of `BLOCK` rows that are state entries of their own; up to `SMALL` rows
    stay beside the fold's state. A timer merges the runs block by block and hands results on in frames, so a task holds one
    run that is being sorted, or one block per run. One timer stands at the earliest row that waits, or where an idle key's
    state is worth a fresh one and goes.
    """

    def __init__(self, names: Sequence[str], used: int, masks: Sequence[Sequence[str]], start: Callable, step: Callable, out: T.StructType, outputs: int, order: Sequence[int], ms: int, sec: int, expires: Callable):
        self.names, self.used, self.masks, self.start, self.step, self.out, self.outputs = names, used, masks, start, step, out, outputs
        self.order, self.ms, self.sec, self.expires = order, ms, sec, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary")
        self.blocks = handle.getMapState("blocks", "run int, block int", "data binary")
        self.key = itemgetter(*self.order) if len(self.order) > 1 else lambda r: (r[self.order[0]],)
        self.view = type("Row", (tuple,), {name: property(itemgetter(i)) for i, name in enumerate(self.names)})
        self.bits = [(self.names.index(c), m, 1 << i) for m, group in enumerate(self.masks, len(self.names)) for i, c in enumerate(group)]

    def _load(self) -> dict | None:
        stored = self.state.get() if self.state.exists() else None
        return pickle.loads(zlib.decompress(bytes(stored[0]))) if stored else None

    def _save(self, kept: dict) -> None:
        self.state.update((zlib.compress(pickle.dumps(kept), 1),))

    def _add_run(self, kept: dict, rows: list[tuple]) -> None:
        rows.sort(key=self.key)
        number = kept["next"]
        blocks = range(0, len(rows), BLOCK)
        for i, a in enumerate(blocks):
            self.blocks.updateValue((number, i), (zlib.compress(pickle.dumps(list(zip(*rows[a : a + BLOCK]))), 1),))
        kept["next"] = number + 1
        kept["runs"].append({"run": number, "block": 0, "blocks": len(blocks), "at": 0, "head": self.key(rows[0]), "ms": rows[0][self.ms]})

    def _wake(self, kept: dict, ms: int) -> None:
        if kept["timer"] is None or ms < kept["timer"]:
            self.handle.registerTimer(ms)
            kept["timer"] = ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._load() or {"state": None, "last": None, "small": [], "runs": [], "next": 0, "timer": None}
        new, kept["small"] = kept["small"], []
        first = None
        for frame in rows:
            if frame.iloc[:, self.ms].isna().any():
                raise ValueError("a row without event time")
            cols = [frame.iloc[:, i].tolist() for i in range(self.used)]
            first = min(cols[self.ms]) if first is None else min(first, min(cols[self.ms]))
            new.extend(zip(*cols))
            if len(new) >= RUN:
                self._add_run(kept, new)
                new = []
        if len(new) > SMALL:
            self._add_run(kept, new)
        else:
            kept["small"] = sorted(new, key=self.key)
        if first is not None:
            self._wake(kept, first - 1)
        self._save(kept)
        return iter(())

    def _rows(self, run: dict, small: list[tuple]) -> Iterator[tuple]:
        """The rows of a run from where it stands; a block leaves the state once it has been read through."""
        while run["block"] < run["blocks"]:
            at = (run["run"], run["block"])
            rows = small if run["run"] is None else list(zip(*pickle.loads(zlib.decompress(bytes(self.blocks.getValue(at)[0])))))
            for i in range(run["at"], len(rows)):
                run["at"] = i
                yield rows[i]
            if run["run"] is not None:
                self.blocks.removeKey(at)
            run["block"], run["at"] = run["block"] + 1, 0

    def _ready(self, kept: dict, now: int) -> Iterator[tuple]:
        """The rows up to `now` in order. A run is opened when the merge reaches its first row; `kept` is left with the rest."""
        small, runs = kept["small"], kept["runs"]
        if small:
            runs = [*runs, {"run": None, "block": 0, "blocks": 1, "at": 0, "head": self.key(small[0]), "ms": small[0][self.ms]}]
        heap = [(run["head"], i, None, None) for i, run in enumerate(runs) if run["ms"] <= now]
        heapq.heapify(heap)
        while heap:
            _, i, row, rest = heap[0]
            if row is None:
                rest = self._rows(runs[i], small)
                row = next(rest)
            if row[self.ms] > now:
                runs[i].update(head=self.key(row), ms=row[self.ms])
                heapq.heappop(heap)
                continue
            yield row
            row = next(rest, None)
            if row is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (self.key(row), i, row, rest))
        left = [run for run in runs if run["block"] < run["blocks"]]
        kept["runs"] = [run for run in left if run["run"] is not None]
        kept["small"] = next((small[run["at"] :] for run in left if run["run"] is None), [])

    def _seen(self, row: tuple):
        """The row as the step function sees it: numbers that came as null are None again."""
        if not any(row[len(self.names) : len(self.names) + len(self.masks)]):
            return self.view(row)
        plain = list(row)
        for i, mask, bit in self.bits:
            if row[mask] & bit:
                plain[i] = None
        return self.view(plain)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows))
        cols += [[x is None for x in c] for c in cols[len(cols) - self.outputs :]]
        stamp = (T.TimestampType, T.TimestampNTZType)
        return pd.DataFrame({f.name: pd.Series(list(c), dtype=None if isinstance(f.dataType, stamp) else object) for f, c in zip(self.out.fields, cols)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, kept = timerValues.getCurrentWatermarkInMs(), self._load()
        if kept is None:
            return
        if kept["timer"] is not None and kept["timer"] <= expiredTimerInfo.getExpiryTimeInMs():
            kept["timer"] = None
        state, last = (kept["state"], kept["last"]) if kept["last"] is not None else (self.start(), None)
        out, cut = [], len(self.names) + len(self.masks)
        for row in self._ready(kept, now):
            state, extra = self.step(state, self._seen(row))
            last = row[self.sec]
            out.append((*row[:cut], *extra))
            if len(out) >= FRAME:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        if last is not None:
            kept.update(state=state, last=float(last))
        waits = [*(run["ms"] for run in kept["runs"]), *(r[self.ms] for r in kept["small"][:1])]
        if waits:
            self._wake(kept, min(waits) - 1)
        elif last is not None and (wait := self.expires(state)) is not None:
            gone = math.ceil((last + wait) * 1000)
            if gone <= now:
                self.state.clear()
                return
            self._wake(kept, gone)
        self._save(kept)

    def close(self) -> None:
        pass


def _plain_key(df: DataFrame, name: str) -> Column:
    """A column as a group key that pandas keeps apart from null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(kind)  # one zero
    return c if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)) else c.cast("string")


def fold_stream(
    sdf: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], dict], step: Callable, outputs: str,
    delay: str = "10 minutes", expires: Callable[[dict], float | None] = lambda state: None, seconds: str = "sec",
) -> DataFrame:
    """The same step functions over a stream, in event time: files may come in any order within `delay`.

    A row is folded once the watermark (latest event time less `delay`) has reached it; rows that come later than that are
    dropped and counted by the engine (`numRowsDroppedByWatermark`, see `run_counted`). `order` begins with the event time.
    `expires(state)` gives the seconds after a key's last row from which on its state equals a fresh one and is removed; None
    keeps it. Needs the RocksDB state store, which is set here for the session.
    """
    if order[0] != seconds:
        raise ValueError("the order begins with the event time")
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    extra = T._parse_datatype_string(outputs)
    real, whole = (T.FloatType, T.DoubleType), (T.IntegralType, T.BooleanType)
    marked = [f.name for f in sdf.schema.fields if isinstance(f.dataType, (*real, *whole, T.TimestampType, T.TimestampNTZType))]
    masks = [marked[i : i + 60] for i in range(0, len(marked), 60)]  # pandas can't tell null numbers: bits say which are
    bit = lambda m, i: F.col(f"__null{m}").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
    ms = F.ceil(F.col(seconds) * 1000).cast("bigint")
    fill = {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in sdf.schema.fields if isinstance(f.dataType, whole)}
    bits = [sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(g)), F.lit(0).cast("bigint")) for g in masks]
    timed = sdf.withColumn("__time", F.timestamp_millis(ms)).withWatermark("__time", delay).select(
        *[fill.get(c, F.col(c)).alias(c) for c in sdf.columns], *[b.alias(f"__null{m}") for m, b in enumerate(bits)],
        ms.alias("__ms"), "__time", *[_plain_key(sdf, k).alias(f"__key{i}") for i, k in enumerate(keys)],
    )
    at, n = timed.columns.index, len(sdf.columns) + len(masks)
    nones = [T.StructField(f"__none{i}", T.BooleanType()) for i in range(len(extra.fields))]
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in timed.schema.fields[:n]), *extra.fields, *nones])
    fold = _EventTimeFold(sdf.columns, n + 1, masks, start, step, out, len(extra.fields), [at(c) for c in order], at("__ms"), at(seconds), expires)
    done = timed.groupBy(*[f"__key{i}" for i in range(len(keys))]).transformWithStateInPandas(fold, out, "Append", "EventTime")

    def back(f: T.StructField, null: Column) -> Column:
        value = F.coalesce(F.col(f.name), F.lit(float("nan")).cast(f.dataType)) if isinstance(f.dataType, real) else F.col(f.name)
        return F.when(~null, value).alias(f.name)

    null = {c: bit(m, i) for m, group in enumerate(masks) for i, c in enumerate(group)}
    return done.select(
        *[back(f, null[f.name]) if f.name in null else F.col(f.name) for f in sdf.schema.fields],
        *[back(f, F.col(f"__none{i}")) for i, f in enumerate(extra.fields)],
    )


def affine_reverse_scan(
    df: DataFrame, keys: Sequence[str], pos: str, a: str, b: str, out: str, block: int = 128
) -> DataFrame:
    """value(t) = a(t) + b(t) * value(t+1) per key, with dense positions and 0 after the end.

    The recurrence composes, so blocks of bounded length are scanned on their own and their
    summaries are scanned the same way one level up; no key's history meets in one task.
    """
    top = df.agg(F.max(pos)).first()[0]
    return _affine_level(df, list(keys), pos, a, b, out, block, int(top or 0))


def _affine_level(df, keys, pos, a, b, out, block, top):
    blk = F.floor(F.col(pos) / block)
    items = F.sort_array(
        F.collect_list(F.struct(F.col(pos).alias("p"), F.col(a).alias("a"), F.col(b).alias("b"))), asc=False
    )
    seed = F.struct(
        F.array().cast("array<struct<p:bigint,a:double,b:double>>").alias("done"),
        F.lit(0.0).alias("a"),
        F.lit(1.0).alias("b"),
    )

    def add(acc, x):
        na, nb = x["a"] + x["b"] * acc["a"], x["b"] * acc["b"]
        item = F.struct(x["p"].cast("bigint").alias("p"), na.alias("a"), nb.alias("b"))
        return F.struct(F.concat(acc["done"], F.array(item)).alias("done"), na.alias("a"), nb.alias("b"))

    blocks = (
        df.groupBy(*keys, blk.alias("__blk"))
        .agg(items.alias("__items"))
        .withColumn("__s", F.aggregate("__items", seed, add))
        .drop("__items")
    )
    if top < block:
        carried = blocks.withColumn("__carry", F.lit(0.0))
    else:
        heads = blocks.select(*keys, "__blk", F.col("__s.a").alias("__a"), F.col("__s.b").alias("__b"))
        nxt = _affine_level(heads, keys, "__blk", "__a", "__b", "__carry", block, top // block)
        nxt = nxt.select(*keys, (F.col("__blk") - 1).alias("__blk"), "__carry")
        carried = null_safe_join(blocks, nxt, [*keys, "__blk"], "left").fillna(0.0, ["__carry"])
    vals = carried.select(*keys, "__carry", F.explode("__s.done").alias("__d")).select(
        *keys, F.col("__d.p").alias(pos), (F.col("__d.a") + F.col("__d.b") * F.col("__carry")).alias(out)
    )
    return null_safe_join(df, vals, [*keys, pos])
