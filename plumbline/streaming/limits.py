"""Rate limits, caches and breakers as per-key state.

Each step function serves the batch form (`fold_rows`) and the stream form (`fold_stream`).
Rows carry `sec` (event time in seconds) and a unique `seq`.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans.folds import fold_rows, fold_stream, reset_segments
from plumbline.plans.jumps import greedy_marks
from plumbline.plans.ordering import null_safe_join

ORDER = ["sec", "seq"]
# Requests per 60 seconds and tokens per minute of each tier.
TIER_LIMITS = {"free": 10, "basic": 100, "pro": 1000, "enterprise": 10000}
TIER_TOKENS = {"free": 100_000, "pro": 500_000, "enterprise": 2_000_000}


# --- token bucket


def bucket_start() -> dict:
    return {"tokens": None, "last": None}


def bucket_step(rate: float, capacity: float, per: float):
    per_second = rate / per

    def step(st, row):
        tokens = capacity if st["last"] is None else min(capacity, st["tokens"] + (row.sec - st["last"]) * per_second)
        if tokens >= 1:
            return {"tokens": tokens - 1, "last": row.sec}, (True, int(tokens - 1), 0.0)
        return {"tokens": tokens, "last": row.sec}, (False, 0, (1 - tokens) / per_second)

    return step


BUCKET_OUT = "allowed boolean, remaining int, retry_after double"


def token_bucket(events: DataFrame, key: str, rate: float = 10.0, capacity: float = 100, per: float = 60.0) -> DataFrame:
    """A pause of capacity/rate refills the bucket, so the timeline is cut there."""
    cut = reset_segments(events, [key], "sec", capacity * per / rate)
    return fold_rows(cut, [key], ORDER, bucket_start, bucket_step(rate, capacity, per), BUCKET_OUT)


def token_bucket_stream(events: DataFrame, key: str, rate: float = 10.0, capacity: float = 100, per: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """In event time; the state of a key goes once its bucket is full again."""
    full = capacity * per / rate
    return fold_stream(events, [key], ORDER, bucket_start, bucket_step(rate, capacity, per), BUCKET_OUT, delay, lambda state: full)


# --- sliding window of sub-buckets


def window_start() -> dict:
    return {"counts": []}


def window_quota_step(precision: int):
    """State and rows are sub-buckets: how many of its arrivals fit, and how many fit before."""

    def step(st, row):
        live = [c for c in st["counts"] if c[0] > row.slot - precision]
        before = sum(c[1] for c in live)
        grant = int(min(row.n, max(0, row.limit_n - before)))
        return {"counts": [*live, [int(row.slot), grant]] if grant else live}, (int(before), grant)

    return step


def sliding_window_limit(events: DataFrame, keys: Sequence[str], limit: str, window: float = 60.0, precision: int = 10) -> DataFrame:
    """Allow while the last `precision` sub-buckets hold fewer than the limit (a column).

    Arrivals are counted per key and sub-bucket first; the sequential part sees one row per
    occupied sub-bucket, and an arrival's own rank inside its sub-bucket decides.
    """
    width = window / precision
    e = events.withColumn("slot", F.floor(F.col("sec") / F.lit(width)))
    per = e.groupBy(*keys, "slot", F.col(limit).alias("limit_n")).agg(F.count(F.lit(1)).alias("n"))
    cut = reset_segments(per, keys, "slot", precision)
    quota = fold_rows(cut, keys, ["slot"], window_start, window_quota_step(precision), "before long, granted long")
    rank = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(*ORDER))
    out = null_safe_join(e.withColumn("__r", rank), quota.select(*keys, "slot", "before", "granted"), [*keys, "slot"])
    ok = F.col("__r") <= F.col("granted")
    left = F.when(ok, F.col(limit) - F.col("before") - F.col("__r")).otherwise(0)
    return out.withColumns({"allowed": ok, "remaining": left.cast("bigint")}).drop("slot", "__r", "before", "granted")


def tiered_limit(events: DataFrame, tiers: DataFrame, key: str, limits: Mapping[str, int] = TIER_LIMITS, window: float = 60.0) -> DataFrame:
    """The sliding window with each user's tier limit; unknown users and tiers are free."""
    return sliding_window_limit(with_tier_limit(events, tiers, key, limits), [key], "limit_value", window).drop("limit_value")


def with_tier_limit(events: DataFrame, tiers: DataFrame, key: str, limits: Mapping[str, int]) -> DataFrame:
    t = F.coalesce(F.col("tier"), F.lit("free"))
    n = F.lit(limits["free"])
    for name, lim in limits.items():
        n = F.when(t == name, lim).otherwise(n)
    return events.join(tiers.select(key, "tier"), key, "left").withColumn("limit_value", n)


# --- exact trailing log


def log_start() -> dict:
    return {"log": []}


def log_step(limit: int, window: float):
    def step(st, row):
        log = [t for t in st["log"] if t > row.sec - window]
        if len(log) < limit:
            return {"log": [*log, row.sec]}, (True, limit - len(log) - 1, 0.0)
        return {"log": log}, (False, 0, max(0.0, log[0] + window - row.sec))

    return step


LOG_OUT = "allowed boolean, remaining int, retry_after double"


def sliding_log_limit(events: DataFrame, key: str, limit: int = 60, window: float = 60.0) -> DataFrame:
    cut = reset_segments(events, [key], "sec", window)
    return fold_rows(cut, [key], ORDER, log_start, log_step(limit, window), LOG_OUT)


def sliding_log_stream(events: DataFrame, key: str, limit: int = 60, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """In event time; the state of a key goes once its last row has left the window."""
    return fold_stream(events, [key], ORDER, log_start, log_step(limit, window), LOG_OUT, delay, lambda state: window)


# --- sliding window of sub-buckets as a stream


def slot_step(window: float, precision: int, limit: str | int):
    """Row by row: counts of allowed rows per sub-bucket of the last `precision` ones; `limit` is a number or a column."""
    width = window / precision

    def step(st, row):
        slot = math.floor(row.sec / width)
        most = limit if isinstance(limit, int) else int(getattr(row, limit))
        live = [c for c in st["counts"] if c[0] > slot - precision]
        total = sum(c[1] for c in live)
        if total >= most:
            return {"counts": live}, (False, 0)
        if live and live[-1][0] == slot:
            live[-1] = [slot, live[-1][1] + 1]
        else:
            live.append([slot, 1])
        return {"counts": live}, (True, most - total - 1)

    return step


def sliding_window_stream(events: DataFrame, keys: Sequence[str], limit: str | int, window: float = 60.0, precision: int = 10, delay: str = "10 minutes") -> DataFrame:
    """`sliding_window_limit` over a stream, in event time; state is one count per occupied sub-bucket of the window."""
    wait = window + window / precision
    return fold_stream(events, list(keys), ORDER, window_start, slot_step(window, precision, limit), "allowed boolean, remaining long", delay, lambda state: wait)


def tiered_stream(events: DataFrame, tiers: DataFrame, key: str, limits: Mapping[str, int] = TIER_LIMITS, window: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """`tiered_limit` over a stream: the tiers are a static table joined to each micro-batch."""
    return sliding_window_stream(with_tier_limit(events, tiers, key, limits), [key], "limit_value", window, delay=delay).drop("limit_value")


# --- response cache with a time to live


def cache_start() -> dict:
    return {"set": None}


def cache_step(ttl: float):
    def step(st, row):
        if st["set"] is not None and row.sec - st["set"] < ttl:
            return st, (True,)
        return {"set": row.sec}, (False,)

    return step


def ttl_cache_hits(events: DataFrame, key: str, ttl: float = 3600.0) -> DataFrame:
    """Hit while younger than the last miss plus ttl; a hit does not refresh the entry.

    The misses of a key are its first event and, from each miss, the first event `ttl` or more later. They are found by
    doubling jumps over all keys at once, so a key that never pauses is no task of its own.
    """
    return greedy_marks(events, [key], ORDER, ttl, "hit").withColumn("hit", ~F.col("hit"))


def ttl_cache_stream(events: DataFrame, key: str, ttl: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """In event time; the state of a key goes when its entry ends."""
    return fold_stream(events, [key], ORDER, cache_start, cache_step(ttl), "hit boolean", delay, lambda state: ttl)


# --- circuit breaker


def breaker_start() -> dict:
    return {"state": "closed", "failures": 0, "last": 0.0}


def breaker_step(threshold: int, recovery: float):
    def step(st, row):
        state = st["state"]
        if state == "open":
            if row.sec - st["last"] <= recovery:
                return st, (False, "open")
            state = "half-open"
        if row.success:
            return {"state": "closed", "failures": 0, "last": st["last"]}, (True, "closed")
        failures = st["failures"] + 1
        after = "open" if failures >= threshold else state
        return {"state": after, "failures": failures, "last": row.sec}, (True, after)

    return step


BREAKER_OUT = "proceeded boolean, state string"


def failure_breaker(events: DataFrame, service: str, threshold: int = 5, recovery: float = 60.0) -> DataFrame:
    """Whether each call went through and the state after it. A success after a pause longer than
    the recovery time closes the breaker whatever came before, so the timeline is cut there."""
    cut = reset_segments(events, [service], "sec", recovery, strict=True, reset_if=F.col("success"))
    return fold_rows(cut, [service], ORDER, breaker_start, breaker_step(threshold, recovery), BREAKER_OUT)


def breaker_stream(events: DataFrame, service: str, threshold: int = 5, recovery: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """In event time; the state of a service goes while it is closed without failures, which is how it starts."""
    fresh = lambda state: 0.0 if state["state"] == "closed" and not state["failures"] else None
    return fold_stream(events, [service], ORDER, breaker_start, breaker_step(threshold, recovery), BREAKER_OUT, delay, fresh)
