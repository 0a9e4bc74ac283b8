"""Greedy selections as orbits of a successor function, found by doubling jumps.

"Take the first event, then the first one at least w later, and so on" is a walk that no window can express. Every event's
successor is known without the walk, though: it is a rank found by one global sort. The walk's events are then marked in
a logarithmic number of joins, for all keys at once, and no key's timeline meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ordering import null_safe_join, prefix_sums, ranked
from plumbline.plans.runtime import checkpointed


def successors(events: DataFrame, keys: Sequence[str], rank: str, seconds: str, ready: Column, counts: Column | None = None) -> DataFrame:
    """`events` (keys, rank, seconds) plus __next: per event, one more than the number of counted events of its key before
    the moment `ready`. Events and moments are sorted together; a moment stands before the events at its own time."""
    counted = F.lit(1) if counts is None else counts.cast("int")
    at = events.select(*keys, F.col(seconds).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.col(rank).alias("__rank"), counted.cast("bigint").alias("__one"))
    ask = events.select(*keys, ready.cast("double").alias("__at"), F.lit(0).alias("__kind"), F.col(rank).alias("__rank"), F.lit(0).cast("bigint").alias("__one"))
    run = prefix_sums(at.union(ask), ["__at", "__kind", "__rank"], {"__before": F.col("__one")}, keys)
    return run.where("__kind = 0").select(*keys, F.col("__rank").alias(rank), (F.col("__before") + 1).alias("__next"))


def orbit(jumps: DataFrame, keys: Sequence[str], rank: str, longest: int) -> DataFrame:
    """(keys, rank) of the events reached from rank 1 of each key along (rank, __next), by doubling.

    After round i the marked events are those within 2^i jumps; `longest` bounds the number of jumps of a walk. A jump to a
    rank that doesn't exist ends the walk.
    """
    pair = [*keys, rank]
    jumps = checkpointed(jumps.select(*pair, "__next"))
    marked = jumps.where(F.col(rank) == 1).select(*pair)
    jumps = null_safe_join(jumps, jumps.select(*keys, F.col(rank).alias("__next")), [*keys, "__next"])
    for i in range(ceil(log2(longest + 1))):
        jumps = checkpointed(jumps)
        reached = null_safe_join(jumps, marked, pair).select(*keys, F.col("__next").alias(rank))
        marked = checkpointed(marked.union(reached).distinct())
        onward = jumps.select(*keys, F.col(rank).alias("__next"), F.col("__next").alias("__far"))
        jumps = null_safe_join(jumps, onward, [*keys, "__next"]).select(*pair, F.col("__far").alias("__next"))
    return marked


def _most_jumps(events: DataFrame, keys: Sequence[str], seconds: str, width: float, more: Column | None = None) -> int:
    """Upper bound of the jumps of any key: by its time span in widths and its events of the kind `more`, or all its events."""
    extra = F.count_if(more) if more is not None else F.lit(0)
    spans = F.floor((F.max(seconds) - F.min(seconds)) / width) + 2 * extra + 1 if width > 0 else F.count(F.lit(1))
    per = events.groupBy(*keys).agg(F.least(spans, F.count(F.lit(1))).alias("n"))
    return int(per.agg(F.max("n")).first()[0] or 0)


def greedy_marks(events: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, name: str) -> DataFrame:
    """`events` plus `name`: true for the first event of each key in `order` (seconds first) and, from each such event, for
    the first one `width` or more seconds later."""
    numbered = checkpointed(ranked(events, order, keys, name="__r"))
    slim = numbered.select(*keys, "__r", order[0])
    jumps = successors(slim, keys, "__r", order[0], F.col(order[0]) + width)
    jumps = jumps.withColumn("__next", F.greatest("__next", F.col("__r") + 1))
    marks = orbit(jumps, keys, "__r", _most_jumps(slim, keys, order[0], width))
    return null_safe_join(numbered, marks.withColumn(name, F.lit(True)), [*keys, "__r"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("__r")


def greedy_marks_with_restarts(events: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, restart: Column, pause: float, name: str) -> DataFrame:
    """Like `greedy_marks`, with rows that meet `restart`: they are never marked, and move the moment from which the next
    event counts to `pause + width` seconds after themselves, whatever came before.

    The walk goes over marked events and restart rows. From either the next stop is the next restart row or the first other
    event that is late enough, whichever is first.
    """
    numbered = ranked(events.withColumn("__restart", F.coalesce(restart, F.lit(False))), order, keys, name="__r")
    numbered = checkpointed(prefix_sums(numbered, [order[0], order[1], "__r"], {"__nth": F.col("__restart").cast("bigint")}, keys))
    slim = numbered.select(*keys, "__r", order[0], "__restart", "__nth", (F.col("__r") - F.col("__nth")).alias("__plain"))
    ready = F.col(order[0]) + F.when(F.col("__restart"), width + pause).otherwise(width)
    late = null_safe_join(successors(slim, keys, "__r", order[0], ready, ~F.col("__restart")), slim.select(*keys, "__r", "__plain"), [*keys, "__r"])
    late = late.select(*keys, "__r", F.greatest("__next", F.col("__plain") + 1).alias("__plain"))
    plain = slim.where(~F.col("__restart")).select(*keys, "__plain", F.col("__r").alias("__a"))
    stops = slim.where("__restart").select(*keys, (F.col("__nth") - 1).alias("__nth"), F.col("__r").alias("__b"))
    jumps = null_safe_join(late, plain, [*keys, "__plain"], "left").select(*keys, "__r", "__a")
    jumps = null_safe_join(slim.select(*keys, "__r", "__nth"), jumps, [*keys, "__r"])
    jumps = null_safe_join(jumps, stops, [*keys, "__nth"], "left")
    # without a late event or a restart row the walk ends, at a rank that doesn't exist; least() skips nulls
    jumps = jumps.select(*keys, "__r", F.coalesce(F.least("__a", "__b"), F.lit(0)).alias("__next"))
    marks = orbit(jumps, keys, "__r", _most_jumps(slim, keys, order[0], width, F.col("__restart")))
    out = null_safe_join(numbered, marks.withColumn(name, F.lit(True)), [*keys, "__r"], "left")
    return out.withColumn(name, F.coalesce(F.col(name) & ~F.col("__restart"), F.lit(False))).select(*events.columns, name)
