"""Alert rules over metric points, deduplication, lifecycle, rate caps and payloads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.jumps import greedy_marks_with_restarts
from plumbline.plans.ordering import null_safe_join, prefix_sums, top_n_per_group


@dataclass(frozen=True)
class Rule:
    """condition is a Spark SQL expression over the column `value`."""

    name: str
    metric: str
    condition: str
    severity: str
    message: str
    for_seconds: int = 0


# The standard rules; messages are SQL expressions over it.
DEFAULT_RULES = [
    Rule("high_latency", "latency_p99", "value > 1000", "warning", "concat('High latency detected: ', cast(round(value, 2) as string), 'ms')", 120),
    Rule("high_error_rate", "error_rate", "value > 0.05", "error", "concat('Error rate above threshold: ', format_number(value * 100, 1), '%')", 60),
    Rule("quality_degradation", "quality_score", "value < 0.7", "warning", "concat('Response quality below threshold: ', format_number(value, 2))", 300),
    Rule("high_gpu_memory", "gpu_memory_utilization", "value > 0.9", "warning", "concat('GPU memory usage high: ', format_number(value * 100, 1), '%')", 0),
]


def rule_eval(points: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per point and rule on its metric, with the outcome. Rules become expressions of
    the plan, so there is nothing to join."""
    hits = []
    for r in rules:
        met = F.expr(r.condition)
        hits.append(
            F.when(
                F.col("metric") == r.metric,
                F.struct(
                    F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), met.alias("met"),
                    F.when(met, F.expr(r.message)).alias("message"), F.lit(r.for_seconds).cast("double").alias("for_seconds"),
                ),
            )
        )
    return points.withColumn("__r", F.explode(F.array_compact(F.array(*hits)))).select(*points.columns, "__r.*")


def rule_for_duration(evaluated: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Add `island`, `pending_since` and `firing`: true only after `for_seconds` of unbroken truth.

    The island of a row is the running count of false outcomes before it; the running count is
    spread over sort partitions, so a long series does not sit in one task. Of points in one second
    those that are not met come first, so islands don't depend on the layout.
    """
    numbered = prefix_sums(
        evaluated, [seconds, "met"], {"island": F.coalesce((~F.col("met")).cast("bigint"), F.lit(1))}, ["rule", *keys]
    )
    starts = numbered.where("met").groupBy("rule", *keys, "island").agg(F.min(seconds).alias("pending_since"))
    out = null_safe_join(numbered, starts, ["rule", *keys, "island"], "left")
    since = F.when(F.col("met"), F.col("pending_since"))
    return out.withColumn("pending_since", since).withColumn(
        "firing", F.coalesce(F.col("met") & (F.col(seconds) - since >= F.col("for_seconds")), F.lit(False))
    )


def alert_lifecycle(fired: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """One row per unbroken firing: started, resolved at the next false point, duration, status."""
    per = fired.groupBy("rule", *keys, "island").agg(
        F.min(F.when(F.col("firing"), F.col(seconds))).alias("started_at"),
        F.max(F.when(F.col("firing"), F.col(seconds))).alias("last_seen"),
        F.count_if("firing").alias("points"),
        # the false point that opened this island resolves the one before it
        F.min(F.when(~F.col("met"), F.col(seconds))).alias("opened_at"),
    )
    closing = per.select("rule", *keys, (F.col("island") - 1).alias("island"), F.col("opened_at").alias("resolved_at"))
    out = per.where("points > 0").join(closing, ["rule", *keys, "island"], "left")
    end = F.coalesce("resolved_at", "last_seen")
    return out.select(
        "rule", *keys, "started_at", "resolved_at", (end - F.col("started_at")).alias("duration"), "points",
        F.when(F.col("resolved_at").isNotNull(), "resolved").otherwise("firing").alias("status"),
    )


def fingerprint(name: Column, labels: Column) -> Column:
    """md5 of name and the sorted label pairs written as a list of pairs, 16 hex digits."""
    pair = lambda e: F.concat(F.lit("('"), e["key"], F.lit("', '"), e["value"], F.lit("')"))
    pairs = F.transform(F.sort_array(F.map_entries(labels)), pair)
    text = F.concat(name, F.lit("|["), F.array_join(pairs, ", "), F.lit("]"))
    return F.substring(F.md5(text), 1, 16)


def alert_dedup_window(alerts: DataFrame, window: float = 300.0, silence: float = 3600.0) -> DataFrame:
    """Greedy suppression per fingerprint; columns fingerprint, sec (seconds), seq, action.

    Send unless the last sent alert is younger than the window; a silence row moves that moment `silence` seconds ahead.
    Found by doubling jumps, so a fingerprint that never pauses is no task of its own.
    """
    return greedy_marks_with_restarts(alerts, ["fingerprint"], ["sec", "seq"], window, F.col("action") == "silence", silence, "sent")


def alert_rate_cap(alerts: DataFrame, cap: int = 3, width: int = 300) -> DataFrame:
    """Rows kept: at most `cap` per name and tumbling window; the rest are suppressed."""
    a = alerts.withColumn("slot", F.floor(F.col("sec") / width))
    kept = top_n_per_group(a, ["name", "slot"], ["sec", "seq"], cap, ["seq"], name="pos")
    marks = kept.select("seq", F.lit(True).alias("k"))
    return a.join(marks, "seq", "left").select("seq", "name", "slot", F.coalesce("k", F.lit(False)).alias("sent"))


# Channel colours per severity.
SEVERITY_COLOURS = {"info": "#36a64f", "warning": "#FFA500", "error": "#FF6347", "critical": "#DC143C"}


def alert_payload(alerts: DataFrame, source: str = "plumbline") -> DataFrame:
    """Subject, chat and paging payloads as JSON text per alert (name, severity, message, value, status, sec)."""
    colour = F.lit("#808080")
    for s, c in SEVERITY_COLOURS.items():
        colour = F.when(F.col("severity") == s, c).otherwise(colour)
    title = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("name"))
    chat = F.struct(
        colour.alias("color"), title.alias("title"), F.col("message").alias("text"),
        F.col("status").alias("status"), F.floor("sec").alias("ts"),
    )
    page = F.struct(
        F.when(F.col("status") == "firing", "trigger").otherwise("resolve").alias("event_action"),
        F.col("fingerprint").alias("dedup_key"),
        F.struct(F.col("message").alias("summary"), F.col("severity").alias("severity"), F.lit(source).alias("source")).alias("payload"),
    )
    return alerts.select("fingerprint", "sec", title.alias("subject"), F.to_json(chat).alias("chat"), F.to_json(page).alias("page"))
