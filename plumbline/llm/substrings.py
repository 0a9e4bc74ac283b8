"""Substring deduplication: Rabin-Karp hashes of every window of `width` words, counted in Spark.

A window repeats when its word sequence also starts in a document with a smaller id. Writing one row per window of the
corpus would shuffle several times the text, so windows travel in groups: a window's anchor is the smallest hash among
its word sequences of half its width, and neighbouring windows mostly share it. Equal windows have equal anchors, so

1. anchors are counted; those of one document only are done,
2. where all occurrences of an anchor have the same surrounding windows (one extent hash), the group repeats as a whole,
3. only for the other anchors are single window hashes counted.

Each document then merges its repeated windows into maximal intervals and drops the words they cover. Hashes of windows
and of anchors with their extents have 128 bits. Keys that very many documents share meet in partial aggregates and in
sort-merge joins of two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.llm.common import free_name, map_arrow, stored

WIDTH = 50
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Window hashes of one text in two independent 64-bit lanes."""

    _powers = np.ones((2, 1), np.uint64)

    def __init__(self, words: list[bytes]):
        n = len(words)
        if Rolling._powers.shape[1] <= n:
            size = 2 * n + 1024
            steps = np.empty((2, size), np.uint64)
            steps[:, 0] = 1
            steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
            Rolling._powers = np.multiply.accumulate(steps, axis=1)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(n, 2).T
        self.n = n
        self.sums = np.zeros((2, n + 1), np.uint64)
        np.cumsum(h * Rolling._powers[1, :n], axis=1, out=self.sums[:, 1:])

    def spans(self, start: np.ndarray, stop: np.ndarray, lane: int) -> np.ndarray:
        return (self.sums[lane][stop] - self.sums[lane][start]) * Rolling._powers[0, start]

    def windows(self, width: int, lane: int) -> np.ndarray:
        s, m = self.sums[lane], self.n - width + 1
        return (s[width:] - s[:m]) * Rolling._powers[0, :m]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(roll: Rolling, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each group of neighbouring windows with one anchor: its hash, extent hash, first and last window."""
    part = width // 2
    reach = width - part + 1
    grams = _mix(roll.windows(part, 0))
    m = roll.n - width + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(axis=1) + np.arange(m)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [m])) - 1
    shape = ((last - first) * width + at[first] - first).astype(np.uint64)
    extent = _mix(roll.spans(first, last + width, 1) ^ _mix(shape + np.uint64(1)))
    return grams[at[first]].view(np.int64), extent.view(np.int64), first, last


def _words(batch: pa.RecordBatch, text_col: str) -> list[list[bytes]]:
    return [x.split() for x in batch.column(text_col).cast(pa.binary()).fill_null(b"").to_pylist()]


def _lists(col: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column; null and missing lists are empty."""
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def _covered(n: int, width: int, windows: np.ndarray) -> np.ndarray:
    """Words inside the merged intervals of the windows (a boolean per window)."""
    edge = np.zeros(n + 1, np.int32)
    hit = np.flatnonzero(windows)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, groups, windows): per document with repeats, the anchors whose windows all repeat and single window hashes."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def anchor_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [[], [], []]
        for i, words in zip(batch.column("id").to_numpy(), _words(batch, "text")):
            if len(words) >= width:
                g, e, _, _ = anchors(Rolling(words), width)
                pairs = np.unique(np.stack([g, e]), axis=1) if len(g) > 1 else np.stack([g, e])
                for part, x in zip(out, (pairs[0], pairs[1], np.full(pairs.shape[1], i))):
                    part.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["g", "e", "id"]) if out[0] else None

    rows = stored(map_arrow(base, anchor_rows, "g long, e long, id long"), "substring-anchors")
    shared = rows.groupBy("g").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    shared = stored(shared.where("low < high").select("g", "low", (F.col("e0") != F.col("e1")).alias("mixed")), "substring-shared")
    hits = rows.join(shared, "g").where("mixed or id > low")
    wanted = hits.groupBy("id").agg(  # bounded by the document's own anchors
        F.collect_set(F.when(~F.col("mixed"), F.col("g"))).alias("groups"), F.collect_set(F.when(F.col("mixed"), F.col("g"))).alias("open")
    )
    wanted = stored(wanted, "substring-wanted")

    def window_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [[], [], []]
        for i, words, ask in zip(batch.column("id").to_numpy(), _words(batch, "text"), _lists(batch.column("open"))):
            if len(words) < width:
                continue
            roll = Rolling(words)
            g, _, first, last = anchors(roll, width)
            pick = np.isin(g, ask)
            at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[pick], last[pick])]) if pick.any() else np.zeros(0, np.int64)
            if len(at):
                pairs = np.stack([roll.spans(at, at + width, lane).view(np.int64) for lane in (0, 1)])
                pairs = np.unique(pairs, axis=1)
                for part, x in zip(out, (pairs[0], pairs[1], np.full(pairs.shape[1], i))):
                    part.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h", "k", "id"]) if out[0] else None

    asked = base.join(wanted.where(F.size("open") > 0).select("id", "open"), "id")
    singles = stored(map_arrow(asked, window_rows, "h long, k long, id long"), "substring-windows")
    owner = singles.groupBy("h", "k").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    owner = stored(owner.where("low < high").select("h", "k", "low"), "substring-owners")
    again = singles.join(owner, ["h", "k"]).where("id > low").groupBy("id").agg(F.collect_set("h").alias("windows"))
    return stored(wanted.select("id", "groups").join(again, "id", "left").where((F.size("groups") > 0) | F.col("windows").isNotNull()), "substring-repeats")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns of `docs`, the text without repeated passages, and n_words, n_removed of the text as it was.

    A text that loses words becomes its kept words joined by one space; any other text stays as it is. Null and short
    texts lose nothing. Rows with a null id keep everything and make nothing repeated. Rows of one id are not compared
    with each other, only with smaller ids. Columns named n_words or n_removed are replaced.
    """
    docs = docs.drop(*[c for c in ("n_words", "n_removed") if c not in (id_col, text_col)])
    found = repeated_windows(docs, id_col, text_col, width)
    names, key = docs.columns, free_name(docs, "id")
    groups_col, windows_col = free_name(docs, "groups"), free_name(docs, "windows")
    found = found.select(F.col("id").alias(key), F.col("groups").alias(groups_col), F.col("windows").alias(windows_col))
    joined = docs.join(found, docs[id_col].cast("bigint") == F.col(key), "left").drop(key)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, removed = batch.column(text_col).to_pylist(), [], []
        for i, (words, groups, windows) in enumerate(zip(_words(batch, text_col), _lists(batch.column(groups_col)), _lists(batch.column(windows_col)))):
            n, gone = len(words), 0
            if n >= width and (len(groups) or len(windows)):
                roll = Rolling(words)
                g, _, first, last = anchors(roll, width)
                hit = np.isin(roll.windows(width, 0).view(np.int64), windows)
                for a, b in zip(first[s := np.isin(g, groups)], last[s]):
                    hit[a : b + 1] = True
                cover = _covered(n, width, hit)
                gone = int(cover.sum())
                if gone:
                    texts[i] = b" ".join(w for w, c in zip(words, cover) if not c).decode()
            total.append(n)
            removed.append(gone)
        cols = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema.fields]
    return map_arrow(joined, strip, StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType())]))


def normal_text(text):
    """Words joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
