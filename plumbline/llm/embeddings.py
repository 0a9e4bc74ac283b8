"""Embedding near-copies by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, quantised with cell width `cell` and bucketed by `depth` cells
at once, in several tables; vectors at the least cosine meet in some table with probability `recall`. In a bucket all
pairs get an exact cosine in double precision. Equal vectors are merged before, buckets are cut into blocks of bounded
size whose pairs of blocks go to different tasks, a pair is counted only in the first table where it meets, and tasks
emit counts per vector and one edge per vector and block, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, stored
from plumbline.plans.graphs import connected_components

BLOCK = 512


def meeting(distance: float, cell: float) -> float:
    """Probability that two points at this distance share a cell of one projection."""
    r = cell / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def tables_for(n: int, least: float, cell: float, recall: float) -> tuple[int, int]:
    """(depth, tables): depth grows with the logarithm of n so that unrelated vectors rarely share a bucket."""
    depth = max(4, int(log(max(n, 2)) / -log(meeting(1.3, cell)) + 1) - 3)
    return depth, max(1, int(log(1 - recall) / log(1 - meeting(sqrt(2 - 2 * least), cell) ** depth) + 1))


def _hashed(vectors: DataFrame, depth: int, tables: int, cell: float, seed: int) -> DataFrame:
    """(id, dim, v, f1, f2, cells): v is null where the vector links with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column("v")
        flat, at = col.values.cast(pa.float64()), col.offsets.to_numpy()
        holes, flat = np.asarray(flat.is_null()), flat.fill_null(0).to_numpy(zero_copy_only=False)
        good = np.asarray(col.is_valid())
        rows, kinds = [None] * len(col), {}
        for i, (a, b) in enumerate(zip(at, at[1:])):
            x = flat[a:b]
            if good[i] and b > a and not holes[a:b].any() and np.isfinite(x).all() and x.any():
                x = x + 0.0  # one zero only
                rows[i] = x.tobytes()
                kinds.setdefault(b - a, []).append(i)
        cells = [None] * len(col)
        for dim, picks in kinds.items():
            rng = np.random.default_rng([seed, dim])
            lines, shift = rng.normal(size=(dim, depth * tables)), rng.uniform(0, cell, depth * tables)
            mixer = rng.integers(1, 1 << 62, depth, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            x = np.stack([np.frombuffer(rows[i]) for i in picks])
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            q = np.floor((x @ lines + shift) / cell).astype(np.int64).astype(np.uint64).reshape(len(picks), tables, depth)
            h = (q * mixer).sum(2)
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64) >> 32
            for i, c in zip(picks, h.astype(np.int32)):
                cells[i] = c
        digests = [xxhash.xxh3_128_digest(r) if r else b"\0" * 16 for r in rows]
        f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(r) // 8 if r else 0 for r in rows], pa.int32()), pa.array(rows, pa.binary()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(cells, pa.list_(pa.int32()))],
            names=["id", "dim", "v", "f1", "f2", "cells"],
        )

    return map_arrow(vectors, run, "id long, dim int, v binary, f1 long, f2 long, cells array<int>")


def _block_links(rows: list[dict], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, links, low) of one pair of blocks of a bucket: linked vectors met here first, smallest head reachable."""
    head = np.array([r["head"] for r in rows])
    copies = np.array([r["copies"] for r in rows])
    side = np.array([r["side"] for r in rows])
    x = np.stack([np.frombuffer(r["v"]) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= least
    np.fill_diagonal(near, False)
    if rows[0]["lo"] != rows[0]["hi"]:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return head[:0], head[:0], head[:0]
    cells, t = np.array([r["cells"] for r in rows]), rows[0]["t"]
    fresh = ~(cells[i, :t] == cells[j, :t]).any(1) if t else np.ones(len(i), bool)
    links = np.bincount(i[fresh], copies[j[fresh]], len(head)).astype(np.int64)
    low = head.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        if (new == low).all():
            break
        low = new
    keep = (links > 0) | (low < head)
    return head[keep], links[keep], low[keep]


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, cell: float = 1.5, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id) per row: other vectors linked directly, smallest id reachable by links.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Rows with a null id take no part and get no component. Rows that repeat an id count as vectors.
    """
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    known = base.where(F.col("id").isNotNull())
    depth, tables = tables_for(known.count(), least, cell, recall)
    rows = stored(_hashed(known, depth, tables, cell, seed), "vector-cells")
    good = rows.where(F.col("v").isNotNull())
    heads = good.groupBy("f1", "f2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    heads = stored(heads, "vector-heads")
    unique = heads.join(good.dropDuplicates(["id", "f1", "f2"]), (F.col("id") == F.col("head")) & (good["f1"] == heads["f1"]) & (good["f2"] == heads["f2"]))
    met = unique.select("head", "copies", "dim", "v", "cells", F.posexplode("cells").alias("t", "cell"))
    sizes = met.groupBy("dim", "t", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.join(stored(sizes, "vector-buckets"), ["dim", "t", "cell"])
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("head"), parts).cast("int")
    met = met.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    key = ["dim", "t", "cell", "lo", "hi"]
    spread = met.select(*key, "side", "head", "copies", "v", "cells").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []

        def flush():
            got = [x for x in out if len(x[0])]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names=["head", "links", "low"]) if got else None

        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[c] for c in key)
                if k != now:
                    if len(held) > 1:
                        out.append(_block_links(held, least))
                    held, now = [], k
                held.append(r)
            if (done := flush()) is not None:
                yield done
        if len(held) > 1:
            out.append(_block_links(held, least))
        if (done := flush()) is not None:
            yield done

    found = stored(spread.mapInArrow(run, "head long, links long, low long"), "vector-links")
    counts = found.groupBy("head").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("low < head").select("head", "low"), "head", "low")
    per = heads.join(counts, "head", "left").join(groups.select(F.col("node").alias("head"), "component"), "head", "left")
    per = per.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"), F.lit(True).alias("ok"))
    rows = rows.select("id", "f1", "f2", F.col("v").isNotNull().alias("ok"))
    out = rows.join(stored(per, "vector-groups"), ["f1", "f2", "ok"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    lost = base.where(F.col("id").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    return out.union(lost)
