"""MD5 of files too large for one row: read in splits, hashed part by part with the state passed on."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.runtime import scratch_path, stored

# Bytes of a file that one task hashes, about; the mark that Hadoop's line reader leaves out at the start of a file.
HASH_PART = 128 << 20
MARK = b"\xef\xbb\xbf"
STATE_BYTES = 256  # MD5_CTX of OpenSSL's md5.h has 92

PIECE = "file string, start long, seq int, content binary"
STATE = "file string, length long, held long, fed long, state binary, md5 string"
_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("content", pa.binary())])
_STATE = pa.schema([("file", pa.string()), ("length", pa.int64()), ("held", pa.int64()), ("fed", pa.int64()), ("state", pa.binary()), ("md5", pa.string())])


def openssl() -> ctypes.CDLL | None:
    """The library with resumable MD5, if this Python has it, proved on a known text. Its MD5_CTX is plain numbers, so it can be
    stored between two calls; hashlib's objects can't."""
    names = [getattr(sys.modules.get("_hashlib"), "__file__", None), ctypes.util.find_library("crypto")]
    for name in filter(None, names):
        try:
            lib = ctypes.CDLL(name)
            lib.MD5_Init.argtypes, lib.MD5_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
            lib.MD5_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            if digest(lib, update(lib, update(lib, None, MARK * 50), MARK)) == hashlib.md5(MARK * 51, usedforsecurity=False).hexdigest():
                return lib
        except (OSError, AttributeError):
            continue
    return None


def update(lib: ctypes.CDLL, state: bytes | None, content: bytes) -> bytes:
    """The state after more content; None is the state before any."""
    c = ctypes.create_string_buffer(state or b"", STATE_BYTES)
    if state is None:
        lib.MD5_Init(c)
    lib.MD5_Update(c, content, len(content))
    return c.raw


def digest(lib: ctypes.CDLL, state: bytes) -> str:
    out = ctypes.create_string_buffer(16)
    lib.MD5_Final(out, ctypes.create_string_buffer(state, STATE_BYTES))
    return out.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each split put together again, numbered; every line gets a break, also a last one that had none."""
    last, seq = None, 0
    for b in batches:
        files, starts = b.column("file").dictionary_encode(), b.column("start").to_numpy()
        lines = b.column("content").cast(pa.large_binary())
        turns = np.flatnonzero(np.diff(files.indices.to_numpy()) | np.diff(starts)) + 1
        for i, j in pairwise([0, *turns.tolist(), b.num_rows] if b.num_rows else []):
            at = (files[i].as_py(), int(starts[i]))
            last, seq = at, seq + 1 if at == last else 0
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), lines[i:j]), pa.scalar(b"\n", pa.large_binary()))
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((*at, seq, joined[0].as_py() + b"\n"), _PIECE)], schema=_PIECE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by file: its state, then pieces in order. Gives the file's next state, and its md5 once all bytes were fed."""

    lib = openssl()

    def out(s: dict) -> pa.RecordBatch:
        s["md5"] = digest(lib, s["state"]) if s["fed"] == s["length"] else None
        return pa.RecordBatch.from_pylist([s], _STATE)

    s = None
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            if r["start"] < 0:
                if s is not None:
                    yield out(s)
                s = {c: r[c] for c in _STATE.names}
                if s["state"] is None:
                    # as every line got a break, pieces hold one byte more than a file without a last break, and 3 less with a mark
                    mark = MARK if s["held"] - s["length"] in (-len(MARK), 1 - len(MARK)) else b""
                    s |= {"state": update(lib, None, mark), "fed": len(mark)}
            else:
                content = r["content"][: s["length"] - s["fed"]]
                s |= {"state": update(lib, s["state"], content), "fed": s["fed"] + len(content)}
    if s is not None:
        yield out(s)


def large_md5(lines: DataFrame, files: DataFrame, longest: int, count: int) -> DataFrame:
    """file, md5 of `files` (file, length), whose bytes are `lines` (file, start of the split, content; no line breaks).

    Splits are read once, all in parallel, and kept by part below the checkpoint folder. Then each round hashes one part of every
    file from the state that the round before left, so no task reads more than about a part of each of its files.
    """
    spark = files.sparkSession
    path = scratch_path(spark, "file-parts")
    pieces = lines.mapInArrow(_pieces, PIECE).withColumn("held", F.length("content").cast("long"))
    pieces.withColumn("part", F.floor(F.col("start") / HASH_PART).cast("int")).write.partitionBy("part").parquet(path)
    kept = spark.read.schema(f"{PIECE}, held long, part int").parquet(path)
    states = files.join(kept.groupBy("file").agg(F.sum("held").alias("held")), "file", "left")
    states = stored(states.selectExpr("file", "length", "held", "0L AS fed", "CAST(NULL AS binary) AS state", "CAST(NULL AS string) AS md5"), "file-states")
    for part in range((longest - 1) // HASH_PART + 1):
        rows = states.withColumn("start", F.lit(-1)).unionByName(kept.where(F.col("part") == part).drop("part", "held"), allowMissingColumns=True)
        dealt = rows.repartition(4 * count, "file").sortWithinPartitions("file", "start", "seq")
        states = stored(dealt.mapInArrow(_hashed, STATE), "file-states")
    broken = F.raise_error(F.concat(F.lit("read other bytes than the file's length says: "), "file"))
    return states.select("file", F.coalesce("md5", broken).alias("md5"))
