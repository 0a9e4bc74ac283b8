"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct five-word shingles, hashed to 64 bits. XOR-ing the hashes of a set's shingles into
blocks gives a sketch in which two sets can differ in at most |A - B| + |B - A| blocks. Sets with Jaccard similarity
0.75 differ in at most k = (|A| + |B|) / 7 shingles, so by the pigeonhole principle, of N non-empty blocks at least N - k
agree. Blocks belong to size bands: the number of blocks is a power of two near the set size (for sets of up to 96
shingles each shingle is its own block), and a set near a band's lower end also enters it as a guest.

Signatures (one per block, joined on equality) are ordered: first those not known as frequent, by hash. The first k + 1
would meet every partner for certain. Where the set has many more blocks than k, fewer already meet it: the number is
set so that a partner at the very threshold is missed with probability below e^-30, less than a hash collision.
Frequent signatures, found on a sample that only affects this order, are used only by sets that need them.

Verification first bounds the difference from below by the Hamming distance of bit sketches (about two bits per shingle,
folded to the same length), then intersects the exact sets. Sets of equal content are merged before. Candidates start
as a star per signature, one partner per document. Signatures that still hold many components are taken up again in
rounds: a document is compared with a few members of the largest component it meets there, as long as this links a fair
share of them, so that a group of near copies falls together in linear work, whoever its first leader was. Only what
stays apart is compared pair by pair, among sets of like size on a common signature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, stored
from plumbline.plans.graphs import connected_components

SHINGLE, SINGLES, MISS = 5, 96, 30.0
CROWD, REPS, ENOUGH = 16, 4, 16  # components that make a signature crowded; members a document is compared with per round; a round that links fewer than one document in so many is the last
FOLD = 2048  # bits of the sketch that open pairs are compared by
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle make one; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    n = len(h) - SHINGLE + 1
    if n < 1:
        return _mix(np.array([(h * _WEIGHTS[: len(h)]).sum()], np.uint64), len(h))
    out = h[:n] * _WEIGHTS[0]
    for j in range(1, SHINGLE):
        out += h[j : j + n] * _WEIGHTS[j]
    return np.unique(_mix(out))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both) > 0


def allowed(a, b):
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) // 7


def band(a: int) -> int:
    """log2 of the number of blocks for sets of a shingles; 6 stands for one block per shingle."""
    return 6 if a <= SINGLES else int(np.ceil(np.log2(a / 1.5)))


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    a = len(s)
    own, k = band(a), int(allowed(a, 4 * a // 3))
    out = []
    for m in (own, own + 1)[: 1 + (a > 1.125 * (1 << own))]:
        if m == 6:
            sig = _mix(s, 6)
        else:
            block = s >> np.uint64(64 - m)
            start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            sig = _mix(np.bitwise_xor.reduceat(_mix(s, 3), start) + (block[start] << np.uint64(8)), m)
        known = frequent[np.minimum(np.searchsorted(frequent, sig), len(frequent) - 1)] == sig if len(frequent) else np.zeros(len(sig), bool)
        rare, rest = np.sort(sig[~known]), np.sort(sig[known])
        if len(rare) > k:
            sure = len(rare) - k
            take = min(k + 1, int(np.ceil(MISS / -np.log1p(-sure / (2 * len(rare) - sure) + 1e-12))))
            out.append(rare[:take])
        else:
            out += [rare, rest[: k + 1 - len(rare)]]
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles on each of 2^n bits, n from the size band."""
    bits = 1 << max(9, band(len(s)) + 1)
    return np.packbits(np.bincount((_mix(s, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the longer one folds onto the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def folded(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles on each of `FOLD` bits, as 64-bit integers. Wide enough that sets of a few thousand
    shingles in all still tell apart by it; a bounded width travels with every open row."""
    bits = np.bincount((_mix(s, 5) & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _profiles(base: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, n, f1, f2, sketch, fold, sigs) per text: set size, fingerprint of the set, bit sketch, its fold, signatures."""
    sent = base.sparkSession.sparkContext.broadcast(frequent)  # a bounded list

    def profile(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in range(6)]
        for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
            s = shingles(text)
            some = len(s) > 0
            bits = sketch(s) if some else None
            row = (
                len(s), int(_mix(s, 11).sum().view(np.int64)) if some else None, int(np.bitwise_xor.reduce(_mix(s, 13)).view(np.int64)) if some else None,
                bits, folded(s) if some else None, signatures(s, sent.value).view(np.int64) if some else None,
            )
            for c, x in zip(cols, row):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["id", "n", "f1", "f2", "sketch", "fold", "sigs"])

    return map_arrow(base, profile, "id long, n long, f1 long, f2 long, sketch binary, fold array<long>, sigs array<long>")


def frequent_signatures(base: DataFrame, one_in: int = 16, least: int = 4, most: int = 1 << 16) -> np.ndarray:
    """Signatures met at least `least` times among one of `one_in` documents; the `most` commonest at most."""
    part = base.where(F.crc32(F.col("id").cast("string").cast("binary")) % one_in == 0)
    sigs = _profiles(part, np.zeros(0, np.uint64)).select(F.explode("sigs").alias("sig"))
    top = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "sig").limit(most)
    return np.sort(np.array([r.sig for r in top.collect()], np.int64).view(np.uint64))


def _verified(pairs: DataFrame, sets: DataFrame, base: DataFrame) -> DataFrame:
    """Those of the distinct pairs (x, y) that are linked."""
    for c in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    pairs = pairs.where(100 * F.least("nx", "ny") >= 75 * F.greatest("nx", "ny"))

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        sx, sy = batch.column("sx").to_pylist(), batch.column("sy").to_pylist()
        most = allowed(batch.column("nx").to_numpy(), batch.column("ny").to_numpy())
        ok = [distance(a, b) <= m for a, b, m in zip(sx, sy, most)]
        return batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    pairs = stored(map_arrow(pairs.select("x", "y", "nx", "ny", "sx", "sy"), near, "x long, y long"), "jaccard-near")
    for c in ("x", "y"):
        pairs = pairs.join(base.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")), c)

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(c).cast(pa.binary()).fill_null(b"").to_pylist() for c in ("tx", "ty"))
        return batch.select(["x", "y"]).filter(pa.array([similar(shingles(a), shingles(b)) for a, b in zip(x, y)], pa.bool_()))

    return map_arrow(pairs.select("x", "y", "tx", "ty"), exact, "x long, y long")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (sig, id, first, comp) of the signatures with more than `CROWD` components."""
    many = rows.groupBy("sig").agg(F.count_distinct("comp").alias("c")).where(F.col("c") > CROWD).select("sig")
    return stored(rows.join(many, "sig"), "jaccard-crowded")


def _merge_crowds(open_rows: DataFrame, sets: DataFrame, base: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """(tables of links found by rounds, (first, comp) of the components they unite).

    A document takes the component it meets on most signatures among those that lead one, by rows, and is compared with
    `REPS` of its members. Labels only need to unite what is linked, not all of it: a later step closes them.
    """
    rows = _crowded(open_rows.select("sig", "id", F.col("comp").alias("first"), "comp"))
    own = stored(sets.join(rows.select("id").distinct(), "id", "left_semi"), "jaccard-crowd-sets")
    links, moved, more = [], None, rows.limit(1).count() > 0
    while more:
        picks = [F.min_by("id", F.xxhash64("id", F.lit(REPS * len(links) + j))) for j in range(REPS)]
        per = rows.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"), F.array(*picks).alias("reps"))
        lead = per.groupBy("sig").agg(F.max_by(F.struct(F.col("comp").alias("to"), "reps"), F.struct("n", -F.col("comp"))).alias("lead")).select("sig", "lead.*")
        met = rows.join(lead, "sig").where("comp <> to").groupBy("id", "comp", "to").agg(F.count(F.lit(1)).alias("n"), F.max("reps").alias("reps"))
        best = met.groupBy("id", "comp").agg(F.max_by(F.struct("to", "reps"), F.struct("n", -F.col("to"))).alias("best")).select("id", "comp", "best.*")
        star = stored(best.select(F.col("id").alias("x"), F.explode(F.array_distinct("reps")).alias("y"), "comp", "to"), "jaccard-round")
        found = stored(_verified(star.select("x", "y"), own, base), "jaccard-found")
        links.append(found)
        asked, linked = (df.select("x").distinct().count() for df in (star, found))
        more = linked * ENOUGH > asked
        if linked:
            ends = found.join(star, ["x", "y"]).select("comp", "to")
            low = ends.union(ends.select("to", "comp")).groupBy("comp").agg(F.least(F.min("to"), F.first("comp")).alias("low"))
            rows = rows.join(stored(low, "jaccard-low"), "comp", "left").select("sig", "id", "first", F.coalesce("low", "comp").alias("comp"))
            now = rows.select("first", "comp").distinct()
            moved = stored(now if moved is None else now.union(moved.join(now.select("first"), "first", "left_anti")), "jaccard-labels")
            rows = _crowded(rows) if more else rows
    return links, moved


def _open_pairs(rows: DataFrame) -> DataFrame:
    """(x, y) of different components on a common signature whose sizes and folded sketches allow a link.

    A set meets, as the smaller one, those of its size class and of the next; classes grow by 4/3, the most that linked
    sets can differ. Sketches travel as plain non-null longs, a quarter of them is looked at first: with array items the
    join's method passes 8000 bytes of code, is never compiled, and a pair costs 10 microseconds.
    """
    size = F.floor(F.log("n") / F.log(F.lit(4 / 3)) - 1e-9).cast("int")
    lanes = range(FOLD // 64)
    cols = {c: F.col(c) for c in ("id", "comp", "n")} | {f"f{i}": F.coalesce(F.get("fold", F.lit(i)), F.lit(0)) for i in lanes}
    one = rows.select("sig", size.alias("size"), *[c.alias(f"{k}_x") for k, c in cols.items()])
    two = rows.select("sig", F.explode(F.array(size, size - 1)).alias("size"), *[c.alias(f"{k}_y") for k, c in cols.items()])
    apart = [F.bit_count(F.col(f"f{i}_x").bitwiseXOR(F.col(f"f{i}_y"))) for i in lanes]
    near = [7 * sum(part[1:], part[0]) <= F.col("n_x") + F.col("n_y") for part in (apart[: len(apart) // 4], apart)]
    larger = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") < F.col("id_y")))
    alike = larger & (100 * F.col("n_x") >= 75 * F.col("n_y")) & near[0] & near[1]
    met = one.join(two, ["sig", "size"]).where((F.col("comp_x") != F.col("comp_y")) & alike)
    return met.select(F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of `docs`: set size and the smallest id reachable by links.

    Texts without words have no shingles and link with nothing, so they are their own component. Rows with a null id
    take no part and get a null component. Rows of one id are one node: a link of either holds for both.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = base.where(F.col("id").isNotNull())
    sets = stored(_profiles(base, frequent_signatures(known)), "jaccard-sets")
    some = sets.where("id is not null and n > 0")
    same = some.groupBy("f1", "f2", "n").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c"))
    equal = some.select("id", "f1", "f2", "n").join(stored(same.where("c > 1").select("f1", "f2", "n", "low"), "jaccard-equal"), ["f1", "f2", "n"])
    equal = stored(equal.where("id <> low").select(F.col("id").alias("x"), F.col("low").alias("y")), "jaccard-copies")
    heads = some.join(equal.select(F.col("x").alias("id")).distinct(), "id", "left_anti")
    rows = heads.select("id", F.explode("sigs").alias("sig"))
    lead = rows.groupBy("sig").agg(F.min("id").alias("lead"), F.max("id").alias("high")).where("lead < high").select("sig", "lead")
    met = stored(rows.join(stored(lead, "jaccard-leads"), "sig"), "jaccard-met")
    votes = met.where("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("c"))
    star = votes.groupBy("id").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead"))
    star = stored(star.select(F.col("id").alias("x"), F.col("lead").alias("y")), "jaccard-star")
    small = sets.select("id", "n", "sketch")
    links = stored(_verified(star, small, known), "jaccard-links")
    first = stored(connected_components(links, "x", "y"), "jaccard-first").select(F.col("node").alias("id"), F.col("component").alias("comp"))
    placed = met.select("sig", "id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = stored(placed, "jaccard-placed")
    split = placed.groupBy("sig").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("sig")
    left = stored(placed.join(stored(split, "jaccard-split"), "sig"), "jaccard-open")
    done = star.select(F.col("x").alias("y"), F.col("y").alias("x")).select("x", "y").union(star.select("x", "y"))
    extra, moved = _merge_crowds(left, small, known)
    if moved is not None:
        left = left.withColumnRenamed("comp", "first").join(moved, "first", "left").select("sig", "id", F.coalesce("comp", "first").alias("comp"))
    for found in extra:
        links = links.union(found)
    left = left.join(sets.select("id", "n", "fold"), "id").select("sig", "id", "comp", "n", "fold")
    open_pairs = _open_pairs(left).join(done, ["x", "y"], "left_anti")
    more = stored(_verified(open_pairs, small, known), "jaccard-more")
    groups = connected_components(links.union(more).union(equal), "x", "y")
    out = sets.select("id", F.col("n").alias("n_shingles")).join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, one document of each group: the smallest id. Texts without words all stay.

    Rows with a null id stay. Rows that repeat the kept id stay too, they are the same document.
    """
    groups = similar_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = groups.where("component_id < id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
