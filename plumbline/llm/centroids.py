"""Clustering around centroids with JVM expressions only.

Components become integers floor(scale * x), so distances and means are exact and don't depend on the order of rows.
`zip_with` and `aggregate` compute the squared distance to every literal centroid array, `array_min` of structs picks the
nearest (the smaller number on ties), and one aggregate with a sum per component updates the centroids: a round moves one
row per cluster and task. Only centroids, `k` arrays, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a smaller magnitude than this leave squared distances of 64 of them within 63 bits, at scale 64.
LIMIT = 1 << 21


def _literal(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")


def _distance(v: Column, centroid: list[int]) -> Column:
    return F.aggregate(F.zip_with(v, _literal(centroid), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64) -> DataFrame:
    """(id, v) of the vectors with exactly `dim` components, none null or non-finite.

    v is null where a component is so large (2^21) that squared distances would leave 64 bits.
    """
    x = F.col(vector_col)
    kept = vectors.where((F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) < LIMIT)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return kept.select(F.col(id_col).alias("id"), F.when(fits, v).alias("v"))


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; ties go to the smaller number."""
    return F.array_min(F.array(*[F.struct(_distance(v, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def assign_clusters(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """`rows` plus cluster and distance; both null where v is null or no centroid exists. No shuffle."""
    if not centroids:
        return rows.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
    near = rows.withColumn("near", F.when(F.col("v").isNotNull(), nearest(F.col("v"), centroids)))
    return near.withColumns({"cluster": F.col("near.cluster"), "distance": F.col("near.distance")}).drop("near")


def fit_centroids(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, seed: int = 1) -> list[list[int]]:
    """Centroids after `rounds` rounds over all rows of (id, v).

    They start as the k vectors with the smallest sha256 of `seed:id`; rows of one id tie and go by their components, null ids
    come last. Each round takes the exact floor of a cluster's component means; empty clusters stay. Fewer than k vectors
    give fewer centroids, none an empty list.
    """
    rows = rows.where(F.col("v").isNotNull())
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [list(r.v) for r in rows.orderBy(rank.asc_nulls_last(), "v").select("v").limit(k).collect()]
    if not centroids:
        return []
    for _ in range(rounds):
        sums = assign_clusters(rows, centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)])
        for r in sums.collect():  # at most k rows
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return centroids


def cluster_inertia(rows: DataFrame, centroids: list[list[int]]) -> dict[int, int]:
    """Distance summed per cluster over all rows, exact."""
    per = assign_clusters(rows.where(F.col("v").isNotNull()), centroids).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    return {r.cluster: int(r.s) for r in per.collect()} if centroids else {}


def per_cluster(values: dict, kind: str) -> Column:
    """The value of the row's cluster; null for rows without one, and for numbers beyond `kind`."""
    pairs = [F.lit(x) for i, v in values.items() for x in (i, str(v))]
    return F.create_map(*pairs)[F.col("cluster")].try_cast(kind) if pairs else F.lit(None).cast(kind)
