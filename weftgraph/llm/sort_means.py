"""Centroid clustering by sort-means, in exact integers.

A vector's components become whole numbers, floor(SCALE * x). Each round orders, for every centroid, all
others by their distance from it. A vector looks at the centroid that held it in the round before, then at
the others in that order, and stops at the first that lies strictly beyond twice the vector's distance
from where it began: by the triangle inequality neither that one nor any after it can be as near. (At
twice the distance exactly a tie is possible, so those are still looked at.) Compared are squares, in
64-bit integers, so the bound is four times the squared distance and nothing is rounded.

Vectors are stored once a round with the centroid that holds them. Sums are partial in each task, so a
round shuffles a row for each task and centroid; K centroids are all that the driver ever holds.

Defined results: vectors with other than WIDTH components, or with one that is null or not finite, are left
out, as are null vectors; a null id is a row like any other, but comes after all ids when centroids are
chosen; repeated rows are vectors each, and rows whose ids are equal are chosen by their components; equal
distances go to the smaller number, so of equal centroids the later stays empty; fewer vectors than K give
as many centroids; an empty table gives no rows. Components of 2**26 or more after scaling, for which
squared distances leave 64 bits, raise an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Scaled components are smaller than this.
LARGEST = 1 << 26
#: Vectors that one numpy step handles.
STEP = 4096


def _whole(vector: Column, width: int, scale: int) -> Column:
    """The vector in whole numbers, or null where it is left out."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fits = F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(LARGEST)))
    too_large = F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling")).cast("array<bigint>")
    return F.when((F.size(vector) == width) & finite, F.when(fits, scaled).otherwise(too_large))


def seats(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids in the order of their distance from it, itself first, and these distances (squared)."""
    gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    own = np.arange(len(centroids))
    for a in own:  # itself, also where an equal one has a smaller number
        at = int(np.flatnonzero(order[a] == a)[0])
        order[a, 1 : at + 1] = order[a, :at].copy()
        order[a, 0] = a
    return order, np.take_along_axis(gap, order, axis=1)


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), the squared distance, and how many were computed."""
    first = ((vectors - centroids[before]) ** 2).sum(axis=1)
    best, least, computed = before.copy(), first.copy(), len(vectors)
    left = np.arange(len(vectors))
    for place in range(1, len(centroids)):
        left = left[gap[before[left], place] <= 4 * first[left]]
        if not len(left):
            break
        other = order[before[left], place]
        far = ((vectors[left] - centroids[other]) ** 2).sum(axis=1)
        computed += len(left)
        better = (far < least[left]) | ((far == least[left]) & (other < best[left]))
        best[left[better]], least[left[better]] = other[better], far[better]
    return best, least, computed


def _assign(centroids: np.ndarray):
    order, gap = seats(centroids)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                vectors = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, centroids.shape[1])
                before = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                best, least, _ = nearest(vectors, before, centroids, order, gap)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "v", "cluster", "distance"])

    return go


def _moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact floor of each cluster's mean; a cluster without vectors keeps its centroid."""
    width = len(centroids[0])
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    out = list(centroids)
    for r in sums.collect():  # a row for each centroid at most
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def sort_means(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of every vector that is kept, v in whole numbers, and the final centroids."""
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _whole(F.col(vector), width, scale).alias("v")).where("v is not null")
    state = stored(kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "means-state")
    lots = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = state.select("v", lots.alias("lot"), "vec_id").orderBy(F.col("lot").asc_nulls_last(), "vec_id", "v").limit(k)
    centroids = [list(r.v) for r in chosen.collect()]
    if not centroids:
        return state, centroids
    for _ in range(rounds):
        state = _assigned(state, centroids)
        centroids = _moved(state, centroids)
    return _assigned(state, centroids), centroids


def _assigned(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    go = _assign(np.array(centroids, np.int64))
    return stored(state.select("vec_id", "v", "cluster").mapInArrow(go, "vec_id long, v array<long>, cluster int, distance long"), "means-state")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", **how: int) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids = sort_means(vectors, vec_id, vector, **how)
    by = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid at most
    every = F.lit(sum(by.values())).cast("long")
    if not centroids:
        return state.select("vec_id", "cluster", "distance", every.alias("cluster_inertia"), every.alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = F.array(*[F.lit(by.get(c, 0)).cast("long") for c in range(len(centroids))])[F.col("cluster")]
    sha = F.array(*[F.lit(digest(c)) for c in centroids])[F.col("cluster")]
    return state.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), every.alias("inertia"), sha.alias("centroid_sha256"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql_round(r: int) -> str:
    """Assignment to the centroids c{r} as a{r}, and the centroids c{r+1} that follow."""
    return f"""
a{r} AS (SELECT i, c AS cluster, d AS distance FROM (
  SELECT k.i, c{r}.c, list_sum(list_transform(list_zip(k.v, c{r}.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
         row_number() OVER (PARTITION BY k.i ORDER BY d, c{r}.c) AS n FROM kept k, c{r}) WHERE n = 1),
s{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (
  SELECT a.cluster, j, sum(k.v[j])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN kept k USING (i), range(1, {WIDTH + 1}) AS t(j) GROUP BY 1, 2) GROUP BY 1),
c{r + 1} AS (SELECT c{r}.c, coalesce(s.m, c{r}.m) AS m FROM c{r} LEFT JOIN s{r} s ON s.cluster = c{r}.c),"""


OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: isfinite(x))) = {WIDTH}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id, v) - 1 AS c, v AS m FROM kept QUALIFY c < {K}),
{"".join(_sql_round(r) for r in range(ROUNDS + 1))}
own AS (SELECT cluster, sum(distance)::BIGINT AS s FROM a{ROUNDS} GROUP BY 1)
SELECT k.vec_id, a.cluster::INTEGER AS cluster, a.distance, own.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM own) AS inertia,
       sha256(array_to_string(c{ROUNDS}.m, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (i) JOIN own USING (cluster) JOIN c{ROUNDS} ON c{ROUNDS}.c = a.cluster
"""
