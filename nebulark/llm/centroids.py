"""Centroid clustering with PCA-rotated filtering; distances are exact integers.

A vector is kept if it has the wanted number of components, none null, NaN or infinite; each
component x becomes floor(scale * x).  One pass over all kept vectors gives their covariance, whose
leading eigenvectors rotate them.  The stored table has, beside the integers, the ``leading`` rotated
coordinates and the norm of the rest.  Rotation keeps distances, and the rests of two vectors are at
least as far apart as their norms differ, so

    squared projected distance + (difference of residual norms) ** 2

never exceeds the squared distance.  A round verifies the centroid with the smallest bound in
integers, then only those whose bound does not exceed what it found.  A task gives one row a
centroid and component, so a round shuffles sums only and the centroids are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nebulark.llm._common import materialize

COMPONENTS, SCALE, CLUSTERS, ROUNDS, LEADING = 64, 1024, 8, 10, 16
#: Integer components stay below this, so that a squared distance of 64 components fits a long.
LARGEST = 1 << 27
#: The bounds are floating-point numbers: by this part, and by this much, they are taken as smaller.
SLACK, SLACK_LEAST = 1e-9, 1e-3


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<long>) of the rows that are kept; an error where a component leaves the range of integers."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    value = F.transform(v, lambda x: F.floor(F.when(F.abs(x.cast("double")) * scale < LARGEST, x.cast("double") * scale).otherwise(F.raise_error(F.lit(f"component beyond {LARGEST // scale}")).cast("double"))))
    return vectors.where((F.size(v) == components) & whole).select(F.col(id_col).alias("vec_id"), value.cast("array<long>").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def first_centroids(kept: DataFrame, clusters: int, salt: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``salt:vec_id``, in that order; of one id, the smaller vector first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()]


def rotation(kept: DataFrame, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of all vectors and the ``leading`` main axes (columns): sums of a row a pair of components and task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0)).astype(np.float64)
                n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        if n:
            d = len(one)
            i, j = (g.ravel() for g in np.mgrid[-1:d, 0:d])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.vstack([one, two]).ravel()), pa.array(np.full(d * (d + 1), n))], names=["i", "j", "s", "n"])

    sums = kept.select("v").mapInArrow(moments, "i long, j long, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    d = 1 + max(r.j for r in sums)
    mean, second = np.zeros(d), np.zeros((d, d))
    for r in sums:
        if r.i < 0:
            mean[r.j] = r.s / r.n
        else:
            second[r.i, r.j] = r.s / r.n
    _, axes = np.linalg.eigh(second - np.outer(mean, mean))  # ascending
    return mean, np.ascontiguousarray(axes[:, ::-1][:, : min(leading, d)])


def rotate(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates of the rows of ``x``, and the norms of what they leave."""
    centred = x - mean
    z = centred @ axes
    return z, np.sqrt(np.maximum((centred * centred).sum(1) - (z * z).sum(1), 0.0))


def store(kept: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """The table that the rounds read: vec_id, v, z (leading rotated coordinates), rest (norm of the others)."""
    schema = T.StructType([*kept.schema.fields, T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z, rest = rotate(_matrix(b.column("v")).astype(np.float64), mean, axes)
            at = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.ListArray.from_arrays(at, pa.array(z.ravel())), pa.array(rest)], names=["vec_id", "v", "z", "rest"])

    return kept.mapInArrow(run, schema)


def nearest(x: np.ndarray, z: np.ndarray, rest: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row (ties: smaller number), and the centroids verified for it."""
    cz, crest = rotate(centroids.astype(np.float64), mean, axes)
    bound = np.stack([((z - a) ** 2).sum(1) + (rest - b) ** 2 for a, b in zip(cz, crest, strict=True)], 1)
    bound = bound * (1 - SLACK) - SLACK_LEAST
    best = bound.argmin(1)
    distance = ((x - centroids[best]) ** 2).sum(1)
    first, verified = best.copy(), np.ones(len(x), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= distance) & (first != c))
        d = ((x[rows] - centroids[c]) ** 2).sum(1)
        verified[rows] += 1
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best, distance, verified


def _round_sums(stored: DataFrame, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums of the vectors by (nearest centroid, component); component -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        sums = np.zeros((k, d + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                best, _, _ = nearest(x, _matrix(b.column("z")), b.column("rest").to_numpy(), centroids, mean, axes)
                for c in np.unique(best):
                    own = x[best == c]
                    sums[c, 0] += len(own)
                    sums[c, 1:] += own.sum(0)
        i, j = (g.ravel() for g in np.mgrid[0:k, -1:d])
        some = np.repeat(sums[:, 0] > 0, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i[some]), pa.array(j[some]), pa.array(sums.ravel()[some])], names=["c", "j", "s"])

    rows = stored.select("v", "z", "rest").mapInArrow(run, "c long, j long, s long").groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r.c, r.j): int(r.s) for r in rows.collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: int = 3, leading: int = LEADING, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, verified, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length or with a null, NaN or infinite component have no row.  Centroids start
    as the kept vectors first in hash order (null ids last); with fewer vectors there are fewer, and
    repeated rows may start several of them.  A tie goes to the smaller number, so of equal centroids
    the later ones stay empty and as they are.  Components whose scaled size reaches 2**27 are an error.
    Ids may be null or repeated; empty input gives no rows; other columns are ignored.
    """
    kept = kept_vectors(vectors, id_col, vector_col, components, scale)
    start = first_centroids(kept, clusters, salt)
    out_schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("verified", T.IntegerType())])
    spark = vectors.sparkSession
    if not start:
        none = spark.createDataFrame([], out_schema)
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    mean, axes = rotation(kept, leading)
    stored = materialize(store(kept, mean, axes), "centroid-vectors")
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        sums = _round_sums(stored, centroids, mean, axes)
        moved = centroids.copy()
        for c in range(len(moved)):
            if n := sums.get((c, -1)):
                moved[c] = [sums[c, j] // n for j in range(moved.shape[1])]
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, distance, verified = nearest(_matrix(b.column("v")), _matrix(b.column("z")), b.column("rest").to_numpy(), centroids, mean, axes)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance), pa.array(verified.astype(np.int32))], names=out_schema.names)

    found = materialize(stored.mapInArrow(assign, out_schema), "centroid-assigned")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "__c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("__c")).drop("__c")  # a row a cluster
