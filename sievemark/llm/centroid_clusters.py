"""Centroid clustering in exact integers, distances pruned by Ptolemy's inequality.

For four points of a Euclidean space |xp * cs - xs * cp| <= xc * ps. With a fixed pair of
pivots p, s the distance of a vector x to a centroid c is thus at least
|xp * cs - xs * cp| / ps.

1. Pivots are the vectors with the smallest hashes. The distances of every vector to them
   are computed once and stored with it; pivots never change, so they hold in all rounds.
2. A round knows the distances of its few centroids to the pivots. The largest bound over
   all pairs of pivots orders the centroids of a vector: the one of the smallest bound is
   measured exactly, then only those whose bound does not exceed it. Bounds are lowered by
   more than the arithmetic can have raised them, so a pruned centroid is never nearest
   nor tied.
3. Tasks return sums and counts by centroid; Spark adds them up. No row is shuffled and a
   round stores nothing: a lost executor repeats its tasks on the stored table.

Cases: vectors that are null, of another length, or hold null or non-finite components
are left out; with fewer vectors than centroids each vector has one; rows that repeat an
id are vectors of their own (ties of the start go by components), a null id starts last;
an empty table gives an empty result; other columns are not read. Distances beyond 64
bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import materialize
from sievemark.llm.vectors import (
    TOTALS_TYPE,
    Totals,
    exact,
    floored,
    grid,
    least_in_row,
    means,
    squared,
    whole,
)

# Relative error granted to bounds: some hundred units in the last place.
SLACK = 2.0**-44
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Clustering:
    """Components of a vector, their scale, centroids, rounds, pivots and seed."""

    dimensions: int = 64
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    pivots: int = 8
    seed: int = 3


class Nearest:
    """The nearest of some centroids, by pivot distances."""

    def __init__(self, pivots: list[list[int]], centroids: list[list[int]]) -> None:
        self.pivots = np.array(pivots, object)
        self.centroids = np.array(centroids, object)
        self.centre_far = roots(self.centroids, self.pivots)
        between = roots(self.pivots, self.pivots)
        self.pairs = [(p, s, between[p, s]) for p, s in combinations(range(len(pivots)), 2) if between[p, s] > 0]
        self.measured = self.asked = 0

    def bounds(self, far: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances (vector, centroid)."""
        low = np.zeros((len(far), len(self.centroids)))
        for p, s, apart in self.pairs:
            one = far[:, p, None] * self.centre_far[None, :, s]
            other = far[:, s, None] * self.centre_far[None, :, p]
            np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / apart, out=low)
        return low * (1 - SLACK)

    def of(self, points: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every row, ties to the smaller number."""
        points, centroids = exact(points, self.centroids)
        low = self.bounds(far)
        first = low.argmin(axis=1)
        reach = squared(points, centroids[first]).astype(float) * (1 + SLACK)
        open_ = low * low * (1 - SLACK) <= reach[:, None]
        open_[np.arange(len(points)), first] = True
        rows, entries = np.nonzero(open_)
        self.asked += open_.size
        self.measured += len(rows)
        return least_in_row(rows, entries, squared(points[rows], centroids[entries]), len(points))


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of two small or sliced matrices."""
    a, b = exact(a, b)
    return np.sqrt(np.stack([squared(a, one) for one in b], axis=1).astype(float))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(first, ROWS_AT_ONCE)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, spec: Clustering) -> DataFrame:
    """(id, point): the vectors to cluster, as integers."""
    vector = F.col(vector_col)
    good = vectors.where(whole(vector) & (F.size(vector) == spec.dimensions))
    return good.select(F.col(id_col).alias("id"), floored(vector, spec.scale).alias("point"))


def with_pivot_distances(points: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """(id, point, far): far holds the distances to the pivots."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(pivots, object)
        for batch in source:
            for part in slices(batch):
                far = roots(grid(part.column("point"), part.num_rows), at)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, far.size + 1, len(pivots)), pa.int32()), pa.array(far.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("point"), lists], names=["id", "point", "far"]
                )

    id_type = points.schema["id"].dataType.simpleString()
    return points.mapInArrow(batches, f"id {id_type}, point array<bigint>, far array<double>")


def totals(stored: DataFrame, pivots: list[list[int]], centroids: list[list[int]]) -> DataFrame:
    """Sums and counts by centroid, one small set of rows per task."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, found = Nearest(pivots, centroids), Totals(len(centroids), len(centroids[0]))
        for batch in source:
            for part in slices(batch):
                points = grid(part.column("point"), part.num_rows)
                cluster, _ = nearest.of(points, grid(part.column("far"), part.num_rows))
                found.add(cluster, exact(points)[0])
        yield found.batch()

    return stored.select("point", "far").mapInArrow(batches, TOTALS_TYPE)


def assigned(stored: DataFrame, pivots: list[list[int]], centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(pivots, centroids)
        for batch in source:
            for part in slices(batch):
                points = grid(part.column("point"), part.num_rows)
                cluster, distance = nearest.of(points, grid(part.column("far"), part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                    names=["id", "cluster", "distance"],
                )

    id_type = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(batches, f"id {id_type}, cluster int, distance bigint")


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", spec: Clustering = Clustering()
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every vector, final centroids). Centroids are as many
    as ``spec.clusters`` at most; nothing else passes through the driver."""
    points = kept_vectors(vectors, id_col, vector_col, spec)
    order = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("id").cast("string")), 256)
    heads = points.orderBy(F.asc_nulls_last(order), "point").limit(max(spec.clusters, spec.pivots))
    heads = [list(r.point) for r in heads.collect()]
    centroids, pivots = heads[: spec.clusters], heads[: spec.pivots]
    if not heads:
        kind = points.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance bigint"), []
    stored = materialize(with_pivot_distances(points, pivots), "cluster-points")
    for _ in range(spec.rounds):
        centroids = means(totals(stored, pivots, centroids), centroids)
    return assigned(stored, pivots, centroids), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", spec: Clustering = Clustering()
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the clusters
    with their summed distances and the digests of their centroids."""
    found, centroids = cluster_vectors(vectors, id_col, vector_col, spec)
    found = materialize(found, "clusters").withColumnRenamed("id", "vec_id")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    of_cluster = {r.cluster: int(r.d) for r in sums}  # one row per centroid
    per = F.array(*[F.lit(of_cluster.get(c, 0)).cast("long") for c in range(len(centroids))] or [F.lit(0).cast("long")])
    digests = F.array(*[F.lit(centroid_digest(c)) for c in centroids] or [F.lit("")])
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(per, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(of_cluster.values())).cast("long").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
