"""Clustering of integer vectors around centroids, the nearest one found by the threshold algorithm.

Every dimension has its centroids in a list sorted by their value there. From a vector's own value the lists are walked
outward, in each dimension the nearer side first; a centroid that is met for the first time gets its exact squared distance.
After every round of steps the squared distances of the frontiers, summed over the dimensions, bound from below what any
centroid that no list has shown yet can have; a vector is done when that sum strictly exceeds its best exact distance. As the
sum must exceed it strictly, a centroid of equal distance and smaller number is always met, and ties are exact.

A round of clustering is one pass over the vectors, which stand in the shared folder as integers. Tasks send their sums by
cluster and dimension, Spark adds them up, and what the driver gets is one row for each cluster and dimension.

Defined cases: vectors that are null, have another length than `dims`, or hold null or non-finite entries take no part, nor do
those with an entry of LARGEST and more after scaling, whose distances have no exact long; repeated rows count each; equal
vectors are as many; of rows with equal ids (null ids come last) the lesser vector starts first; fewer vectors than clusters
give as many clusters as vectors; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of that many dimensions, each component floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale < LARGEST)
    whole = F.transform(v, lambda e: F.floor(e * scale).cast("int"))
    return vectors.where((F.size(vector) == dims) & F.forall(v, fits)).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


class Walk:
    """The sorted lists of the centroids and the walk of many vectors along them."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.by = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.by, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, the smaller number where there are several."""
        n, (k, dims) = len(x), self.centroids.shape
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        seen = np.zeros((n, k), bool)
        right = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(dims)], 1) if n else np.zeros((0, dims), np.int64)
        left, row, each = right - 1, np.arange(n), np.arange(dims)
        while len(row):  # a step in every dimension of every vector that isn't done
            some = x[row]
            far = np.int64(1) << 40
            below = np.where(left >= 0, some - self.values[np.maximum(left, 0), each], far)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), each] - some, far)
            down = below <= above
            met = self.by[np.clip(np.where(down, left, right), 0, k - 1), each]
            frontier = np.minimum(below, above)
            left, right = left - down, right + ~down
            new = np.zeros((len(row), k), bool)
            np.put_along_axis(new, met, True, 1)
            new &= ~seen[row]
            seen[row] |= new
            for c in np.flatnonzero(new.any(0)):
                who = np.flatnonzero(new[:, c])
                d = np.square(some[who] - self.centroids[c]).sum(1)
                at = row[who]
                nearer = (d < best[at]) | (d == best[at]) & (c < number[at])
                best[at[nearer]], number[at[nearer]] = d[nearer], c
            more = (np.square(frontier).sum(1) <= best[row]) & ~seen[row].all(1)
            row, left, right = row[more], left[more], right[more]
        return number, best


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(centroids: np.ndarray):
    """One row for each cluster of a task: its vectors' number, the sum of their distances and their sums by dimension."""

    def run(batches):
        import pyarrow as pa

        k, dims = centroids.shape
        walk, count, cost, total = Walk(centroids), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = _matrix(b.column("x"), dims)
            number, distance = walk.nearest(x)
            np.add.at(total, number, x)
            np.add.at(cost, number, distance)
            count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        rows = [pa.array(some.astype(np.int32)), pa.array([[int(count[c]), int(cost[c]), *total[c].tolist()] for c in some], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["cluster", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        import pyarrow as pa

        walk = Walk(centroids)
        for b in batches:
            number, distance = walk.nearest(_matrix(b.column("x"), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """By non-empty cluster: number, summed distance, then the sums by dimension."""
    parts = vectors.select("x").mapInArrow(_sums(centroids), "cluster int, sums array<long>")
    rows = parts.select("cluster", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in rows.collect():  # clusters x (dimensions + 2)
        found.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    return {c: [t[i] for i in range(len(t))] for c, t in found.items()}


def cluster(vectors: DataFrame, order: Column, k: int, rounds: int) -> DataFrame:
    """vectors (vec_id, x) with cluster, distance, cluster_inertia, inertia and the final centroid as `centroid`. The k first
    vectors by `order` start; every round replaces a centroid by the floor of its vectors' mean, in every dimension."""
    stored = materialise(vectors, "whole_vectors")
    first = stored.orderBy(order, "x").limit(k).collect()
    schema = f"vec_id {stored.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    named = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], schema).join(spark.createDataFrame([], named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, _cost, *total) in _totals(stored, centroids).items():
            centroids[c] = [t // n for t in total]
    cost = {c: t[1] for c, t in _totals(stored, centroids).items()}
    ends = spark.createDataFrame([(c, v, sum(cost.values()), centroids[c].tolist()) for c, v in cost.items()], named)
    placed = stored.mapInArrow(_assigned(centroids), schema)
    return placed.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def digest(numbers: Column) -> Column:
    """Lower-case hex SHA-256 of the numbers in decimal, joined by commas."""
    return F.sha2(F.array_join(numbers.cast("array<string>"), ",").cast("binary"), 256)
