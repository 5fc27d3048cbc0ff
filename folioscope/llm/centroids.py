"""Clustering around centroids in exact integers, with most of the arithmetic in float32.

A vector's components become integers, ``floor(scale * x)``. The nearest centroid is that of the least squared Euclidean
distance, the one with the smallest number if several have it. Comparing distances means comparing ``|c|^2 - 2 x.c``:

1. Screening: ``x.c`` for all vectors of a block and all centroids is one float32 matrix product. Components below 2^24 are exact
   in float32, and n products summed in any order, with or without fused steps, err by at most ``n u / (1 - n u) * |x| |c|``
   with ``u = 2^-24`` (Cauchy-Schwarz on the usual bound; sums of integers don't underflow). That makes an interval for each
   centroid; those whose interval begins above the least upper end can't be nearest.
2. Where one centroid is left it is the nearest. Where several are, their distances are computed in integers.
3. Components from 2^24 on, or centroids beyond 2^26, take Python's integers, which have no bound.

Rounds run as Spark jobs over a stored table of vectors: centroids (a few) go out with the tasks, one partial sum for each
centroid and component comes back from each task and is added by Spark, and the driver gets the sums of all. Partial sums are
written in base 2^96, so that they are exact at any size. Vectors are never shuffled, so clusters and equal vectors may be as
large as they like.

Cases: vectors that are null, of another length, or hold null, NaN or infinite components are left out; a null id is written as
an empty text where ids are hashed; equal ids of starting vectors are ordered by their components; with fewer vectors than
centroids there are as many centroids as vectors; an empty centroid stays where it is; repeated rows count each; squared
distances or their sums beyond a long are null; an empty table gives an empty frame; other columns are ignored, whatever they
are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, materialised

#: Largest whole number up to which all are float32 values.
_EXACT = 1 << 24
#: Centroids up to here keep differences' squares and their sums within 64 bits, for up to 2^9 components.
_LARGE = 1 << 26
_BASE = 1 << 96
#: Vectors that are compared at a time.
BLOCK = 4096

Centroids = list[tuple[int, ...]]


def usable(vector: Column, n: int) -> Column:
    """True if a vector has n components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == n) & finite, F.lit(False))


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 1 << 53 else floor(x * scale)


class Screen:
    """Finds nearest centroids. ``recomputed`` counts the vectors that the intervals alone don't decide."""

    def __init__(self, centroids: Centroids, scale: int):
        self.exact, self.scale, self.recomputed = centroids, scale, 0
        self.plain = all(abs(x) <= _LARGE for c in centroids for x in c)
        if self.plain:
            self.whole = np.array(centroids, dtype=np.int64)
            squares = [sum(x * x for x in c) for c in centroids]
            n = len(centroids[0])
            u = n * 2.0**-24
            self.squares = np.array(squares, dtype=np.float64)
            # float32 centroids are rounded beyond 2^24: one more relative u for each product; the factor covers float64's own rounding
            self.single, self.slack = self.whole.astype(np.float32), 2.0 * (u / (1 - u) + 2.0**-23) * np.sqrt(self.squares) * (1 + 1e-9)

    def _by_integers(self, x: list[int]) -> tuple[int, int]:
        distance, nearest = min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(self.exact))
        return nearest, distance

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]], dict[int, int]]:
        """Of float64 vectors: nearest centroids; the whole components (zeros where they are large); those of large vectors by
        row, and their distances."""
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * self.scale)
        odd = np.flatnonzero(~(np.abs(scaled) < _EXACT).all(axis=1)) if self.plain else np.arange(len(vectors))
        large, far, chosen = {}, {}, np.zeros(len(vectors), dtype=np.int64)
        for i in odd.tolist():
            large[i] = [_whole(x, self.scale) for x in vectors[i].tolist()]
            chosen[i], far[i] = self._by_integers(large[i])
        scaled[odd] = 0
        whole = scaled.astype(np.int64)
        if self.plain and len(odd) < len(vectors):
            x = whole.astype(np.float32)
            value = self.squares - 2.0 * (x @ self.single.T).astype(np.float64)
            length = np.sqrt((whole * whole).sum(axis=1, dtype=np.int64).astype(np.float64))
            # the last term covers float64's rounding of the value itself
            error = length[:, None] * self.slack + (self.squares + np.abs(value)) * 2.0**-50
            left = value - error <= (value + error).min(axis=1, keepdims=True)
            single = left.argmax(axis=1)
            several = left.sum(axis=1) > 1
            several[odd] = False
            self.recomputed += int(several.sum())
            if several.any():
                distance = ((whole[several][:, None, :] - self.whole[None]) ** 2).sum(axis=2)
                distance[~left[several]] = np.iinfo(np.int64).max
                single[several] = distance.argmin(axis=1)  # the first of equal ones
            single[odd] = chosen[odd]
            chosen = single
        return chosen, whole, large, far

    def distances(self, chosen: np.ndarray, whole: np.ndarray, far: dict[int, int]) -> list[int]:
        found = ((whole - self.whole[chosen]) ** 2).sum(axis=1).tolist() if self.plain else [0] * len(chosen)
        for i, d in far.items():
            found[i] = d
        return found


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            yield block, np.asarray(block.column("_vector").flatten()).reshape(-1, n)


def _partial_sums(centroids: Centroids, scale: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids, scale)
        counts, sums = [0] * len(centroids), [[0] * n for _ in centroids]
        for _, vectors in _blocks(batches, n):
            chosen, whole, large, _ = screen.nearest(vectors)
            for k in np.unique(chosen).tolist():
                mine = chosen == k
                counts[k] += int(mine.sum())
                sums[k] = [a + b for a, b in zip(sums[k], whole[mine].sum(axis=0).tolist())]
            for i, x in large.items():
                sums[chosen[i]] = [a + b for a, b in zip(sums[chosen[i]], x)]
        rows = []
        for k, count in enumerate(counts):
            for component, total in enumerate([count, *sums[k]] if count else []):
                sign, total, place = (-1 if total < 0 else 1), abs(total), 0
                while total or not place:
                    rows.append((k, component, place, str(sign * (total % _BASE))))
                    total, place = total // _BASE, place + 1
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["k", "component", "place", "total"])

    return lean(run)


def _moved(vectors: DataFrame, centroids: Centroids, scale: int, n: int) -> Centroids:
    """One round: where the centroids go."""
    parts = vectors.select("_vector").mapInArrow(_partial_sums(centroids, scale, n), "k int, component int, place int, total string")
    found: dict[tuple[int, int], int] = {}
    for k, component, place, total in parts.groupBy("k", "component", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found[k, component] = found.get((k, component), 0) + int(total) * _BASE**place
    return [tuple(found[k, c + 1] // found[k, 0] for c in range(n)) if (k, 0) in found else old for k, old in enumerate(centroids)]


def _assigned(centroids: Centroids, scale: int, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids, scale)
        for block, vectors in _blocks(batches, n):
            chosen, whole, _, far = screen.nearest(vectors)
            distances = [d if d < 1 << 63 else None for d in screen.distances(chosen, whole, far)]
            yield pa.RecordBatch.from_arrays([block.column("_id"), pa.array(chosen, pa.int32()), pa.array(distances, pa.int64())], names=["_id", "_cluster", "_distance"])

    return lean(run)


def cluster(
    table: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", n: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, start: str = "3:"
) -> tuple[DataFrame, Centroids]:
    """Vectors with their centroids after so many rounds, and the centroids.

    The frame has the id, ``cluster`` and ``distance`` (squared). The start is the k usable vectors whose SHA-256 hex text of
    ``start`` and id is smallest, in that order.
    """
    spark = table.sparkSession
    kept = table.select(F.col(id_column).alias("_id"), F.col(vector).cast("array<double>").alias("_vector")).where(usable(F.col("_vector"), n))
    kept = materialised(kept, "vectors")
    hashed = F.sha2(F.concat(F.lit(start), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    centroids: Centroids = [tuple(_whole(x, scale) for x in row[0]) for row in kept.orderBy(hashed, "_vector").limit(k).select("_vector").collect()]
    id_type = kept.schema["_id"].dataType.simpleString()
    names = f"{id_column} {id_type}, cluster int, distance bigint"
    if not centroids:
        return spark.createDataFrame([], names), centroids
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale, n)
    found = materialised(kept.mapInArrow(_assigned(centroids, scale, n), f"_id {id_type}, _cluster int, _distance bigint"), "assigned")
    return found.select(F.col("_id").alias(id_column), F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance")), centroids


def clusters_with_inertia(table: DataFrame, **options) -> DataFrame:
    """``cluster`` with, per vector, ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256`` (of the centroid's components, joined by commas)."""
    found, centroids = cluster(table, **options)
    hashes = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    named = found.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    total, whole = F.sum(F.col("distance").cast("decimal(38,0)")), F.count("*") == F.count("distance")
    sums = found.groupBy("cluster").agg(F.when(whole, total).alias("of_cluster")).join(F.broadcast(named), "cluster")
    every = sums.agg(F.when(F.count("*") == F.count("of_cluster"), F.sum("of_cluster")).alias("of_all"))
    sums = sums.crossJoin(F.broadcast(every)).select("cluster", F.expr("try_cast(of_cluster as bigint)").alias("cluster_inertia"), F.expr("try_cast(of_all as bigint)").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(sums), "cluster").select(*found.columns, "cluster_inertia", "inertia", "centroid_sha256")
