"""Centroid clustering of integer vectors with n-simplex bounds.

Distances of a vector to a few pivots are computed once and stored. With the pivots as
base, they are the edges of a simplex whose apex is the vector; the Euclidean distance
of two apexes is a lower bound of the vectors' distance, that with one apex mirrored at the
base an upper one. In each round the apexes of the centroids are compared with those of the
vectors; only centroids whose lower bound does not exceed the least upper bound are
compared exactly, in integers. A margin far above rounding errors is left on both bounds.

Rounds are one narrow pass each: tasks sum up their vectors per centroid, Spark merges these
sums, and only the centroids (``k`` rows) pass the driver.

Defined results: kept are vectors with exactly ``dimensions`` components, none null, not a number,
infinite or of ``LARGEST`` and more (their squared distances would pass a long); all others
have no row. A tie goes to the smaller centroid. Repeated rows are vectors of their own; a null
id is hashed as empty and passed on; vectors with the same hash are ordered by components;
with fewer than ``k`` vectors each is a centroid; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import store

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
PIVOTS = 12
# Vectors, those first by hash, that the pivots are chosen from.
PIVOT_SAMPLE = 256
LARGEST = float(1 << 21)
MARGIN = 1e-6
BATCH = 4096


@dataclass
class Base:
    """Pivots and their simplex: ``vertices`` is lower triangular, one row for each pivot but the first."""

    pivots: np.ndarray
    vertices: np.ndarray

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates of vectors with these squared distances to the pivots; the last is the altitude."""
        squares = squares.astype(np.float64)
        if len(self.vertices):
            right = 0.5 * (squares[:, :1] - squares[:, 1:] + (self.vertices**2).sum(1))
            own = np.linalg.solve(self.vertices, right.T).T
        else:
            own = np.zeros((len(squares), 0))
        return np.hstack([own, np.sqrt(np.maximum(0, squares[:, 0] - (own**2).sum(1)))[:, None]])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact, of each row of ``a`` to each of ``b``."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def base_of(sample: np.ndarray, pivots: int = PIVOTS) -> Base:
    """The farthest vector from the sample's first one, then each time that of greatest altitude over the simplex so far."""
    squares = squared_distances(sample, sample[:1])
    chosen = [int(squares[:, 0].argmax())]
    base = Base(sample[chosen], np.zeros((0, 0)))
    squares = squared_distances(sample, base.pivots)
    least = 1e-3 * np.sqrt(squares.max(initial=0))
    while len(chosen) < pivots:
        apexes = base.apexes(squares)
        best = int(apexes[:, -1].argmax())
        if apexes[best, -1] <= least:
            break  # the sample has no further direction
        size = len(chosen)
        grown = np.zeros((size, size))
        grown[: size - 1, : size - 1] = base.vertices
        grown[size - 1] = apexes[best]
        chosen.append(best)
        base = Base(sample[chosen], grown)
        squares = np.hstack([squares, squared_distances(sample, sample[[best]])])
    return base


def candidates(apexes: np.ndarray, centroid_apexes: np.ndarray) -> np.ndarray:
    """Per vector and centroid, whether it can be the nearest."""
    flat = ((apexes[:, None, :-1] - centroid_apexes[None, :, :-1]) ** 2).sum(2)
    own, other = apexes[:, None, -1], centroid_apexes[None, :, -1]
    lower, upper = np.sqrt(flat + (own - other) ** 2), np.sqrt(flat + (own + other) ** 2)
    return lower <= upper.min(1, keepdims=True) * (1 + MARGIN) + MARGIN * (1 + own + np.abs(apexes[:, :-1]).max(1, initial=0)[:, None])


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, base: Base) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroid and squared distance of each vector, and the number of pairs compared exactly."""
    open_pairs = candidates(apexes, base.apexes(squared_distances(centroids, base.pivots)))
    best, cluster = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for i, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_pairs[:, i])
        found = ((vectors[rows] - centroid) ** 2).sum(1)
        closer = found < best[rows]
        best[rows[closer]], cluster[rows[closer]] = found[closer], i
    return cluster, best, int(open_pairs.sum())


def integers(column: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector is kept, and its integer components."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    kept = F.coalesce(F.size(column) == dimensions, F.lit(False)) & ~F.coalesce(odd, F.lit(True))
    return kept, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def with_distances(vectors: DataFrame, base: Base, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vectors`` (vec_id, v) and ``squares``, the exact squared distances to the pivots. A stored table."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = squared_distances(_matrix(batch.column("v"), dimensions), base.pivots)
            squares = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), squares], ["vec_id", "v", "squares"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return store(vectors.mapInArrow(measure, f"vec_id {kind}, v array<int>, squares array<long>"), "vectors")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, base: Base) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _matrix(batch.column("v"), centroids.shape[1])
    apexes = base.apexes(_matrix(batch.column("squares"), len(base.pivots)))
    return vectors, *nearest(vectors, apexes, centroids, base)[:2]


def next_centroids(measured: DataFrame, centroids: np.ndarray, base: Base) -> np.ndarray:
    """Floors of the componentwise means; a centroid without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in _batches(batches):
            vectors, cluster, _ = _assigned(batch, centroids, base)
            np.add.at(total, cluster, vectors)
            count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    parts = measured.select("v", "squares").mapInArrow(sums, "cluster int, n long, total array<long>")
    # One row per centroid and component.
    merged = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x")
    )
    out = centroids.copy()
    for row in merged.collect():
        out[row.cluster, row.i] = row.x // row.n
    return out


def start(vectors: DataFrame, k: int = CENTROIDS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """The vectors first by hash of their ids, at most ``max(k, sample)``, in this order."""
    ranked = vectors.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    rows = ranked.orderBy("h", "v").limit(max(k, sample)).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(
    embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE
) -> tuple[DataFrame, np.ndarray]:
    """A stored table with vec_id, cluster and distance (squared) of every kept vector, and the final centroids."""
    kept, parts = integers(F.col("embedding"), dimensions)
    vectors = embeddings.where(kept).select("vec_id", parts.alias("v"))
    first = start(vectors, k, sample)
    if not len(first):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    base = base_of(first, pivots)
    measured = with_distances(vectors, base, dimensions)
    centroids = first[:k]
    for _ in range(rounds):
        centroids = next_centroids(measured, centroids, base)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            _, own, distance = _assigned(batch, centroids, base)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = measured.schema["vec_id"].dataType.simpleString()
    return store(measured.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256 of each row's cluster."""
    spark = assigned.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # A row per centroid.
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(
        F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster"
    )
    total = assigned.agg(F.sum("distance").alias("inertia"))
    return assigned.join(F.broadcast(inertia), "cluster").join(F.broadcast(total), F.lit(True)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
