"""Exact dense top-k: the most similar vectors by cosine, with partitions and the triangle inequality.

Index. Centres come from a bounded sample; every vector is scaled to length 1 and goes to its nearest
centre. The members of a centre are sorted by their distance to it and cut into blocks of bounded
size: a block is a ring around its centre, stored as one matrix.

Search. Each query first scores the ring of its nearest centre that lies at its own distance.
The k-th best found bounds the distance D of all that can still enter, so that only rings within
[d - D, d + D] of a centre at distance d are scored, as products of blocks of vectors with
blocks of queries. Each product keeps k rows a query, and the last ranking is pruned on the map side. Nothing
is approximate, and no part of either table has to fit in one task: a hot centre is many
blocks, and many queries for one block are many tasks.

Rows with another number of components, or with a component that is null or not finite, and
vectors of length 0, which have no direction, are not indexed and find nothing. Query ids are unique.
Similarities equal in ``RANK_DIGITS`` decimals are ranked by vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import broadcast_if_small, store

TOP_K = 20
RANK_DIGITS = 6
BLOCK_ROWS = 2048
QUERY_ROWS = 1024
# Centres are sent to every task: 4 096 of 1 000 components are 32 MB.
MOST_CENTRES = 4096
SAMPLE_PER_CENTRE = 16
# Left open at every bound; far above rounding errors.
MARGIN = 2e-6


@dataclass(frozen=True)
class DenseIndex:
    centres: np.ndarray  # one row each, of length 1
    blocks: DataFrame    # block, part, n, low, high (distances to the centre), ids, matrix (float64, row by row)
    id_type: str

    @property
    def dimensions(self) -> int:
        return self.centres.shape[1]


def usable(vector: Column, dimensions: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dimensions: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    # Scaled by the largest component first, so that no square is lost.
    rows = rows / np.abs(rows).max(1, initial=0)[:, None]
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * units @ centres.T))


def centres_of(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Directions of the means of a few rounds of k-means on a sample of unit vectors."""
    centres = sample[:count].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums**2).sum(1))
        kept = length > 1e-9
        centres[kept] = sums[kept] / length[kept, None]
    return centres


def build_index(vectors: DataFrame, dimensions: int | None = None, centres: int | None = None, block_rows: int = BLOCK_ROWS) -> DenseIndex:
    """Index of ``vectors`` (vec_id, vector).

    ``dimensions``: the commonest number of components if not given. ``centres``: a quarter of
    the root of the number of vectors if not given, within 16 and ``MOST_CENTRES``.
    """
    if dimensions is None:
        commonest = vectors.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
        dimensions = commonest.n if commonest else 1
    rows = vectors.where(usable(F.col("vector"), dimensions)).select("vec_id", "vector")
    if centres is None:
        centres = min(MOST_CENTRES, max(16, math.ceil(math.sqrt(rows.count()) / 4)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_PER_CENTRE * centres).select("vector").toArrow()
    units = _units(sample["vector"].combine_chunks(), dimensions)
    middle = centres_of(units, centres) if len(units) else np.eye(1, dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _units(batch.column("vector"), dimensions)
            away = _distances(own, middle)
            part = away.argmin(1)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "part": pa.array(part.astype(np.int32)),
                "away": pa.array(away[np.arange(len(part)), part]), "unit": pa.array([u.tobytes() for u in own], pa.binary()),
            })

    id_type = rows.schema["vec_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id {id_type}, part int, away double, unit binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.Table] = []

        def blocks(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            nonlocal number
            out = []
            part = rows["part"].to_numpy()
            at = 0
            while at < len(part):
                end = min(at + block_rows, int(np.searchsorted(part, part[at], "right")))
                if end == len(part) and end - at < block_rows and not last:
                    break
                own = rows.slice(at, end - at)
                away = own["away"].to_numpy()
                out.append(pa.RecordBatch.from_pydict({
                    "block": pa.array([start + number]), "part": pa.array([int(part[at])], pa.int32()), "n": pa.array([end - at]),
                    "low": pa.array([away.min()]), "high": pa.array([away.max()]),
                    "ids": pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), own["vec_id"].combine_chunks()),
                    "matrix": pa.array([b"".join(own["unit"].to_pylist())], pa.binary()),
                }))
                number += 1
                at = end
            return out, rows.slice(at)

        for batch in batches:
            held = [*held, pa.Table.from_batches([batch])]
            found, rest = blocks(pa.concat_tables(held), False)
            held = [rest]
            yield from found
        if held:
            yield from blocks(pa.concat_tables(held), True)[0]

    # By range, with a last key that tells copies apart, so that neither a hot centre nor copies are one task.
    keys = ["part", "away", F.xxhash64("vec_id")]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = f"block long, part int, n long, low double, high double, ids array<{id_type}>, matrix binary"
    return DenseIndex(middle, store(ordered.mapInArrow(cut, schema), "dense-blocks"), id_type)


def _rings(index: DenseIndex) -> DataFrame:
    return broadcast_if_small(index.blocks.select("block", "part", "n", "low", "high"))


def prepared_queries(queries: DataFrame, index: DenseIndex) -> DataFrame:
    """Stored table: query_id, unit, part (nearest centre), away."""
    own = queries.where(usable(F.col("vector"), index.dimensions)).select("query_id", "vector")
    centres, dimensions = index.centres, index.dimensions

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column("vector"), dimensions)
            away = _distances(units, centres)
            part = away.argmin(1)
            yield pa.RecordBatch.from_pydict({
                "query_id": batch.column("query_id"), "unit": pa.array([u.tobytes() for u in units], pa.binary()),
                "part": pa.array(part.astype(np.int32)), "away": pa.array(away[np.arange(len(part)), part]),
            })

    kind = own.schema["query_id"].dataType.simpleString()
    return store(own.mapInArrow(near, f"query_id {kind}, unit binary, part int, away double"), "dense-queries")


def first_pairs(asked: DataFrame, index: DenseIndex) -> DataFrame:
    """query_id, block, n: for each query, the ring of its nearest centre that lies at its own distance."""
    gap = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"), F.lit(0.0))
    met = asked.select("query_id", "part", "away").join(_rings(index), "part")
    return met.groupBy("query_id").agg(F.min_by(F.struct("block", "n"), F.struct(gap, "block")).alias("b")).select("query_id", "b.*")


def open_pairs(asked: DataFrame, bounds: DataFrame, index: DenseIndex) -> DataFrame:
    """query_id, block, n of all rings that can hold a better vector than ``bounds`` (query_id, reach: its largest distance)."""
    reach = index.blocks.groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row per centre
    low, high = np.full(len(index.centres), np.inf), np.full(len(index.centres), -np.inf)
    for r in reach:
        low[r.part], high[r.part] = r.low, r.high
    centres, dimensions = index.centres, index.dimensions

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(-1, dimensions)
            away, far = _distances(units, centres), batch.column("reach").to_numpy(zero_copy_only=False)[:, None]
            row, part = np.nonzero((low <= away + far) & (high >= away - far))
            yield pa.RecordBatch.from_pydict({
                "query_id": batch.column("query_id").take(pa.array(row)), "part": pa.array(part.astype(np.int32)),
                "inner": pa.array((away - far)[row, part]), "outer": pa.array((away + far)[row, part]),
            })

    kind = asked.schema["query_id"].dataType.simpleString()
    known = asked.select("query_id", "unit").join(bounds, "query_id")
    parts = known.select("query_id", "unit", "reach").mapInArrow(near, f"query_id {kind}, part int, inner double, outer double")
    return parts.join(_rings(index), "part").where("low <= outer and high >= inner").select("query_id", "block", "n")


def scored(pairs: DataFrame, asked: DataFrame, index: DenseIndex, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id, similarity: of each pair (query_id, block), the k best. ``asked`` holds query_id and unit."""
    shares = max(1, math.ceil(asked.count() / query_rows))
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
    wanted = store(pairs.select("query_id", "block", share.alias("share")), "dense-pairs")
    left = wanted.join(asked.select("query_id", "unit"), "query_id").select(
        F.col("block").alias("own_block"), F.col("share").alias("own_share"), "query_id", "unit")
    right = index.blocks.join(wanted.select("block", "share").distinct(), "block").select("block", "share", "ids", "matrix")
    dimensions = index.dimensions

    def product(queries: pa.Table, block: pa.Table) -> pa.Table:
        units = np.frombuffer(b"".join(queries["unit"].to_pylist()), np.float64).reshape(-1, dimensions)
        ids = block["ids"].combine_chunks().flatten()
        members = np.frombuffer(block["matrix"][0].as_py(), np.float64).reshape(-1, dimensions)
        # Place of each member by id, to rank ties.
        order = np.argsort(pa.compute.sort_indices(ids).to_numpy())
        similarity = units @ members.T
        rounded = np.round(similarity, RANK_DIGITS)
        rows, places = [], []
        for i, own in enumerate(rounded):
            best = np.arange(len(own)) if len(own) <= k else np.flatnonzero(own >= np.partition(own, -k)[-k])
            best = best[np.lexsort((order[best], -own[best]))[:k]]
            rows.append(np.full(len(best), i))
            places.append(best)
        row, place = np.concatenate(rows), np.concatenate(places)
        return pa.table({"query_id": queries["query_id"].take(pa.array(row)), "vec_id": ids.take(pa.array(place)),
                         "similarity": pa.array(similarity[row, place])})

    kind = asked.schema["query_id"].dataType.simpleString()
    return left.groupBy("own_block", "own_share").cogroup(right.groupBy("block", "share")).applyInArrow(
        product, f"query_id {kind}, vec_id {index.id_type}, similarity double"
    )


def reach_of(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, reach: the distance of the k-th best hit so far, with a margin; 2, which all are within, where there are fewer."""
    kth = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("similarity").alias("least"))
    distance = F.sqrt(F.greatest(2 - 2 * (F.col("least") - MARGIN), F.lit(0.0))) + MARGIN
    return asked.select("query_id").join(kth, "query_id", "left").select(
        "query_id", F.when(F.col("hits") >= k, distance).otherwise(2 + MARGIN).alias("reach")
    )


def search(queries: DataFrame, index: DenseIndex, k: int = TOP_K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id, similarity, rank of the ``k`` most similar vectors of each of ``queries`` (query_id, vector)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = prepared_queries(queries, index)
    first = store(first_pairs(asked, index), "dense-first")
    found = store(scored(first, asked, index, k, query_rows), "dense-hits")
    rest = open_pairs(asked, reach_of(found, asked, k), index).join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    hits = found.unionByName(scored(rest, asked, index, k, query_rows))
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", RANK_DIGITS).desc(), "vec_id")
    # row_number is pruned to k per task before the shuffle.
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
