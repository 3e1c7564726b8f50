import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import dense


@pytest.fixture
def vectors_of(spark):
    return lambda rows, name="vec_id": spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{name} long, vector array<double>")


def brute(queries, rows, k, dimensions):
    def unit(v):
        if v is None or len(v) != dimensions or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    kept = [(i, u) for i, u in ((i, unit(v)) for i, v in rows) if u is not None]
    out = []
    for q, v in queries:
        u = unit(v)
        if u is not None:
            found = sorted((-round(float(u @ w), 6), i) for i, w in kept)[:k]
            out += [(q, i, rank, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def found(hits):
    return sorted((r.query_id, r.vec_id, r.rank, round(r.similarity, 6) + 0.0) for r in hits.collect())


def same(got, wanted):
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert np.allclose([g[3] for g in got], [w[3] for w in wanted], atol=2e-6)


def drawn(n, seed, dimensions=8, groups=12, spread=0.1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dimensions))
    return [(i, (middles[i % groups] * rng.uniform(0.5, 2) + spread * rng.normal(size=dimensions)).tolist()) for i in range(n)]


ODD = [(1001, None), (1002, []), (1003, [1.0] * 7), (1004, [0.0] * 8), (1005, [float("nan")] + [1.0] * 7), (1006, [None] + [1.0] * 7),
       (1007, [float("inf")] + [1.0] * 7), (1008, [1e-200] * 8), (1009, [1e200] * 8)]


@pytest.mark.parametrize("k, block_rows, query_rows, spread", [(5, 16, 7, 0.1), (20, 2048, 1024, 0.1), (700, 50, 9, 3.0)])
def test_as_brute_force(vectors_of, k, block_rows, query_rows, spread):
    rows = drawn(400, 1, spread=spread) + ODD + [(2000 + i, [1.0, 2.0] * 4) for i in range(90)]
    queries = rows[::7] + [(5000, [1.0, 2.0] * 4), (5001, [0.0] * 8), (5002, [1.0])]
    index = dense.build_index(vectors_of(rows), block_rows=block_rows)
    hits = dense.search(vectors_of(queries, "query_id"), index, k, query_rows)
    same(found(hits), brute(queries, rows, k, 8))


def test_blocks_are_rings_of_bounded_size(vectors_of):
    # A centre with most of all rows, half of them copies.
    rows = [(i, [1.0, 0.01 * (i % 5 if i % 2 else 0), 0, 0]) for i in range(3000)] + [(9000 + i, v) for i, v in drawn(40, 2, 4)]
    index = dense.build_index(vectors_of(rows), centres=6, block_rows=100)
    blocks = index.blocks.collect()
    assert sum(b.n for b in blocks) == len(rows) and max(b.n for b in blocks) <= 100
    assert all(b.n == len(b.ids) == len(b.matrix) // 32 and b.low <= b.high for b in blocks)
    assert sorted(i for b in blocks for i in b.ids) == sorted(i for i, _ in rows)


def test_few_pairs_are_scored(vectors_of):
    rows = drawn(4000, 3, 16, groups=40, spread=0.05)
    queries = vectors_of(rows[::50], "query_id")
    index = dense.build_index(vectors_of(rows), centres=40, block_rows=64)
    asked = dense.prepared_queries(queries, index)
    first = dense.first_pairs(asked, index)
    hits = dense.scored(first, asked, index, 10)
    rest = dense.open_pairs(asked, dense.reach_of(hits, asked, 10), index)
    total = first.agg(F.sum("n")).first()[0] + rest.agg(F.sum("n")).first()[0]
    assert total <= 0.15 * len(rows) * asked.count()


def test_no_vectors(vectors_of):
    some = vectors_of([(1, [1.0, 2.0])], "query_id")
    assert dense.search(some, dense.build_index(vectors_of([]))).count() == 0
    assert dense.search(some, dense.build_index(vectors_of(ODD[:2]))).count() == 0
    assert dense.search(some.limit(0), dense.build_index(vectors_of([(1, [1.0, 2.0])]))).count() == 0
    with pytest.raises(ValueError):
        dense.search(some, dense.build_index(vectors_of([])), 0)
