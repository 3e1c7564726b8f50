import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import simplex


def brute(pairs, k=simplex.CENTROIDS, rounds=simplex.ROUNDS):
    """Every vector with every centroid, in whole numbers."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in pairs
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < simplex.LARGEST for x in v)]
    ranked = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in ranked[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [
            [sum(col) // own.count(j) for col in zip(*(v for (_, v), o in zip(kept, own) if o == j))] if j in own else c
            for j, c in enumerate(centroids)
        ]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in found if o == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found), key=repr)


@pytest.fixture
def embeddings_of(spark):
    def frame(pairs):
        rows = [(i, v, 0, [1], 0, "x") for i, v in pairs]
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v array<int>, cluster int, squares string")

    return frame


def drawn(n, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 64))
    return [(i, [float(np.float32(x)) for x in middles[i % 6] + spread * rng.normal(size=64)]) for i in range(n)]


def odd():
    base = [0.25] * 63
    return [(500, None), (501, []), (502, base), (503, [*base, None]), (504, [*base, float("nan")]), (505, [*base, float("inf")]),
            (506, [*base, 1e30]), (507, [*base, 2000.0]), (508, [0.0] * 64), (508, [0.0] * 64), (None, [0.5] * 64), (509, [-0.001] * 64)]


@pytest.mark.parametrize("pairs", [drawn(150, 1) + odd(), drawn(7, 2), [(i, [1.0] * 64) for i in range(40)], odd()])
def test_as_brute_force(embeddings_of, pairs):
    rows = simplex.with_inertia(*simplex.cluster(embeddings_of(pairs))).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(pairs)


def test_empty_table(embeddings_of):
    assert simplex.with_inertia(*simplex.cluster(embeddings_of([]))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 14), st.sampled_from([1, 50, 10**6]), st.integers(1, 6))
def test_bounds_hold(seed, pivots, size, rank):
    """No nearest centroid is filtered, also among vectors in few directions, far away or all alike."""
    rng = np.random.default_rng(seed)
    few = rng.integers(-size, size + 1, (rank, 8))
    vectors = rng.integers(-2, 3, (60, rank)) @ few + rng.integers(0, 2, (60, 8)) * rng.integers(0, 2)
    base = simplex.base_of(vectors[:30], pivots)
    centroids = vectors[rng.permutation(60)[:9]] + rng.integers(-1, 2, (9, 8))
    exact = simplex.squared_distances(vectors, centroids)
    apexes = base.apexes(simplex.squared_distances(vectors, base.pivots))
    cluster, distance, _ = simplex.nearest(vectors, apexes, centroids, base)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_most_pairs_are_filtered(embeddings_of):
    vectors = np.floor(64 * np.array([v for _, v in drawn(600, 3, 0.05)])).astype(np.int64)
    base = simplex.base_of(vectors[:256])
    assert len(base.pivots) == simplex.PIVOTS
    apexes = base.apexes(simplex.squared_distances(vectors, base.pivots))
    assert simplex.nearest(vectors, apexes, vectors[:6], base)[2] <= 1.2 * len(vectors)
