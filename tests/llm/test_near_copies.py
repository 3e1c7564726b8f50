import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpuslens.llm import near_copies, simhash


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(pairs):
    """Text -> smallest id of its component, by all pairs."""
    sets = list(dict.fromkeys(shingle_set(t) for _, t in pairs))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    at = {s: root(i) for i, s in enumerate(sets)}
    least = {}
    for i, t in pairs:
        if i is not None:
            least[at[shingle_set(t)]] = min(i, least.get(at[shingle_set(t)], i))
    return {t: least.get(at[shingle_set(t)]) for _, t in pairs}


def changed(text, n, seed):
    drawn, words = random.Random(seed), text.split()
    for i in drawn.sample(range(len(words)), n):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def case(prose):
    pairs = [(i, prose(200, i)) for i in range(20)]
    # One to six changed words in 200: similarities on both sides of 0.8.
    pairs += [(100 + 10 * i + n, changed(pairs[i][1], n, 100 * i + n)) for i in range(20) for n in range(1, 7)]
    # A chain: each three words from the one before.
    chain = [prose(200, 50)]
    for i in range(12):
        chain.append(changed(chain[-1], 3, 900 + i))
    pairs += [(500 + i, t) for i, t in enumerate(chain)]
    # A group of near copies.
    pairs += [(600 + i, changed(prose(100, 60), 1, 2000 + i)) for i in range(60)]
    return pairs + [(800, None), (801, ""), (802, " \t"), (803, "one"), (804, "One"), (805, "one two"), (0, pairs[0][1]), (None, pairs[1][1]), (None, "alone")]


def test_near_copies_as_brute_force(docs_of, prose):
    pairs = case(prose)
    wanted = brute(pairs)
    # Small chunks: pairs of chunks give the same components.
    for chunk in (near_copies.CHUNK, 4):
        found = near_copies.near_copies(docs_of(pairs), chunk).collect()
        assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted(((i, wanted[t]) for i, t in pairs), key=repr)
    kept = {r.doc_id for r in near_copies.drop_near_copies(docs_of(pairs)).collect()}
    assert kept == {i for i, t in pairs if i == wanted[t]}


def test_stage_drops_what_three_bits_miss(spark, docs_of, prose):
    texts = [prose(100, i) for i in range(40)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, changed(t, 2, i)) for i, t in enumerate(texts)]
    apart = [i for i, t in enumerate(texts) if bin(simhash.fingerprint(t) ^ simhash.fingerprint(pairs[40 + i][1])).count("1") > 3]
    near = {i for i in range(40) if brute([pairs[i], pairs[40 + i]])[pairs[40 + i][1]] == i}
    assert near & set(apart)
    kept = {r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs_of(pairs), "").collect()}
    assert kept == set(range(40)) | {100 + i for i in range(40) if i not in near}


def test_bands_find_pairs_at_the_bound():
    """Of 2 000 pairs at similarity 0.8, fewer than one is expected to share no cell."""
    drawn = np.random.default_rng(5)
    for _ in range(2000):
        x = drawn.integers(0, 2**64 - 1, 110, np.uint64)
        a, b = np.sort(x[:99]), np.sort(np.concatenate([x[:88], x[99:]]))
        assert near_copies.similar(a, b)
        assert set(near_copies._sketch(a)) & set(near_copies._sketch(b))


def test_empty(no_docs):
    assert near_copies.near_copies(no_docs).count() == 0


def test_cells_are_blocks_of_a_simhash():
    """Bits of the fingerprint are the majority's, and fewer differ the more alike two sets are."""
    drawn = np.random.default_rng(7)
    x = drawn.integers(0, 2**64 - 1, 600, np.uint64)
    one = near_copies._fingerprint(x[:1])
    assert (near_copies._fingerprint(np.concatenate([x[:1], x[:1], x[1:2]])) == one).all()
    distance = [int(np.bitwise_count(near_copies._fingerprint(x[:300]) ^ near_copies._fingerprint(x[k : 300 + k])).sum()) for k in (0, 30, 100, 300)]
    assert distance[0] == 0 and distance == sorted(distance) and abs(distance[3] - 512) < 80
    words = near_copies._fingerprint(x)
    assert near_copies._sketch(x) == [(b << 12) + (int(words[b // 5]) >> 12 * (b % 5) & 4095) for b in range(near_copies.BANDS)]


def test_groups_as_brute_force():
    drawn = np.random.default_rng(8)
    cell = np.sort(drawn.integers(0, 12, 900))
    rows = drawn.integers(0, 2**64 - 1, (20, near_copies.CLOSE_WORDS), np.uint64)[drawn.integers(0, 20, 900)]
    for r in rows:
        for bit in drawn.integers(0, 256, 40).tolist():
            r[bit // 64] ^= np.uint64(1 << bit % 64)
    apart = np.bitwise_count(rows[:, None] ^ rows[None]).astype(int)
    near = (cell[:, None] == cell[None]) & (apart.sum(2) <= near_copies.MOST_BITS) & (apart[:, :, 0] <= near_copies.FIRST_BITS)
    wanted = np.arange(900)
    while (least := np.where(near, wanted[None], 900).min(1)).tolist() != wanted.tolist():
        wanted = least
    assert 12 < len(set(wanted.tolist())) < 900
    assert near_copies._groups(cell, list(rows.T)).tolist() == wanted.tolist()


def test_large_cells_are_cut(docs_of, prose):
    """Pairs of chunks of cells above the bound give the same components."""
    pairs = case(prose)
    wanted = brute(pairs)
    found = near_copies.near_copies(docs_of(pairs), near_copies.CHUNK, 6).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted(((i, wanted[t]) for i, t in pairs), key=repr)


def test_cells_go_on_in_other_batches(monkeypatch):
    drawn = np.random.default_rng(9)
    cell = np.sort(np.concatenate([drawn.integers(0, 40, 200), np.full(90, 41), np.full(70, 45)]))
    close = drawn.integers(0, 2**64 - 1, (5, near_copies.CLOSE_WORDS), np.uint64)[drawn.integers(0, 5, len(cell))].view(np.int64)
    table = pa.table({"cell": cell, "alias": np.arange(len(cell))} | {f"close{i}": close[:, i] for i in range(near_copies.CLOSE_WORDS)})

    def rows(most, size):
        return [tuple(r.values()) for b in near_copies._grouped(most)(iter(table.to_batches(size))) for r in b.to_pylist()]

    whole = rows(80, 1000)
    assert [r for r in whole if r[1] is None] == [(41, None, 90)] and sum(r[0] == 45 for r in whole) == 70
    monkeypatch.setattr(near_copies, "_ROWS", 20)
    assert sorted(rows(80, 7), key=repr) == sorted(whole, key=repr)
    assert {r[0]: r[2] for r in rows(30, 7) if r[1] is None} == {41: 90, 45: 70}
    assert all(r[1] is not None for r in rows(1 << 62, 7))
