import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.llm import simhash
from corpuslens.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest member of each component of the 3-bit graph."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {f: root(f) for f in fps}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cé\t\n x\x1f", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chains(seed, starts=25, steps=30):
    drawn = random.Random(seed)
    out = []
    for _ in range(starts):
        x = drawn.getrandbits(64)
        for _ in range(drawn.randint(1, steps)):
            for bit in drawn.sample(range(64), drawn.randint(1, 5)):
                x ^= 1 << bit
            out.append(x)
    return sorted({signed(x) for x in out} | {0, -1, signed(1 << 63), 7})


def test_links_connect_what_brute_force_connects(spark):
    for members in (4096, 8):  # the second cuts cells into chunks
        fps = chains(members)
        links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), members)
        pairs = {(r.u, r.v) for r in links.collect()}
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in pairs)
        wanted = {k: v for k, v in brute_components(fps).items() if k != v}
        got = {r.node: r.root for r in components(links).collect()}
        assert {k: v for k, v in got.items() if k != v} == wanted


def test_hot_near_copies_give_linear_links(spark):
    base = random.Random(3).getrandbits(63)
    fps = [base] + [base ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)]
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert len(fps) - 1 <= links.count() <= 20 * len(fps)
    assert {r.root for r in components(links).collect()} == {min(fps)}


def test_near_duplicates_as_brute_force(docs_of, prose):
    texts = [prose(120, i) for i in range(25)]
    pairs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " extra") for i, t in enumerate(texts)]
    pairs += [(200 + i, texts[0]) for i in range(60)] + [(300, None), (301, ""), (302, " \t"), (303, "one"), (303, "one"), (None, texts[1])]
    found = simhash.near_duplicates(docs_of(pairs)).collect()
    assert len(found) == len(pairs)
    fps = {t: simhash.fingerprint(t or "") for _, t in pairs}
    roots = brute_components(sorted(set(fps.values())))
    least = {}
    for i, t in pairs:
        if i is not None:
            root = roots[fps[t]]
            least[root] = min(least.get(root, i), i)
    wanted = sorted(((i, fps[t], least[roots[fps[t]]]) for i, t in pairs), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=repr) == wanted
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(pairs)).collect()}
    assert kept == set(least.values())
    clean = docs_of([(None, "a text of its own without an id"), (100, "not the first text of this id")])
    assert simhash.drop_near_duplicates(docs_of(pairs).unionByName(clean)).join(clean, "text", "left_semi").count() == 2


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_odd_tables(spark):
    rows = [(1, 1), (2, 3), (3, 2), (None, 4), (5, None), (7, 8), (8, 9), (9, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {2: 2, 3: 2, 7: 7, 8: 7, 9: 7}
    long = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in components(long).collect()} == {0}


def test_forest_spans():
    fps = np.array(chains(5), np.int64)
    wanted = brute_components(fps.tolist())
    parent = {i: i for i in range(len(fps))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash._forest(fps):
        parent[root(a)] = root(b)
    assert len({root(i) for i in parent}) == len(set(wanted.values()))
