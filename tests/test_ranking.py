import math
import random

import pytest

from corpuslens.operators import ranking


@pytest.fixture
def hits_of(spark):
    return lambda rows: spark.createDataFrame(rows, "question_id string, chunk_id string, rank int")


def lists(seed, n=40):
    rng = random.Random(seed)
    out = []
    for q in "abc":
        chunks = rng.sample(range(60), n)
        out += [(q, f"c{c:02d}", i + 1) for i, c in enumerate(chunks)]
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fuse_as_brute_force(hits_of):
    # One list holds a chunk twice; one question is in one list only.
    first, second = lists(1) + [("a", "c01", 77)], [r for r in lists(2) if r[0] != "c"]
    wanted = []
    for q in "abc":
        best = {}
        for name, own in (("x", first), ("y", second)):
            for _, c, r in (r for r in own if r[0] == q):
                best.setdefault(c, {}).setdefault(name, r)
                best[c][name] = min(best[c][name], r)
        scored = sorted((-round(sum(1 / (60 + r) for r in b.values()), 9), c, sorted(b)) for c, b in best.items())
        wanted += [(q, c, i + 1, b) for i, (_, c, b) in enumerate(scored[:30])]
    fused = ranking.fuse({"y": hits_of(second), "x": hits_of(first)})
    assert rows(fused, "question_id", "chunk_id", "rank", "sources") == sorted(wanted)
    assert ranking.fuse({"x": hits_of([])}).count() == 0


def test_longest_term_counts(spark):
    terms = spark.createDataFrame([
        ("stomach cancer", "entity", "Stomach"), ("Cancer", "alias", "Any"), ("gastric  cancer", "alias", "Stomach"), ("screening", "topic", "screening"),
        ("cancer screening", "topic", "cs"), ("...", "alias", "none"), ("stomach cancer", "alias", "Belly"),
    ], "term string, kind string, value string")
    asked = spark.createDataFrame([
        ("1", "Is STOMACH-free stomach, cancer bad?"), ("2", "gastric cancer screening"), ("3", "cancer and stomach cancer"), ("4", None), ("5", "x"),
        ("6", "stomach cancer screening stomach"),
    ], "question_id string, question string")
    found = {}
    for q, kind, value in rows(ranking.named_terms(asked, terms), "question_id", "kind", "value"):
        found.setdefault(q, set()).add((kind, value))
    both = {("entity", "Stomach"), ("alias", "Belly")}
    assert found == {"1": both, "2": {("alias", "Stomach"), ("topic", "screening")}, "3": both | {("alias", "Any")}, "6": both | {("topic", "screening")}}
    assert ranking.named_terms(asked, terms.limit(0)).count() == 0


CHUNKS = "chunk_id string, cancer_type string, topic string, audience string"


def test_boost_and_fallback(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "Lung" if i % 2 else None, "care" if i < 3 else "other", ["patient", "health_professional", None][i % 3]) for i in range(8)], CHUNKS)
    hits = spark.createDataFrame([(q, f"c{i}", 10.0 - i) for q in "123" for i in range(8)], "question_id string, chunk_id string, score double")
    named = spark.createDataFrame([("1", "entity", "Lung"), ("1", "topic", "care"), ("2", "alias", "Skin"), ("2", "topic", "care")], "question_id string, kind string, value string")

    def score(q, i):
        level = None
        if q == "1":
            level = "entity" if i % 2 else "topic" if i < 3 else None
        return (10.0 - i) * (1 + ranking.BOOSTS.get(level, 0)) * (0.85 if i % 3 == 0 else 1), level

    wanted = []
    for q in "123":
        scored = sorted((-round(score(q, i)[0], 9), f"c{i}", score(q, i)[1]) for i in range(8))
        wanted += [(q, c, level, k + 1) for k, (_, c, level) in enumerate(scored)]
    # Question 2 names an entity that no hit is of: its boosts fall away, its hits stay.
    got = ranking.boost(hits, chunks, named)
    assert sorted((r.question_id, r.chunk_id, r.level, r.rank) for r in got.collect()) == sorted(wanted, key=lambda r: r[:2])
    # A topic alone needs no mapped entity.
    only = ranking.boost(hits, chunks, named.where("kind = 'topic' and question_id = '2'"))
    assert {r.chunk_id for r in only.where("question_id = '2' and level = 'topic'").collect()} == {"c0", "c1", "c2"}


def test_diverse_as_brute_force(spark, hits_of):
    rng = random.Random(5)
    place = {f"c{i:02d}": (f"u{rng.randint(0, 2)}", [f"s{rng.randint(0, 1)}"]) for i in range(60)}
    chunks = spark.createDataFrame([(c, *p) for c, p in place.items()], "chunk_id string, url string, section_path array<string>")
    own = [r for r in lists(3) if r[0] != "c"] + [("c", f"c{i:02d}", i + 1) for i in range(4)]
    wanted = []
    for q in "abc":
        seen, kept, over = {}, [], []
        for _, c, r in sorted((r for r in own if r[0] == q), key=lambda r: r[2]):
            key = str(place[c])
            seen[key] = seen.get(key, 0) + 1
            (kept if seen[key] <= 2 else over).append((r, c, seen[key] > 2))
        chosen = sorted(kept[:8] + over[: max(0, 8 - len(kept))])
        wanted += [(q, c, r, f, i + 1) for i, (r, c, f) in enumerate(chosen)]
    assert rows(ranking.diverse(hits_of(own), chunks), "question_id", "chunk_id", "old_rank", "filled", "rank") == sorted(wanted)


def test_metrics_as_brute_force(spark, hits_of):
    rng = random.Random(6)
    judged = [(q, f"c{c:02d}", rng.randint(0, 3)) for q in "abd" for c in rng.sample(range(60), 14)] + [("e", "c01", 0)]
    judged += [("a", judged[0][1], 3)]
    own = lists(4)
    wanted = {}
    for q in "abd":
        grades = {}
        for x, c, g in judged:
            if x == q and g > 0:
                grades[c] = max(g, grades.get(c, 0))
        ranks = {c: r for x, c, r in own if x == q}
        found = sorted(ranks[c] for c in grades if c in ranks)
        dcg = sum((2 ** g - 1) / math.log2(ranks[c] + 1) for c, g in grades.items() if ranks.get(c, 99) <= 10)
        ideal = sum((2 ** g - 1) / math.log2(i + 2) for i, g in enumerate(sorted(grades.values(), reverse=True)[:10]))
        wanted[q] = (len(grades), sum(r <= 5 for r in found) / len(grades), sum(r <= 10 for r in found) / len(grades), 1 / found[0] if found else 0, dcg / ideal)
    table = ranking.retrieval_metrics(hits_of(own), spark.createDataFrame(judged, "question_id string, chunk_id string, grade int"))
    got = {r.question_id: tuple(r)[1:] for r in table.collect()}
    assert set(got) == set(wanted) and all(got[q] == pytest.approx(wanted[q]) for q in wanted)
    assert wanted["d"][1:] == (0, 0, 0, 0)
    mean = ranking.mean_metrics(table).first()
    assert mean.questions == 3 and mean.recall_5 == pytest.approx(sum(w[1] for w in wanted.values()) / 3)
