import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuslens.operators import integrity, leakage, partitioning

TOKEN = re.compile(r"[a-z0-9]+(?:[-_/+][a-z0-9]+)*", re.IGNORECASE)


def token_list(text):
    return [t.lower() for t in TOKEN.findall(text or "")]


def drawn_texts(n, seed, size=(1, 14), words=40):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.expovariate(0.1)), words)}" for _ in range(rng.randint(*size))) for _ in range(n)]


@pytest.fixture
def texts_of(spark):
    return lambda rows: spark.createDataFrame(rows, "id string, text string")


@pytest.mark.parametrize("measure", leakage.MEASURES)
@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_as_brute_force(texts_of, measure, threshold):
    left = [(f"l{i}", t) for i, t in enumerate(drawn_texts(60, 1) + ["", None, "---", "W1 w1, W2"])]
    right = [(f"r{i}", t) for i, t in enumerate(drawn_texts(80, 2) + ["", None, "w2 w1", "w1 w2 w3 w4"])] + [(f"copy{i}", "w1 w2 w3") for i in range(40)]
    wanted = []
    for a, x in left:
        for b, y in right:
            ours, theirs = set(token_list(x)), set(token_list(y))
            both = len(ours & theirs)
            if both:
                by = {"containment": both / len(ours), "jaccard": both / len(ours | theirs)}
                if by[measure] >= threshold - 1e-9:
                    wanted.append((a, b, both, round(by["containment"], 9), round(by["jaccard"], 9)))
    got = leakage.similar_pairs(texts_of(left), texts_of(right), threshold, measure).collect()
    assert sorted((r.left_id, r.right_id, r.shared, round(r.containment, 9), round(r.jaccard, 9)) for r in got) == sorted(wanted)
    assert wanted


def test_leaked_kinds(spark, texts_of):
    asked = spark.createDataFrame([("1", "What is the dose of x?"), ("2", "other words here"), ("3", "a b c d e f g h i j"), ("4", "?")], "question_id string, question string")
    chunks = spark.createDataFrame([
        ("same", "what IS the dose, of X"), ("inside", "so what is the dose of x then"), ("mixed", "x of dose the is what"), ("near", "a b c d e f g h z"), ("no", "words")],
        "chunk_id string, text string")
    assert sorted((r.question_id, r.chunk_id, r.kind) for r in leakage.leaked(asked, chunks).collect()) == [
        ("1", "inside", "verbatim"), ("1", "mixed", "near"), ("1", "same", "equal"), ("3", "near", "near")]
    with pytest.raises(ValueError, match="corpus: 1$"):
        leakage.assert_not_leaked(asked, chunks)
    leakage.assert_not_leaked(asked, chunks.where("chunk_id in ('mixed', 'near', 'no')"))
    assert leakage.leaked(asked, chunks.limit(0)).count() == 0 and leakage.leaked(asked.limit(0), chunks).count() == 0


def test_conflicts(spark):
    rows = spark.createDataFrame([
        (1, "Is it so?", True), (2, "is  IT so", False), (3, "is it so", None), (4, "alone", True), (5, "same", True), (6, "same!", True),
        (7, "a b c d e f g h i j", True), (8, "a b c d e f g h i j k", False), (9, None, True), (10, "", False),
    ], "id long, question string, label boolean")
    found = leakage.label_conflicts(rows).collect()
    assert sorted((r.n_rows, r.n_yes, r.n_no, r.first_id) for r in found) == [(2, 1, 1, 1), (2, 1, 1, 9)]
    near = leakage.near_conflicts(rows).collect()
    assert [round(r.jaccard, 6) for r in near] == [round(10 / 11, 6)]


# --- partitions -----------------------------------------------------------------------
@given(st.lists(st.integers(0, 9), min_size=1, max_size=5).filter(sum))
def test_cycle_is_even(weights):
    dealt = partitioning.cycle(tuple(weights))
    total = sum(weights)
    for part, w in enumerate(weights):
        assert dealt.count(part) * total == w * len(dealt)
        for n in range(len(dealt) + 1):
            assert abs(dealt[:n].count(part) - n * w / total) <= 1


def test_weights_are_checked():
    for weights in ((), (0, 0), (1, -1), (0.5, 0.5)):
        with pytest.raises(ValueError):
            partitioning.cycle(weights)


@pytest.mark.parametrize("weights", [(8, 1, 1), (1, 1), (3, 2)])
def test_groups_stay_whole_and_strata_balanced(spark, weights):
    rng = random.Random(7)
    rows = [(f"g{g}", rng.choice(["yes/a", "yes/b", "no/a"])) for g in range(700) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    rows += [("hot", "yes/a")] * 120 + [(None, "no/a")] * 3 + [("odd", None)]
    parts = partitioning.with_parts(spark.createDataFrame(rows, "group string, stratum string"), weights).collect()
    assert Counter((r.group, r.stratum) for r in parts) == Counter(rows)
    own = {}
    for r in parts:
        assert own.setdefault(r.group, r.part) == r.part
    per_group = {}
    for g, s in rows:
        per_group.setdefault(g, Counter())[s] += 1
    kinds = {tuple(sorted(c.items(), key=repr)) for c in per_group.values()}
    for stratum in ("yes/a", "yes/b", "no/a"):
        total = sum(s == stratum for _, s in rows)
        bound = 2 * sum(dict(k).get(stratum, 0) for k in kinds)
        for part, w in enumerate(weights):
            there = sum(r.part == part and r.stratum == stratum for r in parts)
            assert abs(there - total * w / sum(weights)) <= bound
    counted = {(r.part, r.stratum): r.n_rows for r in partitioning.shares(spark.createDataFrame(parts)).collect()}
    assert counted == Counter((r.part, r.stratum) for r in parts)
    # The same rows in another order get the same parts.
    again = partitioning.with_parts(spark.createDataFrame(rows[::-1], "group string, stratum string").repartition(3), weights).collect()
    assert {r.group: r.part for r in again} == own
    assert partitioning.with_parts(spark.createDataFrame([], "group string, stratum string"), weights).count() == 0


# --- integrity ------------------------------------------------------------------------
def test_each_break_gives_its_row(spark):
    entry = "path string, size long, digest string"
    manifest = spark.createDataFrame([("ok", 1, "a"), ("gone", 1, "a"), ("long", 2, "a"), ("changed", 1, "b"), ("twice", 1, "a"), ("twice", 1, "a"), ("bare", 1, "a")], entry)
    files = spark.createDataFrame([(p, 1, "a") for p in ("ok", "long", "changed", "twice", "bare", "extra")], entry)
    full, blank = [(False, "text")], [(True, "text"), (False, " ")]
    page = lambda path, url, sections=full, title="T", digest="h": (path, url, title, "t", "a", digest, sections)
    pages = spark.createDataFrame([
        page("ok", "u1"), page("long", "u2"), page("changed", "u3", blank), page("twice", "u4", title=" "), page("extra", None), page("ok", "u5"),
        page("ok", "u5", digest="other"), page("lost", "u6", None),
    ], "path string, url string, title string, topic string, audience string, content_sha256 string, sections array<struct<is_boilerplate:boolean,text:string>>")
    report = integrity.integrity_report(manifest, files, pages)
    assert sorted((r.kind, r.subject, r.detail or "", r.is_error) for r in report.collect()) == [
        ("conflicting_url", "u5", "", True), ("empty_page", "u3", "", False), ("empty_page", "u6", "", False), ("missing_field", "extra", "url", True),
        ("missing_field", "u4", "title", True), ("missing_file", "gone", "", True), ("no_pages", "bare", "", True), ("other_digest", "changed", "", True),
        ("other_size", "long", "", True), ("pages_without_file", "lost", "", True), ("repeated_path", "twice", "", True), ("unlisted_file", "extra", "", False),
    ]
    with pytest.raises(ValueError, match="conflicting_url 1, missing_field 2"):
        integrity.assert_sound(report)
    integrity.assert_sound(integrity.integrity_report(manifest.limit(0), files.limit(0), pages.limit(0)))
