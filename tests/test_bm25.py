"""BM25 against a plain Python scorer over all chunks."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.operators import bm25, evidence


def make_chunks(spark, texts):
    return spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").select(
        "chunk_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("cancer_type"), F.lit("").alias("topic"),
        F.lit("").alias("audience"), F.lit("").alias("section"), F.array().cast("array<string>").alias("section_path"),
        F.lit("u").alias("url"), F.lit("f").alias("source_file"), "text",
    )


_BUILT = {}


def index_of(spark, name):
    if name not in _BUILT:
        _BUILT[name] = bm25.build_index(make_chunks(spark, CORPORA[name]))
    return _BUILT[name]


def brute(texts, question, k):
    find = re.compile(fv.TOKEN_PATTERN, re.IGNORECASE)
    docs = [[t.lower() for t in find.findall(x)] for x in texts]
    asked = [t.lower() for t in find.findall(question)]
    if not asked:
        return []
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    scored = []
    for i, d in enumerate(docs):
        s = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in asked)
        hit = bool(set(asked) & set(d))
        scored.append((-round(s, 6), not hit, f"c{i:03d}", hit))
    return [(c, r) for r, (_, _, c, hit) in enumerate(sorted(scored)[:k], 1) if hit]


CORPORA = {
    "usual": [f"alpha{i % 7} beta{i % 3} gamma " + "delta " * (i % 5) + f"only{i}" for i in range(40)],
    "one": ["bladder cancer chemotherapy"],
    # Every term is in most chunks, so the average idf is below 0 and chunks
    # without a match rank above matching ones.
    "negative": ["a b c"] * 6 + ["a b"] * 3 + ["z"],
    "half": ["x y", "x z", "w q", "w r"],
    "copies": ["same text here"] * 12 + ["other words there"] * 3,
    "empty chunk": ["???", "a b", "b c"],
}
QUESTIONS = [
    "gamma alpha1 beta2 beta2", "only3 only17 delta", "???", "unknown words", "a c", "a b c z", "x w", "same other",
    "bladder chemotherapy treatment", "b",
]


@pytest.mark.parametrize("name", CORPORA)
@pytest.mark.parametrize("k", [1, 6])
def test_same_hits_as_scoring_everything(spark, name, k):
    texts = CORPORA[name]
    index = index_of(spark, name)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    got = {}
    for r in bm25.search(questions, index, k).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["rank"]))
    assert got == {i: hits for i, q in enumerate(QUESTIONS) if (hits := brute(texts, q, k))}


@pytest.mark.parametrize("block_rows", [12, 1])
@pytest.mark.parametrize("name", ["usual", "negative"])
def test_batches_too_large_to_broadcast_give_the_same(spark, name, block_rows):
    """Blocks of questions, and (at 1) questions too large for any block."""
    index = index_of(spark, name)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    small = sorted(map(tuple, bm25.search(questions, index).collect()))
    assert sorted(map(tuple, bm25.search(questions, index, block_rows=block_rows).collect())) == small


def test_postings_stay_in_place(spark, plan_of):
    """Scoring shuffles nothing but the k best per question and task."""
    index = index_of(spark, "usual")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    plan = plan_of(bm25.search(questions, index))
    above_join = plan[: plan.index("BroadcastHashJoin")]
    assert above_join.count("Exchange") == 1
    assert "row_number(), 6, Partial" in above_join
    assert "Bucketed: true" in plan


def test_index_build_shuffles_the_corpus_once(spark, plan_of):
    """Deduplication leaves chunks partitioned by chunk_id; bucketing reuses that."""
    from corpuslens.operators.chunks import keep_first

    chunks = make_chunks(spark, CORPORA["usual"]).withColumns(
        {"load_order": F.lit(1), "section_index": F.lit(1), "chunk_index": F.lit(1)})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan_of(keep_first(chunks).repartition(buckets, "chunk_id")).count("Exchange") == 1
    index = index_of(spark, "usual")
    postings = bm25.make_postings(index.chunks).repartition(buckets, "chunk_id")
    assert plan_of(postings).count("Exchange") == 0


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        bm25.build_index(make_chunks(spark, ["x"]).where("false"))
    index = bm25.build_index(make_chunks(spark, ["x"]))
    with pytest.raises(ValueError):
        bm25.search(spark.createDataFrame([("1", "x")], "question_id string, question string"), index, 0)


def test_no_hit_gives_the_fixed_sentence(spark):
    index = index_of(spark, "usual")
    questions = spark.createDataFrame([("1", "nothing"), ("2", "gamma only5")], "question_id string, question string")
    rows = evidence.evidence_text(questions, bm25.search(questions, index, 2), index.chunks).orderBy("question_id").collect()
    assert rows[0]["evidence"] == fv.NO_EVIDENCE
    assert rows[1]["evidence"].startswith("[Evidence 1]\nTitle: \nCancer/topic: General cancer topic / ")
    assert "\n\n[Evidence 2]\n" in rows[1]["evidence"]
