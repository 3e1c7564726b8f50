import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import quality


def plain_features(text, bits):
    """Features of one text, one at a time."""
    return sorted(next(quality.features([text], bits)).tolist())


def test_features_do_not_depend_on_neighbours(prose):
    texts = [prose(30, 1), "", "a", prose(9, 2), " \n ", "é é é", prose(50, 3)]
    for text, got in zip(texts, quality.features(texts, 12)):
        assert sorted(got.tolist()) == plain_features(text, 12)
        assert (len(got) == 0) == (not text.strip())


def test_held_out_accuracy(spark, docs_of, prose):
    drawn = random.Random(4)
    pairs, labels = [], []
    for i in range(600):
        good = prose(drawn.randint(20, 80), i)
        kind = i % 4
        text = {0: " ".join(w.upper() + "!!" for w in good.split()), 1: " ".join(w for w in good.split() for _ in range(8))}.get(kind, good)
        pairs.append((i, text))
        labels.append((i, int(kind > 1), 0))
    labels += [(5000, None, 0), (None, 1, 0), (0, 0, 0)]
    pairs += [(7000, None), (7001, ""), (7002, " "), (3, pairs[3][1])]
    truth = dict((i, q) for i, q, _ in labels)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs_of(pairs), labels, epochs=8).collect()
    assert len(rows) == len(pairs)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id >= 7000}) == 1
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    kept = quality.drop_low_quality(docs_of(pairs), labels, epochs=8)
    assert kept.columns == docs_of(pairs).columns
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in rows if r.predicted == 1}


def test_scores_as_brute_force(spark, docs_of, prose):
    """The mean over all features of the whole text, a long one as well."""
    pairs = [(i, prose(n, i)) for i, n in enumerate((3, 40, 30_000))]
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs_of(pairs), labels)
    score = quality.scorer(docs_of(pairs), model)
    for r in docs_of(pairs).select("text", score(F.col("text")).alias("score")).collect():
        z = np.mean([float(model.weights[b]) for b in plain_features(r.text, quality.BUCKET_BITS)]) + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_without_labels_or_documents(spark, docs_of, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.quality_scores(docs_of([(1, "some words"), (2, None)]), none).collect()
    assert [r.score for r in rows] == [0.5, 0.5]
    assert quality.quality_scores(no_docs, none).count() == 0


def test_drops_nothing_without_both_labels(spark, docs_of, prose):
    pairs = [(i, prose(20, i)) for i in range(12)] + [(20, None), (21, "")]
    for labels in ([], [(i, None) for i in range(12)], [(i, 0) for i in range(12)], [(i, 1) for i in range(12)]):
        labels = spark.createDataFrame(labels, "doc_id long, quality int")
        assert quality.drop_low_quality(docs_of(pairs), labels).count() == len(pairs)
