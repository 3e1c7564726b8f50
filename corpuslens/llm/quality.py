"""Quality classifier: supervised subword embeddings.

Words, a mark for each word that repeats its predecessor, and byte n-grams are
hashed into buckets, each with a learned vector; a document is the mean of its
vectors, scored by softmax. Training is numpy stochastic gradient descent on a
bounded sample of labelled rows, each with a bounded, evenly spaced share of its
features. Scoring uses every feature of the whole text.

Defined results: null and empty texts score the share of label 1 in the sample;
without labels every score is 0.5, and ``drop_low_quality`` keeps all rows, as it
does without texts of both labels; labels that are null are ignored; repeated
rows give equal rows; only doc_id, text and the labels' doc_id and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out, text_of
from corpuslens.llm.wordscan import VISIBLE, scan, slices

SAMPLE_ROWS = 6000
SAMPLE_FEATURES = 1024
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
GRAMS = (2, 3, 4)
THRESHOLD = 0.7


@dataclass
class Model:
    """``weights``: each bucket's vector times the difference of the two output rows."""

    weights: np.ndarray
    bias: float
    prior: float
    learned: bool = True  # texts of both labels were seen


def features(texts: list[str], bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Buckets of all features of each text."""
    keep = np.uint64(64 - bits)
    words = scan(texts, VISIBLE)
    same = np.zeros(len(words.hash), bool)
    same[1:] = words.hash[1:] == words.hash[:-1]
    word_buckets = (words.hash >> keep).astype(np.int32)
    repeat_bucket = np.int32((1 << bits) - 1)
    letters = words.buffer.astype(np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])))
    grams = []
    for n in GRAMS:
        h = np.zeros(max(0, len(letters) - n + 1), np.uint64)
        for i in range(n):
            h = (h << np.uint64(8)) | letters[i : i + len(h)]
        h = (h + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(((h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> keep).astype(np.int32))
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if a == b:
            yield np.zeros(0, np.int32)
            continue
        repeated = np.full(int(same[a + 1 : b].sum()), repeat_bucket, np.int32)
        low, high = bounds[i], bounds[i + 1] - 1
        yield np.concatenate([word_buckets[a:b], repeated, *(g[low : max(low, high - n + 1)] for n, g in zip(GRAMS, grams))])


def sample_of(docs: DataFrame, labels: DataFrame, rows: int, per_row: int, bits: int) -> pd.DataFrame:
    """At most ``rows`` labelled rows of the learning folds, chosen by id hash: doc_id, label, buckets."""
    labelled = labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")
    )
    share = min(1.0, rows * 0.95 / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < share * 1_000_000).limit(rows)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            buckets = [f for part in slices(texts) for f in features(part, bits)]
            kept = [f[:: -(-len(f) // per_row)] if len(f) else f for f in buckets]
            yield pd.DataFrame({"label_id": batch["label_id"], "label": batch["label"], "buckets": [k.tobytes() for k in kept]})

    joined = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return (
        joined.select("label_id", "label", "text")
        .mapInPandas(thin, "label_id long, label int, buckets binary").limit(rows).toPandas()
        .sort_values(["label_id", "label", "buckets"], ignore_index=True)
    )


def train(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, per_row: int = SAMPLE_FEATURES, bits: int = BUCKET_BITS,
    dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7,
) -> Model:
    sample = sample_of(docs, labels, rows, per_row, bits)
    drawn = np.random.default_rng(seed)
    vectors = drawn.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    output = np.zeros((dimensions, 2), np.float32)
    bias = np.zeros(2, np.float32)
    rows_of = [(np.unique(np.frombuffer(b, np.int32), return_counts=True), y) for b, y in zip(sample["buckets"], sample["label"])]
    rows_of = [((ids, (n / n.sum()).astype(np.float32)), int(y > 0)) for (ids, n), y in rows_of if len(ids)]
    steps = epochs * len(rows_of)
    step = 0
    for _ in range(epochs):
        for i in drawn.permutation(len(rows_of)):
            (ids, share), y = rows_of[i]
            now = rate * (1 - step / steps)
            step += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = output @ p
            output -= now * np.outer(hidden, p)
            bias -= now * p
            # Shares sum to 1; scaled up so that a bucket moves although it is one of many.
            vectors[ids] = own - (now * len(ids) ** 0.5) * share[:, None] * back
    prior = float((sample["label"] > 0).mean()) if len(sample) else 0.5
    learned = len({y for _, y in rows_of}) == 2
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior, learned)


def scorer(docs: DataFrame, model: Model, bits: int = BUCKET_BITS):
    """Column function text -> score. The model is the only thing sent: 2 ** bits numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        out = []
        for part in slices(texts.tolist()):
            for buckets in features(part, bits):
                z = own.weights[buckets].mean(dtype=np.float64) + own.bias if len(buckets) else 0.0
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) if len(buckets) else own.prior)
        return pd.Series(out, dtype="float64")

    udf = F.pandas_udf(score, "double")

    def apply(text: Column) -> Column:
        return udf(text_of(text))

    return apply


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    score = scorer(docs, train(docs, labels, **options), options.get("bits", BUCKET_BITS))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows scored below the threshold; all columns. Without texts of both labels to learn from, all rows."""
    model = train(docs, labels, **options)
    if not model.learned:
        return docs
    score = scorer(docs, model, options.get("bits", BUCKET_BITS))
    return docs.where(score(F.col("text")) >= threshold)
