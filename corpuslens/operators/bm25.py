"""BM25 index and batch search as joins, aggregations and a top-k window."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx
from corpuslens.operators.chunks import with_search_text
from corpuslens.session import BROADCAST_ROWS, bucket_count, drop_bucketed, source_bytes, store, store_bucketed


RANK_DIGITS = 6


@dataclass(frozen=True)
class Bm25Index:
    chunks: DataFrame    # chunk rows, bucketed by chunk_id
    postings: DataFrame  # chunk_id, chunk_len, token, tf; bucketed by chunk_id
    terms: DataFrame     # token, df
    n_chunks: int
    total_len: int
    avg_idf: float
    stored: tuple[DataFrame, ...] = ()  # bucketed tables besides chunks and postings

    def close(self) -> None:
        """Drop the bucketed tables from the catalog; their files stay with the shared folder."""
        for table in (self.chunks, self.postings, *self.stored):
            drop_bucketed(table)

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_chunks


def idf(n_chunks: Column, df: Column) -> Column:
    """Raw inverse document frequency; negative for terms in over half the chunks."""
    return F.ln(n_chunks - df + 0.5) - F.ln(df + 0.5)


def average_idf(terms: DataFrame, n_chunks: int) -> float:
    """Average over distinct terms, taken from the histogram of df; 0 without terms."""
    by_df = terms.groupBy("df").agg(F.count("*").alias("c"))
    return by_df.agg(F.sum(F.col("c") * idf(F.lit(float(n_chunks)), F.col("df"))) / F.sum("c")).first()[0] or 0.0


def _runs(rows: DataFrame, text: Column) -> tuple[DataFrame, list[Column], Column]:
    """``rows`` with the sorted tokens, their other columns with ``n_tokens``, and the run lengths."""
    staged = rows.withColumn("_t", F.sort_array(tx.tokens(text))).withColumn("_s", tx.run_starts(F.col("_t")))
    kept = [*map(F.col, rows.columns), F.size("_t").cast("long").alias("n_tokens")]
    return staged, kept, tx.run_lengths(F.col("_t"), F.col("_s"))


def term_lists(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``n_tokens`` and ``terms``: array<struct<token,tf>> of the distinct tokens. To be stored before it is filtered or exploded."""
    staged, kept, terms = _runs(rows, text)
    return staged.select(*kept, terms.alias("terms"))


def term_counts(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``n_tokens`` and, one row per distinct token, ``token`` and ``tf``.

    All tokens of a text are in its own row, so they are counted there: sort
    the array, then take run lengths. No exchange and no hash table of
    (text, token) pairs. Texts without a token give no row.
    """
    staged, kept, terms = _runs(rows, text)
    return staged.select(*kept, F.inline(terms))


def make_postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, chunk_len, token, tf."""
    rows = with_search_text(chunks).select("chunk_id", "search_text")
    counted = term_counts(rows, F.col("search_text"))
    return counted.select("chunk_id", F.col("n_tokens").alias("chunk_len"), "token", "tf")


def build_index(chunks: DataFrame) -> Bm25Index:
    """Tokenize once and store chunks, postings and term counts.

    ``chunks`` must have unique chunk IDs. The corpus is shuffled at most once
    (none if already partitioned by chunk_id); term counts are combined on the
    map side before their shuffle.
    """
    buckets = bucket_count(chunks.sparkSession, source_bytes(chunks))
    chunk_table = store_bucketed(chunks, "chunks", "chunk_id", buckets)
    postings = store_bucketed(make_postings(chunk_table), "postings", "chunk_id", buckets)
    terms = store(postings.groupBy("token").agg(F.count("*").alias("df")), "terms")
    # Every chunk counts, also one without a single token.
    n_chunks = chunk_table.count()
    if not n_chunks:
        raise ValueError("at least one chunk is required")
    total_len = postings.agg(F.sum("tf")).first()[0] or 0
    return Bm25Index(chunk_table, postings, terms, n_chunks, total_len, average_idf(terms, n_chunks))


def question_weights(questions: DataFrame, index: Bm25Index) -> DataFrame:
    """question_id, token, weight: idf times the occurrences in the question.

    Terms unknown to the corpus drop out; negative idf is replaced by a
    fraction of the average one.
    """
    asked = term_counts(questions.select("question_id", "question"), F.col("question"))
    asked = asked.select("question_id", "token", F.col("tf").alias("qtf"))
    raw = idf(F.lit(float(index.n_chunks)), F.col("df"))
    floored = F.when(raw < 0, F.lit(fv.BM25_EPSILON * index.avg_idf)).otherwise(raw)
    return asked.join(index.terms, "token").select("question_id", "token", (F.col("qtf") * floored).alias("weight"))


def score(weights: DataFrame, index: Bm25Index) -> DataFrame:
    """question_id, chunk_id, score for all pairs that share a token.

    With broadcast ``weights`` the postings stay where they are, partitioned by
    chunk_id, and the sum needs no exchange either.
    """
    norm = 1 - fv.BM25_B + fv.BM25_B * F.col("chunk_len") / F.lit(index.avg_len)
    part = F.col("weight") * F.col("tf") * (fv.BM25_K1 + 1) / (F.col("tf") + fv.BM25_K1 * norm)
    return (
        index.postings.join(weights, "token")
        .groupBy("question_id", "chunk_id")
        .agg(F.sum(part).alias("score"))
    )


def rank_score() -> Column:
    """Score for comparisons: without the noise of the order of summation."""
    return F.round("score", RANK_DIGITS)


def top_k(pairs: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(rank_score().desc(), "chunk_id")
    # row_number is pruned to k per task before the shuffle by question.
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if index.avg_idf < 0:
        unmatched = pairs.groupBy("question_id").agg((F.lit(index.n_chunks) - F.count("*")).alias("_gap"))
        top = top.join(unmatched, "question_id").withColumn(
            "rank", F.col("rank") + F.when(rank_score() < 0, F.col("_gap")).otherwise(F.lit(0))
        )
        top = top.where(F.col("rank") <= k)
    return top.select("question_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


def search(questions: DataFrame, index: Bm25Index, k: int = fv.TOP_K, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """question_id, chunk_id, score, rank: hits within the first ``k`` places.

    Places are counted over all chunks. A chunk that shares no token scores 0,
    takes its place and is then left out, so matching chunks with a negative
    score (possible only where the average idf is negative) come after all of
    those. Scores equal in 6 decimals rank matching chunks first, then by
    chunk_id, so that ranks do not hang on the order of summation.

    Question terms are broadcast. A batch with more than ``block_rows`` of them
    is answered in blocks of whole questions, each of checked size: every block
    reads the postings once more, but neither postings nor scored pairs are
    ever shuffled by token. A block that is still too large (one huge
    question) takes the shuffled join, whose skew AQE splits.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    weights = store(question_weights(questions, index), "weights")
    rows = weights.count()
    if rows <= block_rows:
        return top_k(score(F.broadcast(weights), index), index, k)
    blocks = 2 * math.ceil(rows / block_rows)
    keyed = store(weights.withColumn("_block", F.pmod(F.xxhash64("question_id"), F.lit(blocks))), "weights")
    hits = []
    for block, size in sorted((r["_block"], r["count"]) for r in keyed.groupBy("_block").count().collect()):
        part = keyed.where(F.col("_block") == block).drop("_block")
        part = F.broadcast(part) if size <= block_rows else part
        hits.append(store(top_k(score(part, index), index, k), "hits"))
    return reduce(DataFrame.unionByName, hits)
