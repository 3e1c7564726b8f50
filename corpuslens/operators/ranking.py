"""Ranked lists: fusion, metadata boosts, diversity and retrieval metrics.

Lists are tables of question_id, chunk_id and rank (from 1). Every cut is a row_number filter, which Spark
prunes to the wanted rows per question and task before it shuffles; sums are combined on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.session import broadcast_if_small

RRF_K = 60
KEEP = 30
FINAL, PER_SECTION = 8, 2
# Boosts of a chunk of the entity that a question names, names by an alias, or whose topic it names.
BOOSTS = {"entity": 0.5, "alias": 0.3, "topic": 0.1}
LEAST_MAPPED = 3
AUDIENCE_WEIGHTS = {"health_professional": 1.0, "patient": 0.85}
_DIGITS = 9


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- fusion -------------------------------------------------------------------------
def fuse(lists: dict[str, DataFrame], k: int = RRF_K, keep: int = KEEP) -> DataFrame:
    """question_id, chunk_id, score, sources, rank: reciprocal-rank fusion of named lists.

    A chunk counts once a list, at its best rank, and once in the result. Equal scores are ranked by chunk_id.
    """
    parts = [rows.select("question_id", "chunk_id", "rank", F.lit(name).alias("source")) for name, rows in sorted(lists.items())]
    best = reduce(DataFrame.unionByName, parts).groupBy("question_id", "chunk_id").agg(
        *[F.min(F.when(F.col("source") == name, F.col("rank"))).alias(f"_{name}") for name in sorted(lists)]
    )
    names = sorted(lists)
    # Added in the order of names, so that sums do not hang on the order of rows.
    score = sum((F.coalesce(1.0 / (k + F.col(f"_{n}")), F.lit(0.0)) for n in names), F.lit(0.0))
    sources = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names]))
    fused = best.select("question_id", "chunk_id", score.alias("score"), sources.alias("sources"))
    return top(fused, [F.round("score", _DIGITS).desc(), F.col("chunk_id")], keep)


# --- metadata -----------------------------------------------------------------------
def named_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """question_id, kind, value: what of ``terms`` (term, kind, value) each question names.

    Terms are matched as runs of tokens. Of matches that overlap the longest counts, then the first: "stomach
    cancer" hides "cancer". The table of terms is small by nature; its size is checked before it is broadcast.
    """
    keyed = terms.select(F.array_join(tx.tokens(F.col("term")), " ").alias("term"), F.size(tx.tokens(F.col("term"))).alias("n"), "kind", "value")
    keyed = keyed.where("n > 0").distinct()
    longest = keyed.agg(F.max("n")).first()[0] or 0
    asked = questions.select("question_id", tx.tokens(F.coalesce("question", F.lit(""))).alias("t")).where(F.size("t") > 0)
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("t")))
    runs = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(0), F.size("t") - n), lambda at: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice("t", at + 1, n), " ").alias("term")))))
    found = asked.where(F.lit(longest) > 0).select("question_id", F.explode(runs).alias("r")).select("question_id", "r.*").join(
        broadcast_if_small(keyed.drop("n")), "term")
    # All matches of one question are in one short list.
    listed = found.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("n"), "at", "kind", "value"))).alias("m"))

    def free(held: Column, m: Column) -> Column:
        apart = lambda x: (m["at"] - m["n"] <= x["at"]) | (x["at"] - x["n"] <= m["at"]) | ((m["at"] == x["at"]) & (m["n"] == x["n"]))
        return F.when(F.forall(held, apart), F.concat(held, F.array(m))).otherwise(held)

    none = F.slice("m", 1, F.lit(0))
    return listed.select("question_id", F.explode(F.aggregate("m", none, free)).alias("x")).select("question_id", "x.kind", "x.value").distinct()


def boost(
    ranked: DataFrame, chunks: DataFrame, named: DataFrame, weights: dict[str, float] = BOOSTS, least: int = LEAST_MAPPED,
    audiences: dict[str, float] = AUDIENCE_WEIGHTS, k: int = KEEP,
) -> DataFrame:
    """question_id, chunk_id, score, level, rank: hits (with ``score``) raised where their metadata match the question.

    ``named``: see :func:`named_terms`; kinds entity, alias and topic. A hit takes its strongest level; nothing is left out. Where fewer than
    ``least`` hits are of the named entity, the mapping is weak and the question's boosts fall away. Scores are
    multiplied by the weight of the chunk's audience, 1 where it has none.
    """
    own = named.groupBy("question_id").agg(*[
        F.collect_set(F.when(F.col("kind") == kind, F.col("value"))).alias(f"_{kind}") for kind in ("entity", "alias", "topic")])
    facts = chunks.select("chunk_id", "cancer_type", "topic", "audience")
    met = facts.join(broadcast_if_small(ranked), "chunk_id").join(broadcast_if_small(own), "question_id", "left")
    holds = lambda kind, column: F.coalesce(F.array_contains(f"_{kind}", F.col(column)), F.lit(False))
    level = F.when(holds("entity", "cancer_type"), "entity").when(holds("alias", "cancer_type"), "alias").when(holds("topic", "topic"), "topic")
    met = met.withColumn("level", level)
    mapped = F.count_if(F.col("level").isin("entity", "alias")).over(Window.partitionBy("question_id"))
    wanted = F.coalesce(F.size("_entity"), F.lit(0)) + F.coalesce(F.size("_alias"), F.lit(0)) > 0
    met = met.withColumn("level", F.when(wanted & (mapped < least), None).otherwise(F.col("level")))
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("level")], F.lit(0.0)) + 1
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in audiences.items() for x in kv])[F.col("audience")], F.lit(1.0))
    scored = met.select("question_id", "chunk_id", (F.col("score") * factor * weight).alias("score"), "level")
    return top(scored, [F.round("score", _DIGITS).desc(), F.col("chunk_id")], k)


# --- diversity ----------------------------------------------------------------------
def diverse(ranked: DataFrame, chunks: DataFrame, final: int = FINAL, per_section: int = PER_SECTION) -> DataFrame:
    """question_id, chunk_id, old_rank, filled, rank: the first ``final`` hits with at most ``per_section`` of one page section.

    Where the cap leaves fewer, the best of the others fill up (``filled``). Order is that of the ranks given.
    """
    place = chunks.select("chunk_id", F.xxhash64("url", "section_path").alias("_section"))
    met = place.join(broadcast_if_small(ranked.select("question_id", "chunk_id", F.col("rank").alias("old_rank"))), "chunk_id")
    nth = F.row_number().over(Window.partitionBy("question_id", "_section").orderBy("old_rank", "chunk_id"))
    met = met.withColumn("filled", nth > per_section)
    kept = top(met, [F.col("filled"), F.col("old_rank"), F.col("chunk_id")], final)
    return top(kept.select("question_id", "chunk_id", "old_rank", "filled"), [F.col("old_rank"), F.col("chunk_id")], final)


# --- metrics ------------------------------------------------------------------------
def retrieval_metrics(ranked: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = (5, 10), gain_cut: int = 10) -> DataFrame:
    """question_id, n_relevant, recall_<k>, reciprocal_rank, ndcg_<gain_cut> of every judged question with a relevant chunk.

    ``judged``: question_id, chunk_id, grade; grades above 0 are relevant, a pair's highest counts. Gains are
    2^grade - 1. A question without hits scores 0.
    """
    wanted = judged.where("grade > 0").groupBy("question_id", "chunk_id").agg(F.max("grade").alias("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    discount = lambda place: F.log2(place + 1)
    w = Window.partitionBy("question_id").orderBy(F.col("grade").desc(), "chunk_id")
    totals = wanted.groupBy("question_id").agg(F.count("*").alias("n_relevant"))
    ideal = wanted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= gain_cut).groupBy("question_id").agg(
        F.sum(gain / discount(F.col("place"))).alias("_ideal"))
    first = ranked.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    hits = first.join(wanted, ["question_id", "chunk_id"]).groupBy("question_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_in_{k}") for k in cuts], F.min("rank").alias("_first"),
        F.sum(F.when(F.col("rank") <= gain_cut, gain / discount(F.col("rank")))).alias("_gain"),
    )
    zero = F.lit(0.0)
    return totals.join(ideal, "question_id").join(hits, "question_id", "left").select(
        "question_id", "n_relevant", *[(F.coalesce(f"_in_{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}") for k in cuts],
        F.coalesce(1.0 / F.col("_first"), zero).alias("reciprocal_rank"),
        F.coalesce(F.col("_gain") / F.col("_ideal"), zero).alias(f"ndcg_{gain_cut}"),
    )


def mean_metrics(per_question: DataFrame) -> DataFrame:
    """One row: questions and the mean of each metric."""
    names = [c for c in per_question.columns if c not in ("question_id", "n_relevant")]
    return per_question.agg(F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in names])
