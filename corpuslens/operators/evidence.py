"""Ranked hits to evidence text and evidence records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens import schemas
from corpuslens.functions import messages
from corpuslens.session import broadcast_if_small


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk fields. The hits are few (k per question), so the
    chunk texts are looked up in place instead of being shuffled."""
    return chunks.select(*schemas.CHUNK_FIELDS).join(broadcast_if_small(hits), "chunk_id")


def evidence_text(questions: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, evidence: passages by rank, or the fixed sentence.

    Each list holds at most k passages of bounded length.
    """
    block = messages.passage(
        F.col("rank"), F.col("title"), F.col("cancer_type"), F.col("topic"), F.col("section_path"), F.col("text")
    )
    grouped = (
        hit_rows(hits, chunks)
        .select("question_id", F.struct("rank", block.alias("block")).alias("b"))
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list("b")).alias("bs"))
        .select("question_id", F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n").alias("evidence"))
    )
    return questions.join(grouped, "question_id", "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(fv.NO_EVIDENCE))
    )


def evidence_json(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, evidence_json: array of 12-field records by rank."""
    record = F.struct(
        "rank", "score", "chunk_id", "title", "cancer_type", "topic", "audience", "section", "section_path",
        "url", "source_file", F.substring("text", 1, fv.EVIDENCE_CHARS).alias("passage"),
    )
    return (
        hit_rows(hits, chunks)
        .select("question_id", record.alias("r"))
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list("r")).alias("rs"))
        .select("question_id", F.to_json("rs", {"ignoreNullFields": "false"}).alias("evidence_json"))
    )


def messages_for(questions: DataFrame, prompts: list[str], evidence: DataFrame | None = None) -> DataFrame:
    """question_id, prompt, message for every question and prompt key.

    With ``evidence`` (question_id, evidence), or an ``evidence`` column in the
    questions, the retrieval wording is used, without it the plain one. Prompt keys
    are few and fixed: exploding a literal array replaces a cross product.
    """
    keys = F.array(*[F.lit(messages.check_prompt(p)) for p in prompts])
    rows = questions
    if evidence is not None:
        rows = questions.join(evidence.select("question_id", "evidence"), "question_id", "left")
    elif "evidence" not in questions.columns:
        rows = questions.withColumn("evidence", F.lit(None).cast("string"))
    rows = rows.select("question_id", F.explode(keys).alias("prompt"), "question", "evidence")
    text = messages.render_prompt(F.col("prompt"), F.col("question"))
    return rows.select("question_id", "prompt", messages.user_message(text, F.col("evidence")).alias("message"))
