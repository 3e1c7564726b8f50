"""Questions to classified answers, with and without retrieval."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.messages import check_prompt
from corpuslens.functions.text import has_text
from corpuslens.operators import bm25, chunks, evidence
from corpuslens.operators.classify import Endpoint, Transport, ask, classify, post_json, strict_boolean
from corpuslens.session import store
from corpuslens.sources import readers

# Requests between two commits of a run.
BLOCK_ROWS = 5_000


def load_chunks(
    spark: SparkSession, folders: list[str], target: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    """Deduplicated chunks of all page JSON files in ``folders``."""
    return chunks.chunk_pages(readers.read_page_json(spark, folders), target, overlap)


def retrieve(questions: DataFrame, index: bm25.Bm25Index, k: int = fv.TOP_K) -> tuple[DataFrame, DataFrame]:
    """(hits, question_id + question + evidence). Hits are stored: both the
    text block and the records read them."""
    hits = store(bm25.search(questions, index, k), "hits")
    return hits, evidence.evidence_text(questions, hits, index.chunks)


def to_ask(
    questions: DataFrame, prompts: list[str], *, index: bm25.Bm25Index | None = None, finished: DataFrame | None = None,
    k: int = fv.TOP_K,
) -> DataFrame:
    """question_id, prompt, message for all pending (question, prompt), stored.

    ``index`` turns retrieval on; it uses the raw question, not the prompt.
    ``finished`` (question_id, prompt) is left out, before retrieval. The corpus is
    scored once for all prompts. A blank question has no message.
    """
    asked = questions.select("question_id", "question")
    pending = None
    if finished is not None:
        pending = store(pairs(asked, prompts).join(finished, ["question_id", "prompt"], "left_anti"), "pending")
        asked = asked.join(pending, "question_id", "left_semi")
    asked = store(asked, "asked")
    full = asked.where(has_text(F.col("question")))
    rows = evidence.messages_for(retrieve(full, index, k)[1] if index is not None else full, prompts)
    blank = pairs(asked.where(~has_text(F.col("question"))), prompts).withColumn("message", F.lit(None).cast("string"))
    rows = rows.unionByName(blank)
    if pending is not None:
        rows = rows.join(pending, ["question_id", "prompt"], "left_semi")
    return store(rows, "to-ask")


def answer(
    questions: DataFrame,
    prompts: list[str],
    endpoint: Endpoint,
    *,
    index: bm25.Bm25Index | None = None,
    finished: DataFrame | None = None,
    k: int = fv.TOP_K,
    **options,
) -> DataFrame:
    """question_id, prompt, answer, error for all pending (question, prompt); see :func:`to_ask`."""
    return classify(to_ask(questions, prompts, index=index, finished=finished, k=k), endpoint, **options)


def pairs(questions: DataFrame, prompts: list[str]) -> DataFrame:
    """question_id, prompt for every question under every prompt."""
    return questions.select("question_id", F.explode(F.array(*[F.lit(p) for p in prompts])).alias("prompt"))


def classify_question(
    spark: SparkSession, question: str, prompt: str, endpoint: Endpoint, index: bm25.Bm25Index, *,
    k: int = fv.TOP_K, transport: Transport = post_json,
) -> tuple[bool, list[dict]]:
    """One question, interactively: (answer, evidence records by rank)."""
    if not question.strip():
        raise ValueError("the question must not be empty")
    check_prompt(prompt)
    rows = spark.createDataFrame([("1", question.strip())], "question_id string, question string")
    hits, found = retrieve(rows, index, k)
    message = evidence.messages_for(rows, [prompt], found).first()["message"]
    records = evidence.evidence_json(hits, index.chunks).first()
    value = strict_boolean(ask(endpoint.check(), message, transport))
    return value, json.loads(records["evidence_json"]) if records else []


def append_answers(answers: DataFrame, path: str) -> None:
    """Add answers to the run table (partitioned by prompt), committed as one job.
    Failed rows are not written and stay pending."""
    answers.where(F.col("answer").isNotNull()).select(
        "question_id", F.col("answer").cast("string").alias("answer"), "prompt"
    ).write.mode("append").partitionBy("prompt").csv(path, header=True)


def answer_in_blocks(rows: DataFrame, endpoint: Endpoint, path: str, block_rows: int = BLOCK_ROWS, **options) -> None:
    """Ask for the stored ``rows`` of :func:`to_ask` and save the answers.

    Every block of about ``block_rows`` requests is a job with a commit of its own:
    a run that is stopped loses one block at most, and ``resume`` asks for the rest.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("question_id", "prompt"), F.lit(blocks)) == block)
        append_answers(classify(mine, endpoint, **options), path)


def saved_answers(spark: SparkSession, path: str) -> DataFrame:
    """question_id, answer, prompt saved so far by :func:`append_answers`."""
    schema = "question_id string, answer string, prompt string"
    if not readers._exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def resume(
    questions: DataFrame, prompts: list[str], endpoint: Endpoint, path: str, *, index: bm25.Bm25Index | None = None,
    k: int = fv.TOP_K, block_rows: int = BLOCK_ROWS, **options,
) -> DataFrame:
    """Answer what is not saved yet, save it block by block, and return what still is missing."""
    spark = questions.sparkSession
    finished = saved_answers(spark, path).select("question_id", "prompt")
    rows = to_ask(questions, prompts, index=index, finished=finished, k=k)
    answer_in_blocks(rows, endpoint, path, block_rows, **options)
    return pairs(questions, prompts).join(saved_answers(spark, path), ["question_id", "prompt"], "left_anti")
