"""Questions that arrive over time, answered once each.

The streaming form of the resumable batch run: the stream's checkpoint records
which question files were read, and every micro-batch leaves out what the run
table already holds, so a replayed batch writes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuslens import fixed_values as fv
from corpuslens.operators.classify import Endpoint
from corpuslens.plans import retrieval


def read_question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """question_id and question from JSON-lines files as they appear."""
    return spark.readStream.schema("question_id string, question string").json(folder)


def answer_stream(
    questions: DataFrame, prompts: list[str], endpoint: Endpoint, path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the answers of each micro-batch to the run table at ``path``.

    Reads what is there and stops; call again (or schedule) to go on.
    """

    def one_batch(batch: DataFrame, _: int) -> None:
        # Read straight from the run table: what is pending is stored before any answer is added.
        finished = retrieval.saved_answers(batch.sparkSession, path).select("question_id", "prompt")
        index, k = options.get("index"), options.get("k", fv.TOP_K)
        rows = retrieval.to_ask(batch.dropDuplicates(["question_id"]), prompts, index=index, finished=finished, k=k)
        others = {name: value for name, value in options.items() if name not in ("index", "k")}
        retrieval.answer_in_blocks(rows, endpoint, path, **others)

    return (
        questions.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
