"""Comparisons of two conditions, or of all prompts, on the same questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import stats
from corpuslens.functions import text as tx
from corpuslens.operators.metrics import RUN_COLUMNS, all_answered, run_column


def pairs(sheet: DataFrame, *keep: str) -> DataFrame:
    """One row per (question, prompt) answered under both conditions.

    The sheet already has both answers side by side, so the join of the two
    conditions costs no further shuffle.
    """
    per_prompt = F.array(*[
        F.struct(
            F.lit(p).alias("prompt"),
            F.col(run_column("rag", p)).alias("rag_answer"),
            F.col(run_column("non_rag", p)).alias("non_rag_answer"),
        )
        for p in fv.PROMPTS
    ])
    return sheet.select(*keep, "correct_answer", F.inline(per_prompt)).where(
        F.col("rag_answer").isNotNull() & F.col("non_rag_answer").isNotNull()
    )


def paired_comparison(sheet: DataFrame) -> DataFrame:
    """Outcome counts, accuracy difference and exact McNemar p per prompt."""
    rag = F.col("rag_answer") == F.col("correct_answer")
    non = F.col("non_rag_answer") == F.col("correct_answer")
    counts = pairs(sheet).groupBy("prompt").agg(
        F.count("*").alias("n"),
        F.count_if(rag & non).alias("both_correct"),
        F.count_if(rag & ~non).alias("rag_only_correct"),
        F.count_if(~rag & non).alias("non_rag_only_correct"),
        F.count_if(~rag & ~non).alias("both_wrong"),
    )
    both, only, other = (F.col(c) for c in ("both_correct", "rag_only_correct", "non_rag_only_correct"))
    return counts.withColumns(
        {
            "rag_accuracy": stats.ratio(both + only, F.col("n")),
            "non_rag_accuracy": stats.ratio(both + other, F.col("n")),
            "discordant": only + other,
            "mcnemar_exact_p": stats.mcnemar_exact_p(only, other),
        }
    ).withColumn("accuracy_delta", F.col("rag_accuracy") - F.col("non_rag_accuracy")).select(*fv.PAIRED_FIELDS)


def disagreements(sheet: DataFrame) -> DataFrame:
    rows = pairs(sheet, "question_id", "split", "cancer", "question")
    return rows.where(F.col("rag_answer") != F.col("non_rag_answer")).withColumn(
        "favored_condition",
        F.when(F.col("rag_answer") == F.col("correct_answer"), "rag").otherwise("non_rag"),
    ).select(*fv.DISAGREEMENT_FIELDS)


def prompt_disagreements(sheet: DataFrame, condition: str) -> DataFrame:
    """Questions that all prompts of a condition answered, not all alike."""
    names = [run_column(condition, p) for p in fv.PROMPTS]
    split = F.size(F.array_distinct(F.array(*names))) > 1
    return sheet.where(all_answered(names) & split).select(
        "question_id", "correct_answer", *[F.col(n).alias(p) for n, p in zip(names, fv.PROMPTS)], "question"
    )


def common_ids(sheet: DataFrame, names: list[str] = RUN_COLUMNS) -> DataFrame:
    return sheet.where(all_answered(names)).select("question_id")


def audit_rows(sheet: DataFrame) -> DataFrame:
    """All questions with every answer and whether it is right."""
    answers: list[Column] = []
    for name in RUN_COLUMNS:
        answers += [F.col(name), (F.col(name) == F.col("correct_answer")).alias(f"{name}_correct")]
    return sheet.select("question_id", "split", "cancer", "correct_answer", *answers, "question")


def best_runs(metrics: DataFrame, *names: str) -> DataFrame:
    """metric, condition, prompt, value: the best run per metric among matched
    scores. Ties go to the earlier prompt, then to the retrieval condition.

    The input has six rows per model, whatever the data size.
    """
    prompt_ord = F.array_position(F.array(*[F.lit(p) for p in fv.PROMPTS]), F.col("prompt"))
    cond_ord = F.array_position(F.array(*[F.lit(c) for c in fv.CONDITIONS]), F.col("condition"))
    rows = metrics.where(F.col("scope") == "pairwise_matched").select(
        "condition", "prompt", prompt_ord.alias("_p"), cond_ord.alias("_c"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])),
    )
    w = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), "_p", "_c")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("metric", "condition", "prompt", "value")


def ranges(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.min("accuracy_delta").alias("min_delta"), F.max("accuracy_delta").alias("max_delta"),
        F.min("mcnemar_exact_p").alias("min_p"), F.max("mcnemar_exact_p").alias("max_p"),
    )


def by_id(rows: DataFrame, *before: str) -> DataFrame:
    """Sorted by the given columns, then by question ID (numbers by value)."""
    return rows.orderBy(*before, *tx.sort_key(F.col("question_id")))
