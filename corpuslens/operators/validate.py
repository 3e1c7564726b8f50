"""Input rules as tables of violations: rule, key, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import strip
from corpuslens.sources.readers import InvalidInput

REQUIRED = ["id", "split", "cancer", "question", "correct_answer"]


def _rows(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def question_violations(questions: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Rules for rows of :func:`corpuslens.sources.readers.read_questions`."""
    ord_ = F.col("question_ord")
    fields = F.coalesce(F.col("fields"), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(r) for r in sorted(required)]), fields)
    objects = questions.where("is_object")
    whole = objects.where(F.size(missing) == 0)
    frames = [
        _rows(questions.where("not is_object"), "not_an_object", ord_, F.lit("")),
        _rows(objects.where(F.size(missing) > 0), "missing_fields", ord_, F.array_join(missing, ",")),
        _rows(whole.where(F.coalesce("id", F.lit("")) == ""), "blank_id", ord_, F.lit("")),
        repeated(whole, ["id"], "repeated_question_id"),
        _rows(whole.where(strip(F.coalesce("question", F.lit(""))) == ""), "blank_question", F.col("id"), F.lit("")),
    ]
    if "correct_answer" in required:
        frames.append(
            _rows(whole.where(F.coalesce("answer_type", F.lit("")) != "BOOLEAN"), "label_not_boolean",
                  F.col("id"), F.coalesce("answer_type", F.lit("")))
        )
    return _union(frames)


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys on more than one row; counted on the map side first."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _rows(counts, rule, F.concat_ws("/", *keys), F.col("_n"))


def answer_violations(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Unknown IDs, repeated IDs per run and answers that are not Booleans.

    ``answers`` has condition, prompt, question_id, answer_text and answer.
    """
    run = F.concat_ws("/", "condition", "prompt", "question_id")
    unknown = answers.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_anti")
    return _union([
        _rows(unknown, "unknown_question_id", run, F.col("answer_text")),
        repeated(answers, ["condition", "prompt", "question_id"], "repeated_answer"),
        _rows(answers.where(F.col("answer").isNull()), "answer_not_boolean", run, F.col("answer_text")),
    ])


def require_none(violations: DataFrame) -> None:
    """Raise with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise InvalidInput("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".rstrip() for r in found))


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise InvalidInput(f"{what} must not be empty")


def require_at_least_one(**numbers: int) -> None:
    for name, value in numbers.items():
        if value < 1:
            raise InvalidInput(f"{name} must be at least 1")


def missing_answers(selected: DataFrame, finished: DataFrame) -> DataFrame:
    """Selected questions without a saved answer; empty after a full run."""
    return selected.select("question_id").join(finished, "question_id", "left_anti")
