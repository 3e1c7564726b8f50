"""Classification metrics from predictions joined with reference labels.

Everything runs from one wide row per question (see :func:`wide_answers`): the
predictions are shuffled once, by question, and all reports after that are
narrow steps and small aggregations combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import stats
from corpuslens.functions import text as tx

RUNS = [(c, p) for c in fv.CONDITIONS for p in fv.PROMPTS]


def run_column(condition: str, prompt: str) -> str:
    return f"{condition}_{prompt}"


RUN_COLUMNS = [run_column(c, p) for c, p in RUNS]


def wide_answers(predictions: DataFrame) -> DataFrame:
    """question_id and one Boolean column per (condition, prompt); NULL = not answered."""
    def pick(condition: str, prompt: str) -> Column:
        here = (F.col("condition") == condition) & (F.col("prompt") == prompt)
        return F.max(F.when(here, F.col("answer"))).alias(run_column(condition, prompt))

    return predictions.groupBy("question_id").agg(*[pick(c, p) for c, p in RUNS])


def score_sheet(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Every reference question with its six answers (NULL where missing)."""
    labels = questions.select(
        F.col("id").alias("question_id"), "split", "cancer", "question", "correct_answer",
        *[c for c in ("question_ord",) if c in questions.columns],
    )
    return labels.join(wide_answers(predictions), "question_id", "left")


def all_answered(names: list[str] = RUN_COLUMNS) -> Column:
    done = F.lit(True)
    for name in names:
        done = done & F.col(name).isNotNull()
    return done


def long_answers(sheet: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per answered (question, condition, prompt), plus ``paired``:
    the other condition answered this prompt too."""
    def run(condition: str, prompt: str) -> Column:
        pair = [F.col(run_column(c, prompt)).isNotNull() for c in fv.CONDITIONS]
        return F.struct(
            F.lit(condition).alias("condition"), F.lit(prompt).alias("prompt"),
            F.col(run_column(condition, prompt)).alias("answer"), (pair[0] & pair[1]).alias("paired"),
        )

    return sheet.select(*keep, F.inline(F.array(*[run(c, p) for c, p in RUNS]))).where(F.col("answer").isNotNull())


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(stats.metric_columns())


def metrics_by(long: DataFrame, *keys: str) -> DataFrame:
    counts = stats.confusion(F.col("answer"), F.col("correct_answer"))
    return with_metrics(long.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()]))


def metrics_two_scopes(sheet: DataFrame) -> DataFrame:
    """All answers of a run, and those on questions both conditions answered.

    Coverage needs the number of reference questions; it is a scalar
    subquery over the same sheet, not a pass through the driver.
    """
    long = long_answers(sheet, "correct_answer")
    scoped = long.withColumn(
        "scope",
        F.explode(F.when(F.col("paired"), F.array(F.lit("available"), F.lit("pairwise_matched")))
                  .otherwise(F.array(F.lit("available")))),
    )
    rows = metrics_by(scoped, "scope", "condition", "prompt")
    total = sheet.agg(F.count("*")).scalar()
    return rows.withColumn("coverage", stats.ratio(F.col("n"), total)).select(*fv.METRIC_FIELDS)


def group_name(value: Column) -> Column:
    return F.coalesce(tx.truthy(tx.strip(value)), F.lit(fv.UNKNOWN_GROUP))


def subgroup_metrics(sheet: DataFrame) -> DataFrame:
    """Metrics by split and by cancer on questions that all six runs answered."""
    common = sheet.where(all_answered())
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("group_type"), group_name(F.col(kind)).alias("group"))
        for kind in ("split", "cancer")
    ])
    # One row per group first: confusion counts of all six runs side by side.
    keyed = common.select(F.inline(kinds), "correct_answer", *RUN_COLUMNS)
    aggs = [F.count_if("correct_answer").alias("positives")]
    for name in RUN_COLUMNS:
        counts = stats.confusion(F.col(name), F.col("correct_answer"))
        aggs.append(F.struct(*[c.alias(n) for n, c in counts.items()]).alias(name))
    grouped = keyed.groupBy("group_type", "group").agg(*aggs)
    runs = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.lit(p).alias("prompt"),
                 *[F.col(f"{run_column(c, p)}.{n}").alias(n) for n in ("n", "tp", "tn", "fp", "fn")])
        for c, p in RUNS
    ])
    rows = grouped.select("group_type", "group", "positives", F.inline(runs))
    return with_metrics(rows).withColumn("prevalence", stats.ratio(F.col("positives"), F.col("n"))).select(
        *fv.SUBGROUP_FIELDS
    )


def subgroup_order(rows: DataFrame) -> DataFrame:
    """Split before cancer, larger groups first, names without case."""
    return rows.orderBy(F.desc("group_type"), F.desc("n"), F.lower("group"), "group", "condition", "prompt")


def group_metrics(long: DataFrame, field: str, largest: int | None = None) -> DataFrame:
    """Short per-group table rounded to 4 decimals, larger groups first; an
    empty name is Unknown. ``largest`` shows that many groups only."""
    name = F.coalesce(tx.truthy(F.col(field)), F.lit(fv.UNKNOWN_GROUP))
    rows = metrics_by(long.withColumn("group", name), "group")
    shown = rows.select("group", "n", *[F.round(m, 4).alias(m) for m in ("accuracy", "precision", "recall", "f1")]).orderBy(
        F.desc("n"), "group"
    )
    return shown if largest is None else shown.limit(largest)


def common_metrics(sheet: DataFrame, condition: str) -> DataFrame:
    """Per prompt, over each prompt's answers and over the questions that all
    prompts of this condition answered; rates rounded to 4 decimals."""
    names = [run_column(condition, p) for p in fv.PROMPTS]
    everyone = all_answered(names)
    long = long_answers(sheet.withColumn("_all", everyone), "correct_answer", "_all").where(
        F.col("condition") == condition
    )
    scoped = long.withColumn(
        "scope",
        F.explode(F.when(F.col("_all"), F.array(F.lit("available"), F.lit("common")))
                  .otherwise(F.array(F.lit("available")))),
    )
    rates = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"]
    rows = metrics_by(scoped, "scope", "prompt")
    return rows.select("scope", "prompt", "n", *[F.round(r, 4).alias(r) for r in rates], "tp", "tn", "fp", "fn")


def class_balance(questions: DataFrame) -> DataFrame:
    return questions.agg(
        F.count_if("correct_answer").alias("positives"), F.count_if(~F.col("correct_answer")).alias("negatives")
    )


def mistakes(sheet: DataFrame) -> DataFrame:
    """Every wrong answer with its kind of error."""
    order = [c for c in ("question_ord",) if c in sheet.columns]
    long = long_answers(sheet, "question_id", "split", "cancer", "question", "correct_answer", *order)
    return long.where(F.col("answer") != F.col("correct_answer")).select(
        "condition", "prompt", "question_id", "split", "cancer", "correct_answer",
        F.col("answer").alias("predicted_answer"),
        F.when(F.col("answer"), "false_positive").otherwise("false_negative").alias("error_type"),
        "question", *order,
    )
