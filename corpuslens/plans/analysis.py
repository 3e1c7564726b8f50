"""Evaluation of saved answers: tables, report, charts and manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.operators import metrics, paired, validate
from corpuslens.plans import report
from corpuslens.session import store
from corpuslens.sources import readers
from corpuslens.sources.writers import write_csv


@dataclass(frozen=True)
class Analysis:
    sheet: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    subgroups: DataFrame
    audit: DataFrame
    disagreements: DataFrame
    mistakes: DataFrame


def analyse(questions: DataFrame, answers: DataFrame) -> Analysis:
    """All tables from validated questions and long answers.

    The sheet (one row per question) is the only shuffle of the answers; it is
    stored because seven tables read it.
    """
    sheet = store(metrics.score_sheet(answers, questions), "sheet")
    return Analysis(
        sheet=sheet,
        metrics=metrics.metrics_two_scopes(sheet),
        comparison=paired.paired_comparison(sheet),
        subgroups=metrics.subgroup_order(metrics.subgroup_metrics(sheet)),
        audit=paired.by_id(paired.audit_rows(sheet)),
        disagreements=paired.by_id(paired.disagreements(sheet), "prompt"),
        mistakes=paired.by_id(metrics.mistakes(sheet), "condition", "prompt"),
    )


def load(spark: SparkSession, question_file: str, folders: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Validated (questions, answers); raises at the first broken rule."""
    questions = store(readers.read_questions(spark, question_file), "questions")
    validate.require_rows(questions, "the question file")
    validate.require_none(validate.question_violations(questions))
    answers = store(readers.read_experiment(spark, folders), "answers")
    validate.require_none(validate.answer_violations(answers, questions))
    return questions, answers


def evaluate(spark: SparkSession, question_file: str, folder: str) -> tuple[list[dict], int]:
    """Metrics per prompt of one condition's answers, and the number of
    questions that all prompts answered. Empty answer files are allowed, a
    byte-order mark is not."""
    questions = store(readers.read_questions(spark, question_file), "questions")
    validate.require_none(validate.question_violations(questions, ["id", "correct_answer"]))
    answers = store(
        readers.read_experiment(spark, {"rag": folder}, allow_bom=False, allow_empty=True), "answers"
    )
    validate.require_none(validate.answer_violations(answers, questions))
    sheet = store(metrics.score_sheet(answers, questions), "sheet")
    rows = metrics.metrics_two_scopes(sheet).where("scope = 'available'").collect()
    found = {r["prompt"]: r.asDict() for r in rows}
    common = paired.common_ids(sheet, [metrics.run_column("rag", p) for p in fv.PROMPTS]).count()
    empty = {"n": 0, "coverage": 0.0, "tp": 0, "tn": 0, "fp": 0, "fn": 0}
    return [found.get(p, {"prompt": p, **empty}) for p in fv.PROMPTS], common


def run(spark: SparkSession, question_file: str, folders: dict[str, str], output: str) -> Analysis:
    """The whole evaluation; ``folders`` maps each condition to its answers."""
    questions, answers = load(spark, question_file, folders)
    result = analyse(questions, answers)
    common = paired.common_ids(result.sheet).count()
    if not common:
        raise readers.InvalidInput("the runs have no question in common")
    # A few rows each from here on: 12, 3 and one per run.
    metric_rows = [r.asDict() for r in result.metrics.collect()]
    pair_rows = sorted((r.asDict() for r in result.comparison.collect()), key=lambda r: fv.PROMPTS.index(r["prompt"]))
    if len(pair_rows) < len(fv.PROMPTS):
        raise readers.InvalidInput("a prompt has no question that both conditions answered")
    write_csv(report.in_order(result.metrics), f"{output}/metrics", fv.METRIC_FIELDS, single_file=True)
    write_csv(report.in_order(result.comparison), f"{output}/paired_comparison", fv.PAIRED_FIELDS, single_file=True)
    write_csv(result.subgroups, f"{output}/subgroup_metrics", fv.SUBGROUP_FIELDS)
    write_csv(result.audit, f"{output}/predictions", result.audit.columns)
    write_csv(result.disagreements, f"{output}/disagreements", fv.DISAGREEMENT_FIELDS)
    write_csv(result.mistakes, f"{output}/errors", fv.ERROR_FIELDS)

    total = questions.count()
    balance = metrics.class_balance(questions).first().asDict()
    text = report.render(metric_rows, pair_rows, balance, total, common)
    report.write_text(spark, f"{output}/report", text)
    for name, drawing in report.charts(metric_rows, pair_rows).items():
        report.write_text(spark, f"{output}/plots/{name}", drawing)
    files = {"dataset": question_file} | {
        f"{c}/{p}": f"{folders[c]}/answers_{p}.csv" for c, p in metrics.RUNS
    }
    hashes = {r["path"]: r["sha256"] for r in readers.file_hashes(spark, list(files.values())).collect()}
    counts = {
        (r["condition"], r["prompt"]): r["n"]
        for r in answers.groupBy("condition", "prompt").agg(F.count("*").alias("n")).collect()
    }
    report.write_text(spark, f"{output}/manifest", json.dumps(
        report.manifest(files, hashes, counts, total, common), indent=2))
    return result
