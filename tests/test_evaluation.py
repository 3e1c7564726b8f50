"""Metrics, paired statistics, validation and the whole analysis."""

import csv
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import stats
from corpuslens.operators import metrics, paired, validate
from corpuslens.plans import analysis, report
from corpuslens.sources import readers, writers

# Published results (735 questions, 585 positive). Per prompt: tp, tn with
# retrieval; tp, tn without; both correct; accuracy and its interval with
# retrieval; balanced accuracies; McNemar p.
PUBLISHED = {
    "luna": {
        "basic": (455, 51, 383, 81, 422, (0.688435, 0.654047, 0.720865), 0.558889, 0.597350, 0.000230),
        "oncology_expert": (468, 44, 411, 72, 445, (0.696599, 0.662412, 0.728741), 0.546667, 0.591282, 0.006016),
        "patient_education": (472, 44, 398, 75, 429, (0.702041, 0.667995, 0.733986), 0.550085, 0.590171, 0.000216),
    },
    "terra": {
        "basic": (335, 93, 349, 102, 379, (0.582313, 0.546321, 0.617449), 0.596325, 0.638291, 0.045052),
        "oncology_expert": (344, 83, 371, 100, 395, (0.580952, 0.544952, 0.616111), 0.570684, 0.650427, 0.000028),
        "patient_education": (362, 88, 373, 100, 409, (0.612245, 0.576524, 0.646799), 0.602735, 0.652137, 0.031302),
    },
}


def reference(spark, rows):
    schema = "id string, split string, cancer string, question string, correct_answer boolean"
    return spark.createDataFrame(rows, schema)


def answers(spark, rows):
    return spark.createDataFrame(rows, "condition string, prompt string, question_id string, answer boolean")


def published_answers(model):
    """Answers with the published counts; which question is right is free."""
    rows = []
    for prompt, (tp_r, tn_r, tp_n, tn_n, both, *_) in PUBLISHED[model].items():
        low, high = max(0, tp_r + tp_n - 585), min(tp_r, tp_n)
        both_pos = next(b for b in range(low, high + 1) if max(0, tn_r + tn_n - 150) <= both - b <= min(tn_r, tn_n))
        for first, size, right_r, right_n, common, truth in (
            (1, 585, tp_r, tp_n, both_pos, True), (586, 150, tn_r, tn_n, both - both_pos, False),
        ):
            for i in range(size):
                # First those right under retrieval; the others' right ones
                # begin so that exactly `common` overlap.
                is_r = i < right_r
                is_n = right_r - common <= i < right_r - common + right_n
                rows.append(("rag", prompt, str(first + i), truth == is_r))
                rows.append(("non_rag", prompt, str(first + i), truth == is_n))
    return rows


@pytest.mark.parametrize("model", PUBLISHED)
def test_published_numbers(spark, model):
    questions = reference(spark, [(str(i), "s", "c", f"q{i}", i <= 585) for i in range(1, 736)])
    result = analysis.analyse(questions, answers(spark, published_answers(model)))
    rows = {(r["scope"], r["condition"], r["prompt"]): r for r in result.metrics.collect()}
    assert len(rows) == 12
    pairs = {r["prompt"]: r for r in result.comparison.collect()}
    for prompt, (tp_r, tn_r, tp_n, tn_n, both, interval, bal_r, bal_n, p) in PUBLISHED[model].items():
        for scope in ("available", "pairwise_matched"):
            with_, without = rows[scope, "rag", prompt], rows[scope, "non_rag", prompt]
            assert (with_["n"], with_["tp"], with_["tn"], with_["fp"], with_["fn"]) == (735, tp_r, tn_r, 150 - tn_r, 585 - tp_r)
            assert (without["tp"], without["tn"]) == (tp_n, tn_n)
            got = (with_["accuracy"], with_["accuracy_ci_low"], with_["accuracy_ci_high"])
            assert got == pytest.approx(interval, abs=6e-7)
            assert with_["balanced_accuracy"] == pytest.approx(bal_r, abs=6e-7)
            assert without["balanced_accuracy"] == pytest.approx(bal_n, abs=6e-7)
            assert with_["coverage"] == 1.0
        assert pairs[prompt]["both_correct"] == both
        assert pairs[prompt]["mcnemar_exact_p"] == pytest.approx(p, abs=6e-7)
        assert pairs[prompt]["n"] == sum(pairs[prompt][k] for k in ("both_correct", "rag_only_correct", "non_rag_only_correct", "both_wrong"))


def test_four_rows_and_one_class(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "answer boolean, correct_answer boolean")
        return metrics.metrics_by(df).first()

    four = run([(True, True), (False, True), (True, False), (False, False)])
    assert [four[k] for k in ("tp", "tn", "fp", "fn")] == [1, 1, 1, 1]
    assert (four["accuracy"], four["balanced_accuracy"]) == (0.5, 0.5)
    one = run([(True, True)])
    assert one["specificity"] is None and one["balanced_accuracy"] is None and one["recall"] == 1.0


def exact_p(a, b):
    d, m = a + b, min(a, b)
    return 1.0 if d == 0 else min(1.0, 2 * sum(math.comb(d, i) for i in range(m + 1)) / 2**d)


def test_mcnemar_against_big_integers(spark):
    cases = [(0, 0), (3, 7), (7, 3), (0, 5), (1, 1), (84, 42), (500, 520), (0, 900), (1500, 1600), (15, 17), (16, 16), (1, 40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a long, b long").orderBy("i")
    got = [r[0] for r in df.select(stats.mcnemar_exact_p(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([exact_p(a, b) for a, b in cases], rel=1e-11)
    assert got[3] == pytest.approx(0.0625)


def test_mcnemar_of_huge_counts(spark):
    """Half a billion pairs each way, against the normal limit."""
    a, b = 500_000_000, 500_050_000
    p = spark.range(1).select(stats.mcnemar_exact_p(F.lit(a), F.lit(b))).first()[0]
    z = (b - a - 1) / math.sqrt(a + b)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def small_sheet(spark):
    questions = [("1", "a", "x", "q1", True), ("2", "a", " ", "q2", False), ("10", "b", "x", "q|10\nz", True), ("k", "b", "y", "qk", False)]
    given = {
        ("rag", "basic"): {"1": True, "2": True, "10": False, "k": False},
        ("rag", "oncology_expert"): {"1": True, "2": False, "10": True},
        ("rag", "patient_education"): {"1": False, "2": True, "10": True, "k": True},
        ("non_rag", "basic"): {"1": True, "2": False, "10": False},
        ("non_rag", "oncology_expert"): {"1": False, "2": False, "10": True, "k": True},
        ("non_rag", "patient_education"): {"1": True, "2": False, "10": False, "k": True},
    }
    rows = [(c, p, q, a) for (c, p), d in given.items() for q, a in d.items()]
    return reference(spark, questions), answers(spark, rows)


def test_tables_of_a_partial_run(spark):
    result = analysis.analyse(*small_sheet(spark))
    rows = {(r["scope"], r["condition"], r["prompt"]): r for r in result.metrics.collect()}
    assert rows["available", "rag", "basic"]["n"] == 4 and rows["pairwise_matched", "rag", "basic"]["n"] == 3
    assert rows["available", "non_rag", "basic"]["coverage"] == 0.75
    assert sorted(r["question_id"] for r in paired.common_ids(result.sheet).collect()) == ["1", "10", "2"]
    groups = {(r["group_type"], r["group"]): r["n"] for r in result.subgroups.collect()}
    assert groups == {("split", "a"): 2, ("split", "b"): 1, ("cancer", "x"): 2, ("cancer", "Unknown"): 1}
    order = [(r["group_type"], r["group"]) for r in result.subgroups.collect()][::6]
    assert order == [("split", "a"), ("split", "b"), ("cancer", "x"), ("cancer", "Unknown")]
    assert [r["question_id"] for r in result.audit.collect()] == ["1", "2", "10", "k"]
    last = result.audit.collect()[-1]
    assert last["rag_oncology_expert"] is None and last["rag_oncology_expert_correct"] is None
    changed = [(r["prompt"], r["question_id"], r["favored_condition"]) for r in result.disagreements.collect()]
    assert changed == [
        ("basic", "2", "non_rag"), ("oncology_expert", "1", "rag"), ("patient_education", "1", "non_rag"),
        ("patient_education", "2", "non_rag"), ("patient_education", "10", "rag"),
    ]
    wrong = [(r["condition"], r["prompt"], r["question_id"], r["error_type"]) for r in result.mistakes.collect()]
    assert wrong[:2] == [("non_rag", "basic", "10", "false_negative"), ("non_rag", "oncology_expert", "1", "false_negative")]
    split = paired.prompt_disagreements(result.sheet, "rag").collect()
    assert sorted(r["question_id"] for r in split) == ["1", "10", "2"]
    best = {r["metric"]: (r["condition"], r["prompt"]) for r in paired.best_runs(result.metrics, "accuracy").collect()}
    assert best == {"accuracy": ("rag", "oncology_expert")}


def test_one_shuffle_of_the_answers(spark, plan_of):
    questions, given = small_sheet(spark)
    plan = plan_of(metrics.wide_answers(given))
    assert plan.count("Exchange") == 1 and "partial_max" in plan


def write_inputs(folder: Path, questions, runs, bom=False):
    folder.mkdir()
    (folder / "questions.json").write_text(json.dumps(questions), encoding="utf-8")
    for (condition, prompt), rows in runs.items():
        (folder / condition).mkdir(exist_ok=True)
        text = "question_id,answer\n" + "".join(f"{q},{a}\n" for q, a in rows)
        (folder / condition / f"answers_{prompt}.csv").write_text(text, encoding="utf-8-sig" if bom else "utf-8")
    return str(folder / "questions.json"), {c: str(folder / c) for c in fv.CONDITIONS}


def all_runs(rows):
    return {(c, p): list(rows) for c, p in metrics.RUNS}


GOOD = [
    {"id": 1, "split": "s", "cancer": "c", "question": "q, \"1\"", "correct_answer": True},
    {"id": "2", "split": "s", "cancer": "d", "question": "q2", "correct_answer": False},
]


def read_csv(folder):
    files = sorted(Path(folder).glob("part-*.csv"))
    return [row for f in files for row in csv.DictReader(f.open(encoding="utf-8"))]


def test_whole_analysis_writes_its_files(spark, tmp_path):
    runs = all_runs([(" 1 ", " TRUE"), ("2", "true")])
    runs["non_rag", "basic"] = [("1", "false"), ("2", "False")]
    question_file, folders = write_inputs(tmp_path / "in", GOOD, runs, bom=True)
    out = tmp_path / "out"
    analysis.run(spark, question_file, folders, str(out))
    rows = read_csv(out / "metrics")
    assert list(rows[0]) == fv.METRIC_FIELDS and len(rows) == 12
    assert [r["prompt"] for r in rows] == [p for p in fv.PROMPTS for _ in range(4)]
    assert (rows[0]["accuracy"], rows[0]["coverage"], rows[0]["specificity"]) == ("0.500000", "1.000000", "0.000000")
    assert read_csv(out / "paired_comparison")[0]["mcnemar_exact_p"] == "1.000000"
    assert [r["question"] for r in read_csv(out / "predictions")] == ['q, "1"', "q2"]
    assert all(r["precision"] == "" for r in read_csv(out / "subgroup_metrics") if int(r["tp"]) + int(r["fp"]) == 0)
    text = "".join(p.read_text() for p in (out / "report").glob("part-*"))
    assert "| RAG | Basic | 2 | 100.00% |" in text and "without an answer" not in text
    manifest = json.loads("".join(p.read_text() for p in (out / "manifest").glob("part-*")))
    assert manifest["six_way_common_records"] == 2 and len(manifest["prediction_files"]) == 6
    assert len(manifest["dataset"]["sha256"]) == 64
    for name in ("overall_metrics", "accuracy_delta", "paired_outcomes", "confusion_matrices"):
        assert "".join(p.read_text() for p in (out / "plots" / name).glob("part-*")).startswith("<svg")


@pytest.mark.parametrize("change, rule", [
    (lambda q: q.append(dict(q[0])), "repeated_question_id"), (lambda q: q[0].pop("cancer"), "missing_fields"),
    (lambda q: q[0].update(id=" "), "blank_id"), (lambda q: q[0].update(correct_answer="true"), "label_not_boolean"),
    (lambda q: q[0].update(question=" "), "blank_question"), (lambda q: q.append(3), "not_an_object"),
    (lambda q: q.clear(), "must not be empty"),
])
def test_bad_questions(spark, tmp_path, change, rule):
    rows = [dict(r) for r in GOOD]
    change(rows)
    question_file, folders = write_inputs(tmp_path / "in", rows, all_runs([("1", "true")]))
    with pytest.raises(readers.InvalidInput, match=rule):
        analysis.load(spark, question_file, folders)


@pytest.mark.parametrize("rows, rule", [
    ([("1", "true"), ("1", "false")], "repeated_answer"), ([("9", "true")], "unknown_question_id"),
    ([("1", "yes")], "answer_not_boolean"), ([("1", "")], "answer_not_boolean"), ([], "empty"),
])
def test_bad_answers(spark, tmp_path, rows, rule):
    runs = all_runs([("1", "true")])
    runs["rag", "basic"] = rows
    question_file, folders = write_inputs(tmp_path / "in", GOOD, runs)
    with pytest.raises(readers.InvalidInput, match=rule):
        analysis.load(spark, question_file, folders)


def test_answer_file_rules(spark, tmp_path):
    path = tmp_path / "a.csv"
    with pytest.raises(FileNotFoundError):
        readers.read_answers(spark, str(path))
    path.write_text("answer,question_id\ntrue,1\n")
    with pytest.raises(readers.InvalidInput):
        readers.read_answers(spark, str(path))
    path.write_text("question_id,answer\n")
    assert readers.read_answers(spark, str(path), allow_empty=True).isEmpty()
    path.write_text("question_id,answer\n1,true\n", encoding="utf-8-sig")
    with pytest.raises(readers.InvalidInput):
        readers.read_answers(spark, str(path), allow_bom=False)
    (tmp_path / "object.json").write_text('{"id": 1}')
    with pytest.raises(readers.InvalidInput):
        readers.read_questions(spark, str(tmp_path / "object.json"))


def test_finished_run_rules(spark, tmp_path):
    def finished(text, **options):
        path = tmp_path / f"f{abs(hash((text, str(options))))}.csv"
        path.write_text(text)
        return sorted(r[0] for r in readers.read_finished(spark, str(path), **options).collect())

    assert readers.read_finished(spark, str(tmp_path / "none")).isEmpty()
    assert finished("") == [] and finished("question_id,answer\n") == []
    assert finished("question_id,answer\n 1 ,true\n2,false\n") == ["1", "2"]
    for bad in ("question_id,answer\n1,True\n", "question_id,answer\n1,true\n1,true\n", "id,answer\n1,true\n"):
        with pytest.raises(readers.InvalidInput):
            finished(bad)
    assert finished("question_id,answer\n1,true\n1,true\n", strict=False) == ["1", "1"]


def test_first_questions(spark, tmp_path):
    question_file, _ = write_inputs(tmp_path / "in", GOOD, {})
    rows = readers.read_questions(spark, question_file)
    assert [r["id"] for r in readers.first_questions(rows, 1).collect()] == ["1"]
    assert readers.first_questions(rows, None).count() == 2
    for bad in (0, 3):
        with pytest.raises(readers.InvalidInput):
            readers.first_questions(rows, bad)
    with pytest.raises(TypeError):
        readers.first_questions(rows, True)


def test_report_cells():
    rows = [{"a": "x|y\nz", "b": None}, {"a": 1}, {"a": 2}]
    assert report.table(rows, [("a", "A"), ("b", "B")], limit=2) == "| A | B |\n| --- | --- |\n| x\\|y z |  |\n| 1 |  |"
    assert [report.percent(None), report.percent(0.5), report.rate(0.12345), report.rate(None), report.rate(3)] == [
        "N/A", "50.00%", "0.1235", "N/A", "3"]
    assert report.points(-0.0313) == "-3.13"


def test_missing_and_counts(spark):
    wanted = spark.createDataFrame([("1",), ("2",)], "question_id string")
    done = spark.createDataFrame([("2",)], "question_id string")
    assert [r[0] for r in validate.missing_answers(wanted, done).collect()] == ["1"]
    with pytest.raises(readers.InvalidInput):
        validate.require_at_least_one(workers=0)
    assert writers.csv_columns(spark.range(1), ["id", "other"]).first().asDict() == {"id": "0", "other": ""}
