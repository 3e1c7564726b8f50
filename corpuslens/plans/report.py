"""Markdown report, charts and manifest from a few collected rows."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv

Row = dict


def in_order(rows: DataFrame) -> DataFrame:
    """Report order: prompt, condition, scope."""
    keys = [("prompt", fv.PROMPTS), ("condition", fv.CONDITIONS), ("scope", ["available", "pairwise_matched"])]
    return rows.orderBy(*[
        F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        for name, values in keys if name in rows.columns
    ])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def percent(value: float | None) -> str:
    return "N/A" if value is None else f"{value:.2%}"


def rate(value: float | int | None) -> str:
    """Four decimals, N/A where undefined; counts as they are."""
    return "N/A" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def points(value: float) -> str:
    return f"{value * 100:+.2f}"


def table(rows: list[Row], columns: list[tuple[str, str]], limit: int | None = None) -> str:
    """Markdown table; pipes are escaped and line ends become spaces."""
    def cell(value) -> str:
        return ("" if value is None else str(value)).replace("|", "\\|").replace("\n", " ")

    lines = [[label for _, label in columns], ["---"] * len(columns)]
    lines += [[cell(r.get(key, "")) for key, _ in columns] for r in rows[:limit]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def run_name(condition: str) -> str:
    return condition.replace("_", "-").upper()


def by_run(metric_rows: list[Row], scope: str) -> dict[tuple[str, str], Row]:
    return {(r["condition"], r["prompt"]): r for r in metric_rows if r["scope"] == scope}


def _span(values: list[float | None]) -> str:
    known = [v for v in values if v is not None]
    return f"{points(min(known))} to {points(max(known))} percentage points" if known else "N/A"


def render(metric_rows: list[Row], pair_rows: list[Row], balance: Row, total: int, common: int) -> str:
    """Differences, rates and coverage as Markdown.

    Directions are worded from the signs of the differences.
    """
    available, matched = by_run(metric_rows, "available"), by_run(metric_rows, "pairwise_matched")
    runs = [(c, p) for p in fv.PROMPTS for c in fv.CONDITIONS]

    def gaps(metric: str) -> list[float | None]:
        both = [(matched["rag", p][metric], matched["non_rag", p][metric]) for p in fv.PROMPTS]
        return [None if a is None or b is None else a - b for a, b in both]

    def best(metric: str) -> str:
        known = [k for k in runs if matched[k][metric] is not None]
        if not known:
            return "N/A"
        top = max(known, key=lambda k: matched[k][metric])
        return f"**{percent(matched[top][metric])}** ({run_name(top[0])}, {fv.PROMPT_TITLES[top[1]]})"

    coverage = [
        {"c": run_name(c), "p": fv.PROMPT_TITLES[p], "n": available[c, p]["n"], "v": percent(available[c, p]["coverage"])}
        for c in fv.CONDITIONS for p in fv.PROMPTS if (c, p) in available
    ]
    results = [
        {
            "p": fv.PROMPT_TITLES[p], "c": run_name(c), "n": r["n"],
            "a": f"{percent(r['accuracy'])} ({percent(r['accuracy_ci_low'])} to {percent(r['accuracy_ci_high'])})",
            **{m: percent(r[m]) for m in ("precision", "recall", "specificity", "f1", "balanced_accuracy")},
        }
        for c, p in runs for r in [matched[c, p]]
    ]
    effect = [
        {
            "p": fv.PROMPT_TITLES[r["prompt"]], "n": r["n"], "a": percent(r["rag_accuracy"]),
            "b": percent(r["non_rag_accuracy"]), "d": f"{points(r['accuracy_delta'])} pp",
            "x": r["rag_only_correct"], "y": r["non_rag_only_correct"], "q": f"{r['mcnemar_exact_p']:.6f}",
        }
        for r in pair_rows
    ]
    p_values = [r["mcnemar_exact_p"] for r in pair_rows]
    positives = balance["positives"]
    parts = [
        "# Answers with and without retrieved passages",
        f"Compared on the questions that both conditions answered; {common:,} of {total:,} questions have all six answers. "
        f"{percent(positives / total)} of the reference labels ({positives:,} of {positives + balance['negatives']:,}) are positive.",
        "## Differences",
        f"| Rate | Retrieval minus none |\n| --- | --- |\n| Accuracy | {_span(gaps('accuracy'))} |\n"
        f"| Recall | {_span(gaps('recall'))} |\n| Specificity | {_span(gaps('specificity'))} |\n"
        f"| Balanced accuracy | {_span(gaps('balanced_accuracy'))} |",
        f"Highest accuracy: {best('accuracy')}. Highest balanced accuracy: {best('balanced_accuracy')}.",
        table(effect, [
            ("p", "Prompt"), ("n", "Matched n"), ("a", "RAG accuracy"), ("b", "Non-RAG accuracy"), ("d", "Difference"),
            ("x", "RAG-only correct"), ("y", "Non-RAG-only correct"), ("q", "Exact McNemar p"),
        ]),
        *_notes(pair_rows, p_values),
        "## Rates per run",
        table(results, [
            ("p", "Prompt"), ("c", "Condition"), ("n", "n"), ("a", "Accuracy (95% CI)"), ("precision", "Precision"),
            ("recall", "Recall"), ("specificity", "Specificity"), ("f1", "F1"), ("balanced_accuracy", "Balanced accuracy"),
        ]),
        "## Answers per run",
        table(coverage, [("c", "Condition"), ("p", "Prompt"), ("n", "Predictions"), ("v", "Coverage")]),
    ]
    short = [f"{run_name(c)}, {fv.PROMPT_TITLES[p]}: {total - r['n']:,}" for (c, p), r in available.items() if r["n"] != total]
    if short:
        parts.append("Questions without an answer: " + "; ".join(short) + ".")
    return "\n\n".join(parts) + "\n"


def _notes(pair_rows: list[Row], p_values: list[float]) -> list[str]:
    """What the tables show about their own reach."""
    differing = [r["discordant"] for r in pair_rows]
    below = sum(p < 0.05 / len(p_values) for p in p_values)
    return [
        f"The two conditions disagree in correctness on {min(differing):,} to {max(differing):,} questions per prompt. "
        f"With three tests, a p-value counts at {0.05 / len(p_values):.4f}: {below} of {len(p_values)} are below it."
    ]


def shown_path(path: str) -> str:
    """A local path below the working folder relative to it; any other as it is."""
    if "://" in path:
        return path
    full, here = Path(path).resolve(), Path.cwd()
    return full.relative_to(here).as_posix() if full.is_relative_to(here) else path


def manifest(files: dict[str, str], hashes: dict[str, str], counts: dict, total: int, common: int) -> dict:
    def entry(path: str, records: int) -> dict:
        return {"path": shown_path(path), "sha256": hashes[path], "records": records}

    return {
        "analysis": {
            "prompts": fv.PROMPTS, "conditions": fv.CONDITIONS,
            "comparison_scope": "questions both conditions answered, per prompt",
            "subgroup_scope": "questions all six runs answered",
            "accuracy_interval": "95% Wilson score interval",
            "paired_test": "two-sided exact McNemar test, unadjusted",
        },
        "dataset": entry(files["dataset"], total),
        "prediction_files": [
            {"condition": c, "prompt": p, **entry(files[f"{c}/{p}"], counts[c, p])}
            for c in fv.CONDITIONS for p in fv.PROMPTS
        ],
        "six_way_common_records": common,
    }


# --- charts: plain SVG from the same few rows -----------------------------------
_BAR = {"rag": "#00796b", "non_rag": "#8d6e63"}
_OUTCOMES = ["both_correct", "rag_only_correct", "non_rag_only_correct", "both_wrong"]
_OUTCOME_FILL = ["#c5e1a5", "#00796b", "#8d6e63", "#cfd8dc"]


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    safe = html.escape(title)
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" '
        f'font-family="sans-serif" font-size="12"><title>{safe}</title>'
        f'<text x="10" y="20" font-size="15">{safe}</text>{"".join(body)}</svg>'
    )


def _label(x: float, y: float, text: object) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}">{html.escape(str(text))}</text>'


def _box(x: float, y: float, w: float, h: float, fill: str, note: str) -> str:
    return (f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{fill}">'
            f"<title>{html.escape(note)}</title></rect>")


def _bars(rows: list[tuple[str, float | None, str]], title: str, scale: float) -> str:
    """Horizontal bars: label, value (N/A draws nothing), colour."""
    body = []
    for i, (name, value, fill) in enumerate(rows):
        y = 36 + 20 * i
        shown = "N/A" if value is None else f"{value:.2%}"
        body.append(_label(10, y + 12, name))
        if value is not None:
            start = 460 + min(value, 0) * scale
            body.append(_box(start, y, abs(value) * scale, 14, fill, f"{name}: {shown}"))
        body.append(_label(840, y + 12, shown))
    return _svg(920, 50 + 20 * len(rows), title, body)


def charts(metric_rows: list[Row], pair_rows: list[Row]) -> dict[str, str]:
    matched = by_run(metric_rows, "pairwise_matched")
    runs = [(c, p) for p in fv.PROMPTS for c in fv.CONDITIONS]
    names = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"]
    overall = [
        (f"{m} · {fv.PROMPT_TITLES[p]} · {run_name(c)}", matched[c, p][m], _BAR[c]) for m in names for c, p in runs
    ]
    deltas = [(fv.PROMPT_TITLES[r["prompt"]], r["accuracy_delta"], _BAR["rag" if r["accuracy_delta"] >= 0 else "non_rag"])
              for r in pair_rows]
    stacked, cells = [], []
    for i, r in enumerate(pair_rows):
        x, y = 200.0, 40 + 34 * i
        stacked.append(_label(10, y + 15, fv.PROMPT_TITLES[r["prompt"]]))
        for name, fill in zip(_OUTCOMES, _OUTCOME_FILL):
            w = 600 * r[name] / r["n"] if r["n"] else 0
            stacked += [_box(x, y, w, 20, fill, f"{name}: {r[name]}"), _label(x + 2, y + 32, r[name])]
            x += w
    for i, (c, p) in enumerate(runs):
        x, y = 10 + 300 * (i % 2), 50 + 110 * (i // 2)
        cells.append(_label(x, y, f"{fv.PROMPT_TITLES[p]} · {run_name(c)}"))
        for j, k in enumerate(["tp", "fn", "fp", "tn"]):
            n, value = matched[c, p]["n"], matched[c, p][k]
            cx, cy = x + 130 * (j % 2), y + 8 + 40 * (j // 2)
            shade = f"rgb({255 - round(200 * value / n) if n else 255},235,255)"
            cells += [_box(cx, cy, 124, 34, shade, f"{k}: {value}"), _label(cx + 8, cy + 22, f"{k} {value}")]
    return {
        "overall_metrics": _bars(overall, "Matched metrics", 360),
        "accuracy_delta": _bars(deltas, "Accuracy difference, retrieval minus none", 2000),
        "paired_outcomes": _svg(860, 60 + 34 * len(pair_rows), "Paired outcomes", stacked),
        "confusion_matrices": _svg(620, 70 + 110 * len(fv.PROMPTS), "Confusion matrices", cells),
    }
