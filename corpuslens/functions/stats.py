"""Classification and paired statistics as columns; undefined means NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def confusion(answer: Column, truth: Column, when: Column | None = None) -> dict[str, Column]:
    """Confusion counts as aggregates, optionally over the rows where ``when`` holds."""
    keep = F.lit(True) if when is None else when
    return {
        "n": F.count_if(keep & answer.isNotNull() & truth.isNotNull()),
        "tp": F.count_if(keep & answer & truth),
        "tn": F.count_if(keep & ~answer & ~truth),
        "fp": F.count_if(keep & answer & ~truth),
        "fn": F.count_if(keep & ~answer & truth),
    }


def metric_columns() -> dict[str, Column]:
    """Metrics from columns n, tp, tn, fp, fn."""
    n, tp, tn, fp, fn = (F.col(c) for c in ("n", "tp", "tn", "fp", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    low, high = wilson(tp + tn, n)
    return {
        "accuracy": ratio(tp + tn, n),
        "accuracy_ci_low": low,
        "accuracy_ci_high": high,
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
    }


def agreement_columns() -> dict[str, Column]:
    """Negative predictive value and Matthews correlation from columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {"negative_predictive_value": ratio(tn, tn + fn), "matthews": F.try_divide(tp * tn - fp * fn, spread)}


def wilson(successes: Column, total: Column, z: float = fv.WILSON_Z) -> tuple[Column, Column]:
    n = F.nullif(total, F.lit(0)).cast("double")
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return centre - half, centre + half


def _stirling_error(n: Column) -> Column:
    """ln n! minus Stirling's formula: exact table below 16, series above."""
    exact = [0.0] + [
        math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)
    ]
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n
    return F.when(n < 16, F.get(F.array(*[F.lit(v) for v in exact]), n.cast("int"))).otherwise(series)


def mcnemar_exact_p(first_only: Column, second_only: Column) -> Column:
    """Two-sided exact McNemar p-value: min(1, 2 * P[Binomial(d, 1/2) <= m]).

    The tail is summed downward from its largest term, which is found with the
    saddle-point form of the binomial, so counts of any size stay accurate and
    no factorial overflows. Terms more than 7*sqrt(d) below m are smaller than
    double precision by tens of orders of magnitude.
    """
    d = (first_only + second_only).cast("double")
    m = F.least(first_only, second_only).cast("double")
    rest = d - m
    deviance = m * F.ln(2 * m / d) + rest * F.ln(2 * rest / d)
    top = F.when(m == 0, F.exp(-d * math.log(2))).otherwise(
        F.sqrt(d / (2 * math.pi * m * rest))
        * F.exp(_stirling_error(d) - _stirling_error(m) - _stirling_error(rest) - deviance)
    )
    terms = F.least(m, F.ceil(7 * F.sqrt(d)).cast("double") + 64).cast("long")
    # i runs m, m-1, ...: each term is the one before times i / (d - i + 1).
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        i = m - j + 1
        term = acc["term"] * i / (d - i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )
    tail = top * F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(d == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
