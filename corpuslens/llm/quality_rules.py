"""Quality rules: fixed base rules and a decision list learned from labelled statistics.

1. ``statistics``: counts over each whole text, one Arrow pass.
2. ``learn``: sequential covering. A rule, a conjunction of thresholds on shares of the
   counts, is grown on two thirds of the sample by information gain, conditions are pruned
   from its end on the last third, and the rows it covers are taken away before the next
   one is grown. A rule is accepted while it is right on ``PRECISION`` of both parts.
3. ``verdict``: the list as an ordered Spark conditional expression over the counts, so
   that it can be read, stored as text, and applied without Python.

Words are runs of characters other than ASCII white space; windows of three are compared by
64-bit hashes of their words.

Defined results: null text counts as empty: all counts 0, no word, so the base rules fail it;
a share of nothing is 0; without labels of both classes the list is empty and only the
base rules decide; labels that are null are ignored, and so are labels of the held-out
fold; repeated rows give equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out, text_of
from corpuslens.llm.wordscan import scan, slices

LEAST_WORDS = 50
MOST_REPEATED = 50  # words in repeated windows of 100
WINDOW = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"

SAMPLE_ROWS = 6000
PRECISION = 0.95
LEAST_COVER = 5
MOST_CONDITIONS = 4
MOST_RULES = 16
MOST_THRESHOLDS = 64

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_different", "n_same_as_before", "n_upper", "n_digits", "n_ends", "longest_word",
)
# Names of the learned conditions -> (count, count that it is a share of).
SHARES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "letters_per_word": ("word_chars", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "different_words": ("n_different", "n_words"),
    "same_as_before": ("n_same_as_before", "n_words"),
    "upper_letters": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "ends_per_word": ("n_ends", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "blanks": ("n_chars", "word_chars"),
    "longest_word": ("longest_word", None),
}

_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_END = np.isin(np.arange(256), list(b".!?"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _runs(hashes: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    if len(hashes) < WINDOW:
        return 0
    windows = hashes[: len(hashes) - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - WINDOW + 1 + i]
    _, code, count = np.unique(windows, return_inverse=True, return_counts=True)
    inside = np.zeros(len(hashes) + 1, np.int64)
    often = np.flatnonzero(count[code] > 1)
    np.add.at(inside, often, 1)
    np.add.at(inside, often + WINDOW, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def counts_of(texts: list[str]) -> Iterator[tuple[int, ...]]:
    """``COUNTS`` of each text."""
    words = scan(texts, ~_BLANK)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])))
    for i, t in enumerate(texts):
        low, high = words.first[i], words.first[i + 1]
        own = words.buffer[bounds[i] : bounds[i + 1] - 1]
        letters = _FIRST_BYTE[own] & ~_BLANK[own]
        hashes = words.hash[low:high]
        seen: set[str] = set()
        lines = duplicates = 0
        for line in t.split("\n"):
            if line.strip(BLANKS):
                lines += 1
                duplicates += line in seen
                seen.add(line)
        starts, ends = words.start[low:high] - bounds[i], words.end[low:high] - bounds[i]
        before = np.concatenate(([0], np.cumsum(letters)))
        yield (
            int(high - low), int(letters.sum()), int(_SYMBOL[own].sum()), duplicates, _runs(hashes),
            len(t), lines, len(np.unique(hashes)), int((hashes[1:] == hashes[:-1]).sum()),
            int(_UPPER[own].sum()), int(_DIGIT[own].sum()), int(_END[own[ends - 1]].sum()) if high > low else 0,
            int((before[ends] - before[starts]).max()) if high > low else 0,
        )


def _counted(texts: pd.Series) -> pd.DataFrame:
    rows = [row for part in slices(texts.tolist()) for row in counts_of(part)]
    return pd.DataFrame(rows, columns=list(COUNTS), dtype="int64")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of each row of ``docs``."""
    counted = F.pandas_udf(_counted, ", ".join(f"{c} long" for c in COUNTS))
    return docs.select("doc_id", counted(text_of(F.col("text"))).alias("c")).select("doc_id", "c.*")


def share(name: str) -> Column:
    count, of = SHARES[name]
    whole = F.col(count).cast("double")
    return whole if of is None else F.when(F.col(of) > 0, whole / F.col(of)).otherwise(0.0)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, shares: pd.DataFrame) -> np.ndarray:
        values = shares[self.name].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        return share(self.name) > self.threshold if self.above else share(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, shares: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(shares), bool)
    for condition in rule:
        out &= condition.holds(shares)
    return out


def _thresholds(values: np.ndarray) -> np.ndarray:
    """Middles between neighbouring different values, evenly thinned."""
    different = np.unique(values)
    middles = (different[1:] + different[:-1]) / 2
    return middles[:: max(1, -(-len(middles) // MOST_THRESHOLDS))]


def _gain(bad: np.ndarray, good: np.ndarray, bad_before: int, good_before: int) -> np.ndarray:
    """Information gained on each bad row that stays covered."""
    before = log2(bad_before / (bad_before + good_before))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(bad > 0, bad * (np.log2(bad / (bad + good)) - before), -np.inf)


def grow(shares: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Conditions added one by one, the one of greatest gain each time, until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(shares), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        n_bad, n_good = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, chosen = 1e-9, None
        for name in SHARES:
            values = shares[name].to_numpy()
            cuts = _thresholds(values[inside])
            if not len(cuts):
                continue
            bad_values, good_values = np.sort(values[inside & bad]), np.sort(values[inside & ~bad])
            bad_below = np.searchsorted(bad_values, cuts, "right")
            good_below = np.searchsorted(good_values, cuts, "right")
            for above in (True, False):
                gains = _gain(n_bad - bad_below, n_good - good_below, n_bad, n_good) if above else _gain(bad_below, good_below, n_bad, n_good)
                at = int(gains.argmax())
                if gains[at] > best:
                    best, chosen = float(gains[at]), Condition(name, above, float(cuts[at]))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(shares)
    return tuple(rule)


def prune(rule: Rule, shares: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The shortest start of the rule with the best balance of bad and good rows covered."""
    best, kept = -np.inf, rule
    for n in range(1, len(rule) + 1):
        inside = covered(rule[:n], shares)
        hits, misses = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (hits - misses) / (hits + misses) if hits + misses else -1.0
        if worth > best:
            best, kept = worth, rule[:n]
    return kept


def _right(rule: Rule, shares: pd.DataFrame, bad: np.ndarray) -> float:
    inside = covered(rule, shares)
    return float(bad[inside].mean()) if inside.any() else 0.0


def cover(shares: pd.DataFrame, bad: np.ndarray, precision: float = PRECISION, seed: int = 5) -> list[Rule]:
    """The decision list: rules of bad rows, in the order in which they were learned."""
    part = np.random.default_rng(seed).permutation(len(shares)) % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(shares), bool)
    while len(rules) < MOST_RULES and (left & ~part & bad).sum() >= LEAST_COVER:
        growing, pruning = left & ~part, left & part
        rule = prune(grow(shares[growing], bad[growing]), shares[pruning], bad[pruning])
        inside = covered(rule, shares) & left
        if (
            not rule or (inside & bad).sum() < LEAST_COVER
            or _right(rule, shares[growing], bad[growing]) < precision or _right(rule, shares[pruning], bad[pruning]) < precision
        ):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def sample_of(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """``SHARES`` and quality of at most ``rows`` labelled rows of the learning folds, chosen by id hash."""
    labelled = labels.where("quality is not null").where(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")
    )
    part = min(1.0, rows * 0.95 / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < part * 1_000_000).limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    counted = F.pandas_udf(_counted, ", ".join(f"{c} long" for c in COUNTS))
    rows_of = joined.select("label_id", "quality", counted(text_of(F.col("text"))).alias("c")).select("label_id", "quality", "c.*")
    names = list(SHARES)
    return (
        # Rows that the base rules drop anyway teach nothing.
        rows_of.where(~base_failed()).select("label_id", "quality", *[share(n).alias(n) for n in names]).limit(rows).toPandas()
        .sort_values(["label_id", "quality", *names], ignore_index=True)
    )


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> list[Rule]:
    """Rules for documents of quality 0."""
    sample = sample_of(docs, labels, rows)
    return cover(sample[list(SHARES)], (sample["quality"] <= 0).to_numpy(), precision)


def fired(rules: list[Rule]) -> Column:
    """Number, from 1, of the first rule that holds; 0 if none does."""
    out = None
    for i, rule in enumerate(rules):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        out = F.when(holds, i + 1) if out is None else out.when(holds, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def written(rules: list[Rule]) -> list[str]:
    """Each rule as text."""
    return [" and ".join(map(str, rule)) for rule in rules]


def judge(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept."""
    rules = learn(docs, labels, rows, precision)
    return (
        statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", fired(rules))
        .select("doc_id", *COUNTS[:5], "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """``docs`` without the rows that a base rule or the list rejects; all columns."""
    rules = learn(docs, labels, rows, precision)
    counted = F.pandas_udf(_counted, ", ".join(f"{c} long" for c in COUNTS))
    own = docs.select(F.struct(*docs.columns).alias("row"), counted(text_of(F.col("text"))).alias("c")).select("row", "c.*")
    return own.where(~base_failed() & (fired(rules) == 0)).select("row.*")
