"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3, words padded
with a blank) of a language, in order. A document's own list is compared with each
profile by the sum of out-of-place distances; an n-gram that a profile lacks costs
the length of a profile. The nearest language wins, ties by name.

Profiles are learned from a bounded sample of labelled rows per language; a
document's list counts its whole text.

Defined results: null text and text without a letter are ``und`` with score 0, as is
every row if nothing was labelled; repeated rows give equal rows; an empty table
gives an empty result; only doc_id, text and (for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import held_out, text_of

PROFILE = 400
SAMPLE_ROWS = 2000
UNKNOWN = "und"
_BLANK = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """Lower-case form of every letter by code point, a blank for everything else."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ranked_grams(text: str, most: int | None = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of ``text`` as numbers (21 bits a character), most frequent first, and their counts."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.int64)
    blank = points == _BLANK
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = points != _BLANK
    pairs = points[:-1] << 21 | points[1:]
    triples = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[letter[1:-1]]
    grams = np.concatenate((points[letter], pairs, triples))
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    counts = np.diff(np.append(first, len(grams)))
    order = np.argsort(-counts, kind="stable")[:most]
    return grams[first][order], counts[order]


@dataclass
class Profiles:
    """``ranks[i, j]``: place of gram j in the profile of language i, ``length`` where it lacks it."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    length: int

    def nearest(self, text: str) -> tuple[str, float]:
        own, _ = ranked_grams(text, self.length)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = self.ranks[:, at[known]]
        away = np.where(places < self.length, np.abs(places - np.flatnonzero(known)), self.length).sum(1)
        away += self.length * int((~known).sum())
        best = int(away.argmin())
        return self.languages[best], float(1 - away[best] / (self.length * len(own)))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, length: int = PROFILE) -> Profiles:
    """Profiles from about ``rows`` labelled documents of each language, chosen by hash."""
    labelled = docs.where("lang is not null").where(~held_out(F.col("doc_id"))).select(
        "lang", text_of(F.col("text")).alias("text"), F.xxhash64("doc_id", "text").alias("at")
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), length)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / n) * 1_000_000)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                parts = [ranked_grams(t, None) for t in group["text"]]
                grams, counts = (np.concatenate(x) for x in zip(*parts))
                grams, at = np.unique(grams, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "uses": np.bincount(at, counts, len(grams)).astype(np.int64)})

    uses = (
        labelled.where(F.pmod("at", F.lit(1_000_000)) < share[F.col("lang")]).select("lang", "text")
        .mapInPandas(count, "lang string, gram long, uses long").groupBy("lang", "gram").agg(F.sum("uses").alias("uses"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("uses"), "gram")) - 1
    top = uses.withColumn("place", place).where(F.col("place") < length).select("lang", "gram", "place").toPandas()
    languages, grams = sorted(top["lang"].unique()), np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(grams)), length, np.int64)
    ranks[np.searchsorted(languages, top["lang"]), np.searchsorted(grams, top["gram"])] = top["place"]
    return Profiles(languages, grams, ranks, length)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.nearest(t) for t in texts], columns=["lang_pred", "score"])

    found = F.pandas_udf(nearest, "lang_pred string, score double")(text_of(F.col("text")))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )
