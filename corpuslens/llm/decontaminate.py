"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a test item if maximal common token runs of five
or more words ("tiles", in any order, not overlapping on either side) cover 0.8
or more of the item: reordered passages are caught as well.

1. Seeds. The five-word runs of all items set bits of a bitmap of fixed size, the
   only thing that is broadcast. One pass over the documents keeps those runs that
   hit it, and the texts they lie in.
2. Join. Kept runs meet the items' runs by hash; an item that reaches the cover
   has at least cover / 5 of its runs in the document, so its runs most common in
   documents and benchmark, up to one fewer than that, need not be joined: a phrase that many
   documents share is joined only for items that have nothing else.
3. Tiling. For each (document, item), Karp-Rabin search for the longest common
   runs of unmarked tokens; they are marked, and shorter ones searched.

Tokens are lower-cased runs of letters and digits; every other character, of any script, separates them, and each
letter of a script without blanks between words is a token of its own. So marks, blanks of any kind and case do not hide a passage.

Defined results: null and empty texts contain nothing; an item with fewer than
five words matches documents of just these words, and one without a word never; of a very long text
every run counts; repeated rows of either side give one row per pair of
different (id, text); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import text_key, text_of, without
from corpuslens.llm.wordscan import mixed, scan, slices
from corpuslens.session import store

SHORTEST = 5
COVER = 0.8
FIRST_SEARCH = 20
BITMAP_BITS = 25
_TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_PRIME = (1 << 61) - 1
# Code point ranges of scripts written without blanks between words (Thai to Lao, Myanmar, Khmer, kana, Han, and their extensions).
_NO_BLANKS = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
]


class _Spelling(dict):
    """What stands for a character: blanks for marks, the character apart in scripts without blanks, nothing for what is not seen."""

    def __missing__(self, c: str) -> str:
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            out = f" {c} " if any(low <= ord(c) <= high for low, high in _NO_BLANKS) else c
        else:
            out = c if kind[0] == "M" else "" if kind == "Cf" else " "
        self[c] = out
        return out


_SPELLED = _Spelling()


def plain(text: str) -> str:
    """The text in lower case, other characters than letters and digits as blanks where they are not ASCII."""
    text = text.lower()
    return text if text.isascii() else _OTHER.sub(lambda run: "".join(map(_SPELLED.__getitem__, run[0])), text)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(plain(text))


def greedy_tiles(first: list, second: list, shortest: int = SHORTEST, search: int = FIRST_SEARCH) -> list[tuple[int, int, int]]:
    """Tiles (place in first, place in second, length) of two token lists.

    Running Karp-Rabin greedy string tiling: all common runs of the search
    length or more are found by rolling hash and verified, the longest are marked
    first; then the search length falls.
    """
    ids = {t: i + 1 for i, t in enumerate(dict.fromkeys(second))}
    a, b = [ids.get(t, 0) for t in first], [ids[t] for t in second]
    marked_a, marked_b = [x == 0 for x in a], [False] * len(b)
    tiles: list[tuple[int, int, int]] = []
    length = max(shortest, min(search, len(b)))
    while True:
        found = _common_runs(a, b, marked_a, marked_b, length)
        longest = max(found, default=0)
        if longest > 2 * length:
            length = longest
            continue
        for size in sorted(found, reverse=True):
            for i, j in found[size]:
                if not any(marked_a[i : i + size]) and not any(marked_b[j : j + size]):
                    marked_a[i : i + size] = marked_b[j : j + size] = [True] * size
                    tiles.append((i, j, size))
        # Runs cut by a longer tile may still hold runs of this length.
        if any(s > length for s in found) and _common_runs(a, b, marked_a, marked_b, length):
            continue
        if length <= shortest:
            return sorted(tiles)
        length = max(shortest, length // 2 if length > 2 * shortest else length - 1)


def _hashes(x: list[int], marked: list[bool], k: int) -> Iterator[tuple[int, int]]:
    """(place, rolling hash) of the runs of k unmarked tokens."""
    lead = pow(1_000_003, k, _PRIME)
    h = n = 0
    for i, t in enumerate(x):
        if marked[i]:
            h = n = 0
            continue
        h, n = (h * 1_000_003 + t) % _PRIME, n + 1
        if n > k:
            h = (h - x[i - k] * lead) % _PRIME
        if n >= k:
            yield i - k + 1, h


def _common_runs(a: list, b: list, marked_a: list, marked_b: list, k: int) -> dict[int, list[tuple[int, int]]]:
    """Maximal common unmarked runs of k or more tokens, as places by length."""
    places: dict[int, list[int]] = {}
    for j, h in _hashes(b, marked_b, k):
        places.setdefault(h, []).append(j)
    found: dict[int, list[tuple[int, int]]] = {}
    for i, h in _hashes(a, marked_a, k):
        for j in places.get(h, ()):
            if i and j and a[i - 1] == b[j - 1] and not marked_a[i - 1] and not marked_b[j - 1]:
                continue  # part of a run that began before
            size = 0
            while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size] and not marked_a[i + size] and not marked_b[j + size]:
                size += 1
            if size >= k:
                found.setdefault(size, []).append((i, j))
    return found


def islands(doc: list[str], item: list[str], shortest: int = SHORTEST) -> list:
    """The parts of ``doc`` that runs shared with ``item`` cover, None between them: all that tiles can lie in."""
    runs = {tuple(item[j : j + shortest]) for j in range(len(item) - shortest + 1)}
    begins = {r[0] for r in runs}
    out: list = []
    upto = -1
    for i in range(len(doc) - shortest + 1):
        if doc[i] in begins and tuple(doc[i : i + shortest]) in runs:
            if i > upto:
                out.append(None)
                out += doc[i : i + shortest]
            else:
                out += doc[upto : i + shortest]
            upto = i + shortest
    return out


def _runs(texts: list[str], shortest: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``shortest`` tokens of each text; of the whole of a shorter one, marked by its length."""
    words = scan([plain(t) for t in texts])
    grams, _ = words.grams(shortest)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if high - low >= shortest:
            yield grams[low : high - shortest + 1]
        elif high > low:
            whole = np.uint64(high - low)
            for h in words.hash[low:high]:
                whole = mixed(np.array([whole + h]))[0]
            yield np.array([whole])
        else:
            yield grams[:0]


def _item_seeds(items: DataFrame, shortest: int) -> DataFrame:
    """item_key, n_words, place, seed: all runs of each item."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            runs = list(_runs(rows["item_text"].tolist(), shortest))
            sizes = [len(r) for r in runs]
            yield pd.DataFrame({
                "item_key": np.repeat(rows["item_key"].to_numpy(), sizes), "n_words": np.repeat([n + shortest - 1 for n in sizes], sizes),
                "place": np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64),
                "seed": np.concatenate(runs).view(np.int64) if runs else np.zeros(0, np.int64),
            })

    return items.mapInPandas(seeds, "item_key long, n_words long, place long, seed long")


def _joined_seeds(found: DataFrame, held: DataFrame, shortest: int, cover: float) -> DataFrame:
    """item_key, seed: the runs that have to be joined. ``held``: seed, uses (documents that may hold it)."""
    common = found.groupBy("seed").agg(F.count(F.lit(1)).alias("own_uses"))
    uses = F.coalesce("uses", F.lit(0)) + F.col("own_uses")
    ranked = (
        found.join(common, "seed").join(held, "seed", "left").groupBy("item_key", "n_words")
        .agg(F.sort_array(F.collect_list(F.struct(uses.alias("uses"), "seed", "place"))).alias("runs"))
    )
    spare = F.greatest(F.lit(0), F.ceil(F.col("n_words") * cover / shortest) - 1)
    return ranked.select(
        "item_key", F.explode(F.slice("runs", F.lit(1), F.greatest(F.size("runs") - spare.cast("int"), F.lit(1)))).alias("run")
    ).select("item_key", "run.seed").distinct()


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit per seed; at most 2 ** bits / 64 numbers reach the driver, whatever the number of seeds."""
    words = (
        seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("at"))
        .select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )
    out = np.zeros(1 << bits - 6, np.int64)
    for w in words:
        out[w["word"]] = w["bits"]
    return out.view(np.uint8)


def contaminated(
    docs: DataFrame, items: DataFrame, cover: float = COVER, shortest: int = SHORTEST, bitmap_bits: int = BITMAP_BITS
) -> DataFrame:
    """Pairs above the cover: doc_id, text_key, item_id, n_item_words, covered_words, n_tiles, longest_tile, coverage, tiles.

    ``docs`` (doc_id, text), ``items`` (item_id, text); ``tiles`` lists (word in the item, length).
    """
    spark = docs.sparkSession
    items = store(
        items.select("item_id", text_of(F.col("text")).alias("item_text")).distinct()
        .withColumn("item_key", F.xxhash64("item_id", "item_text")), "items",
    )
    found = store(_item_seeds(items.select("item_key", "item_text"), shortest), "item-runs")
    shared = spark.sparkContext.broadcast(_bitmap(found, bitmap_bits))
    shift = np.uint64(64 - bitmap_bits)

    def hits(texts: pd.Series) -> pd.Series:
        out = []
        for part in slices(texts.tolist()):
            for runs in _runs(part, shortest):
                at = (runs >> shift).astype(np.int64)
                hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                out.append(np.unique(runs[hit]).view(np.int64) if hit.any() else None)
        return pd.Series(out, dtype=object)

    hit_udf = F.pandas_udf(hits, T.ArrayType(T.LongType()))
    some = store(
        docs.select("doc_id", text_of(F.col("text")).alias("text"))
        .withColumn("seeds", hit_udf("text")).where("seeds is not null")
        .withColumn("text_key", text_key()), "seed-hits",
    )
    hit = some.select("doc_id", "text_key", F.explode("seeds").alias("seed"))
    # Counted on the map side; the items' runs only.
    held = hit.groupBy("seed").agg(F.count(F.lit(1)).alias("uses"))
    seeds = store(_joined_seeds(found, held, shortest, cover), "item-seeds")
    pairs = (
        hit.join(seeds, "seed")
        .select("doc_id", "text_key", "item_key").distinct()
    )
    texts = (
        pairs.join(some.select(F.col("doc_id").alias("same_id"), "text_key", "text"), "text_key")
        .where(F.col("doc_id").eqNullSafe(F.col("same_id"))).drop("same_id")
        .dropDuplicates(["doc_id", "text_key", "item_key"]).join(items, "item_key")
    )
    tile = F.pandas_udf(
        lambda text, item: _tiled(text, item, shortest),
        T.ArrayType(T.ArrayType(T.IntegerType())),
    )
    tiled = texts.select("doc_id", "text_key", "item_id", tile("text", "item_text").alias("tiles"))
    covered = F.aggregate("tiles", F.lit(0), lambda s, t: s + F.get(t, F.lit(1)))
    n_words = F.aggregate("tiles", F.lit(0), lambda s, t: F.greatest(s, F.get(t, F.lit(2))))
    return (
        tiled.where(F.size("tiles") > 0)
        .select(
            "doc_id", "text_key", "item_id", n_words.cast("long").alias("n_item_words"), covered.cast("long").alias("covered_words"),
            F.size("tiles").cast("long").alias("n_tiles"),
            F.array_max(F.transform("tiles", lambda t: F.get(t, F.lit(1)))).cast("long").alias("longest_tile"),
            F.transform("tiles", lambda t: F.struct(F.get(t, F.lit(0)).alias("place"), F.get(t, F.lit(1)).alias("length"))).alias("tiles"),
        )
        .withColumn("coverage", F.col("covered_words") / F.col("n_item_words"))
        .where(F.col("coverage") >= cover)
    )


def _tiled(texts: pd.Series, item_texts: pd.Series, shortest: int) -> pd.Series:
    """Tiles of each pair as (word in the item, length, words of the item)."""
    out = []
    for text, item in zip(texts, item_texts):
        b = tokens(item)
        a = tokens(text)
        if len(b) < shortest:
            tiles = [(0, 0, len(b))] if a == b else []
        else:
            tiles = greedy_tiles(islands(a, b, shortest), b, shortest)
        out.append([[j, size, len(b)] for _, j, size in sorted(tiles, key=lambda t: t[1])])
    return pd.Series(out, dtype=object)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those a test item's passage is found in; all columns."""
    return without(docs, contaminated(docs, items, **options))
