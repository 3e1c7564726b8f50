"""Section-aware chunks with bounded token counts.

A page is a sequence of pieces: lines (paragraphs, list items, table rows), which stay whole up
to the hard maximum; longer lines by sentences, longer sentences by runs of tokens. Two folds
over the token counts decide on the chunks:

1. Adjacent sections of the same parent are merged where one of them is short and both fit the target.
2. In each merged section, pieces are taken up to the target; the next chunk repeats the last
   whole pieces within the overlap; a rest too short for a chunk stays with the one before where it fits.

Texts stay in the JVM: only token counts, section numbers and parent keys go through Arrow, and
the ranges come back. A narrow step: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx
from corpuslens.operators.chunks import page_fields

TARGET, MOST, LEAST, OVERLAP = 550, 800, 60, 80


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?iu){fv.TOKEN_PATTERN}"))


def _piece(text: Column, glue: str) -> Column:
    return F.struct(text.alias("text"), token_count(text).alias("tokens"), F.lit(glue).alias("glue"))


def _last_glued(pieces: Column, glue: str) -> Column:
    """The pieces, the last one with another separator behind it. (A transform that asks for the size would build the array for each element.)"""
    last = F.element_at(pieces, -1)
    return F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.struct(last["text"].alias("text"), last["tokens"].alias("tokens"), F.lit(glue).alias("glue"))))


def pieces(text: Column, most: int = MOST, run: int = OVERLAP) -> Column:
    """array<struct<text, tokens, glue>> of a cleaned text; ``glue`` is what follows the piece."""
    runs = f"(?iu)(?:.*?(?:{fv.TOKEN_PATTERN})){{1,{run}}}(?:[^a-z0-9]*$)?"

    def of_sentence(sentence: Column) -> Column:
        cut = F.transform(F.regexp_extract_all(sentence, F.lit(runs), F.lit(0)), lambda r: _piece(r, ""))
        return F.when(token_count(sentence) <= most, F.array(_piece(sentence, " "))).otherwise(_last_glued(cut, " "))

    def of_line(line: Column) -> Column:
        sentences = F.flatten(F.transform(F.split(line, r"(?<=[.!?]) "), of_sentence))
        return F.when(token_count(line) <= most, F.array(_piece(line, "\n"))).otherwise(_last_glued(sentences, "\n"))

    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def merged_sections(totals: list[int], parents: list[int], target: int = TARGET, least: int = LEAST) -> list[int]:
    """First section of each merged one."""
    first: list[int] = []
    held = 0
    for i, (total, parent) in enumerate(zip(totals, parents)):
        if first and parent == parents[i - 1] and (total < least or held < least) and held + total <= target:
            held += total
        else:
            first.append(i)
            held = total
    return first


def ranges(tokens: list[int], target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (first, behind the last) of each chunk of one merged section."""
    ends = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    out: list[tuple[int, int]] = []
    start = taken = 0
    while taken < len(tokens):
        stop = max(taken + 1, int(np.searchsorted(ends, ends[start] + target, "right")) - 1)
        if ends[-1] - ends[stop] < least and ends[-1] - ends[start] <= most:
            stop = len(tokens)
        out.append((start, stop))
        taken = stop
        if taken < len(tokens):
            # As many whole pieces again as the overlap allows and the next piece leaves room for; none without
            # a token at their head, and not the whole chunk.
            room = min(overlap, most - tokens[taken])
            back = int(np.searchsorted(ends, ends[taken] - room, "left"))
            start = min(taken, max(start + 1, int(np.searchsorted(ends, ends[back], "right")) - 1))
    return out


def _planner(target: int, most: int, least: int, overlap: int):
    def plan(sections: pd.Series, tokens: pd.Series, parents: pd.Series) -> pd.Series:
        out = []
        for own, counts, parent in zip(sections, tokens, parents):
            own, counts = np.asarray(own, np.int64), np.asarray(counts, np.int64)
            totals = np.bincount(own, counts, minlength=len(parent)).astype(np.int64).tolist()
            first = [*merged_sections(totals, list(parent), target, least), len(parent)]
            found = []
            for low, high in zip(first, first[1:]):
                a, b = np.searchsorted(own, [low, high])
                found += [{"first": a + i, "behind": a + j} for i, j in ranges(counts[a:b].tolist(), target, most, least, overlap)]
            out.append(found)
        return pd.Series(out)

    return F.pandas_udf(plan, "array<struct<first:int,behind:int>>")


def chunk_pages(pages: DataFrame, target: int = TARGET, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``pages`` (see ``chunks.usable_sections``), in order of the page.

    title, cancer_type, topic, audience, url, source_file, load_order, chunk_index, section (the first),
    section_path (its own, or the common parent of several), sections (names of all), n_tokens, text, chunk_id.
    """
    if not 0 <= overlap < target <= most or least > target:
        raise ValueError("overlap < target <= most and least <= target are needed")
    # Nothing is tested on sections, pieces or their numbers: such a filter would be pushed below what makes them, and make them again.
    usable = F.filter(F.coalesce("sections", F.array()), lambda s: ~F.coalesce(s["is_boilerplate"], F.lit(False)) & tx.has_text(s["text"]))
    title = F.col("title")

    def section(s: Column) -> Column:
        name = F.coalesce(tx.truthy(s["section"]), title)
        return F.struct(name.alias("name"), tx.section_path(s["section_path"], name).alias("path"), tx.clean_text(s["text"]).alias("text"))

    parent = lambda path: F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
    rows = (
        pages.where(F.col("url") != "")
        .select(*page_fields(), usable.alias("_usable"))
        .withColumn("_sections", F.transform("_usable", section)).drop("_usable")
        .withColumn("_pieces", F.flatten(F.transform("_sections", lambda s, i: F.transform(
            pieces(s["text"], most, max(1, overlap)), lambda p: F.struct(i.alias("section"), p["text"], p["tokens"], p["glue"])))))
        .withColumn("_plan", _planner(target, most, least, overlap)(
            F.col("_pieces.section"), F.col("_pieces.tokens"), F.transform("_sections", lambda s: F.xxhash64(parent(s["path"])))))
        .select("*", F.posexplode_outer("_plan").alias("chunk_index", "_range")).where("_range is not null")
        .withColumn("_own", F.slice("_pieces", F.col("_range.first") + 1, F.col("_range.behind") - F.col("_range.first")))
    )
    covered = F.slice("_sections", F.col("_own")[0]["section"] + 1, F.element_at("_own", -1)["section"] - F.col("_own")[0]["section"] + 1)
    own = F.col("_covered")[0]
    joined = F.array_join(F.transform("_own", lambda p: F.concat(p["text"], p["glue"])), "")
    names = [c for c in rows.columns if not c.startswith("_") and c != "chunk_index"]
    out = rows.withColumn("_covered", covered).select(
        *names, "chunk_index", own["name"].alias("section"),
        F.when(F.size("_covered") == 1, own["path"]).otherwise(parent(own["path"])).alias("section_path"),
        F.transform("_covered", lambda s: s["name"]).alias("sections"),
        F.aggregate("_own", F.lit(0), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.regexp_replace(joined, r"[ \n]+$", "").alias("text"),
    )
    return out.withColumn("chunk_id", tx.chunk_id(F.col("url"), F.col("section_path"), F.col("chunk_index"), F.col("text")))
