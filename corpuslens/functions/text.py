"""Text expressions. All are Spark columns except ``slugify``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens import fixed_values as fv

# Characters that count as blanks, and the line ends among them. Java's (?U)\s
# lacks U+001C..U+001F, hence the class for regular expressions.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
RARE_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Long s, dotless i, capital i with dot and the Kelvin sign.
FOLDED_LETTERS = "\u017f\u0131\u0130\u212a"
BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove blanks at both ends."""
    return F.trim(text, F.lit(BLANKS))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Plain byte searches; far cheaper than a regular expression."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def normalize_ws(text: Column) -> Column:
    """Collapse blanks to one space and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){BLANK}+", " "))


def truthy(text: Column) -> Column:
    """NULL for '' so that ``coalesce`` also skips empty strings."""
    return F.nullif(text, F.lit(""))


def has_text(text: Column) -> Column:
    """True where there is anything but blanks; stops at the first such character."""
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def clean_text(text: Column) -> Column:
    """Trim every line, squeeze spaces and tabs, drop blank lines.

    Rewriting passes run only on texts and lines that need them.
    """
    text = F.coalesce(text, F.lit(""))
    same_ends = F.when(
        contains_any(text, RARE_LINE_ENDS), F.translate(text, RARE_LINE_ENDS, "\n" * len(RARE_LINE_ENDS))
    ).otherwise(text)

    def clean_line(line: Column) -> Column:
        squeezed = F.when(contains_any(line, ["\t", "  "]), F.regexp_replace(line, r"[ \t]+", " ")).otherwise(line)
        return strip(squeezed)

    return F.array_join(F.array_remove(F.transform(F.split(same_ends, "\n"), clean_line), ""), "\n")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"(?U){BLANK}+"), "")


def word_windows(
    text: Column, toks: Column, target: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP
) -> Column:
    """Array of overlapping word windows; a text within ``target`` stays as it is.

    ``toks`` is the column holding ``words(text)``, computed once beforehand.
    Window starts are 0, step, 2*step, ... up to the first that reaches the end.
    """
    if overlap >= target:
        raise ValueError("overlap must be smaller than target")
    step = target - overlap
    n = F.size(toks)
    last = F.ceil((n - F.lit(target)) / F.lit(float(step))).cast("int") * step
    starts = F.sequence(F.lit(0), last, F.lit(step))
    cut = F.transform(starts, lambda s: F.array_join(F.slice(toks, s + 1, F.lit(target)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= target, F.array(text)).otherwise(cut)


def section_path(path: Column, fallback: Column) -> Column:
    """Stripped non-blank parts, or the fallback as only part."""
    parts = F.filter(F.transform(path, strip), lambda p: p != "")
    return F.when(F.size(F.coalesce(parts, F.array().cast("array<string>"))) > 0, parts).otherwise(
        F.array(fallback)
    )


def chunk_id(url: Column, path: Column, index: Column, text: Column) -> Column:
    key = F.concat_ws("\n", url, F.array_join(path, " > "), index.cast("string"), text)
    return F.concat(F.lit(fv.CHUNK_ID_PREFIX), F.substring(F.sha2(key, 256), 1, fv.CHUNK_ID_HEX))


def search_text(
    title: Column, entity: Column, topic: Column, audience: Column,
    section: Column, path: Column, text: Column,
) -> Column:
    """Metadata (title and entity twice) on the first line, then the text."""
    head = F.concat_ws(
        " ",
        truthy(title), truthy(title), truthy(entity), truthy(entity),
        truthy(F.translate(topic, "_", " ")), truthy(F.translate(audience, "_", " ")),
        truthy(section), truthy(F.array_join(path, " ")),
    )
    return F.concat(head, F.lit("\n"), text)


def raw_tokens(text: Column) -> Column:
    """Token spellings as found; lower them after exploding (see :func:`tokens`)."""
    return F.regexp_extract_all(text, F.lit(f"(?iu){fv.TOKEN_PATTERN}"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens. The text is lowered at once, which is much cheaper than token by
    token, unless it holds one of the few letters that match or become ASCII letters."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    return F.when(contains_any(text, FOLDED_LETTERS), F.transform(raw_tokens(text), F.lower)).otherwise(plain)


def run_starts(ordered: Column) -> Column:
    """Positions in a sorted array column where a new value begins."""
    return F.array_compact(
        F.transform(ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i))
    )


def run_lengths(ordered: Column, starts: Column) -> Column:
    """array<struct<token,tf>> of a sorted array column and its run starts."""
    return F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(ordered, s).alias("token"),
            (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - s).cast("long").alias("tf"),
        ),
    )


def _slug(text: str | None, max_length: int = 120) -> str | None:
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return "_".join(re.findall("[a-z0-9]+", plain.lower()))[:max_length].rstrip("_") or "unnamed"


@F.pandas_udf(StringType())
def slugify(names: pd.Series) -> pd.Series:
    """File-name form. A UDF because Spark has no Unicode decomposition; call it
    on distinct names, not on every row."""
    return names.map(_slug)


def first_match_date(text: Column) -> Column:
    """'Month D, YYYY' after 'Updated:', else after 'Reviewed:', else NULL."""
    months = "|".join(fv.MONTHS)

    def after(word: str) -> Column:
        pattern = rf"(?iu)(?U)\b{word}:[\s\x1c-\x1f]*({months})[\s\x1c-\x1f]+(\d{{1,2}}),[\s\x1c-\x1f]+(\d{{4}})"
        month, day, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
        return F.when(year != "", F.concat(month, F.lit(" "), day, F.lit(", "), year))

    return F.coalesce(after("Updated"), after("Reviewed"))


def sort_key(value: Column) -> list[Column]:
    """Digit-only IDs first by number (of any length), then the others by text."""
    digits = value.rlike("^[0-9]+$")
    number = F.regexp_replace(value, "^0+(?=.)", "")
    return [
        F.when(digits, 0).otherwise(1),
        F.when(digits, F.length(number)).otherwise(0),
        F.when(digits, number).otherwise(value),
        value,
    ]
