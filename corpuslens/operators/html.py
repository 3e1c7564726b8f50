"""Raw HTML pages to page records with a section hierarchy.

One Arrow-batched Python step reads the markup; headings, sections, flags and
hashes are column expressions over the block array of the same row. Nothing
here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx
from corpuslens.functions import web
from corpuslens.functions.html_blocks import scan_page
from corpuslens.session import small_batches

_LINK = StructType().add("href", "string").add("label", "string")
_BLOCK = StructType().add("tag", "string").add("cells", ArrayType(StringType()))
SCAN = (
    StructType()
    .add("title", "string")
    .add("full_text", "string")
    .add("blocks", ArrayType(_BLOCK))
    .add("links", ArrayType(_LINK))
    .add("error", "string")
)


# Characters of markup whose scans a worker holds at once, unless one page alone has more.
SCAN_CHARS = 1 << 20


@F.pandas_udf(SCAN)
def scan_html(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A page that fails keeps its row, with the reason in ``error``.

    Scans leave the worker every ``SCAN_CHARS`` characters, whatever the size of the batch.
    """
    names = ["title", "full_text", "blocks", "links", "error"]
    for html in batches:
        rows, held = [], 0
        for page in html:
            try:
                found = scan_page(page)
                rows.append([found[n] for n in names[:-1]] + [None])
            except Exception as problem:
                rows.append([None, None, None, None, f"{type(problem).__name__}: {problem}"])
            held += len(page or "")
            if held >= SCAN_CHARS:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        if rows or not len(html):
            yield pd.DataFrame(rows, columns=names)


def scan_pages(pages: DataFrame) -> DataFrame:
    """Adds ``scan``; all other columns stay."""
    small_batches(pages.sparkSession)
    return pages.withColumn("scan", scan_html("html"))


def block_texts(blocks: Column) -> Column:
    """array<struct<level,text>>: level 1-6 for headings, else 0."""

    def shape(b: Column) -> Column:
        tag = b["tag"]
        cells = F.filter(F.transform(b["cells"], tx.normalize_ws), lambda c: c != "")
        body = F.array_join(cells, " | ")
        level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
        text = F.when((tag == "li") & (body != ""), F.concat(F.lit("- "), body)).otherwise(body)
        return F.struct(level.alias("level"), text.alias("text"))

    return F.transform(blocks, shape)


def heading_paths(headings: Column) -> Column:
    """Path of open headings after each heading; element 0 is the empty path.

    A heading of level L keeps at most L-1 parts of the path before it (by
    count, not by level). An empty heading leaves the path as it is.
    """
    empty = F.array().cast("array<string>")

    def step(paths: Column, h: Column) -> Column:
        path = F.element_at(paths, -1)
        grown = F.concat(F.slice(path, F.lit(1), h["level"] - 1), F.array(h["text"]))
        return F.concat(paths, F.array(F.when(h["text"] == "", path).otherwise(grown)))

    return F.aggregate(headings, F.array(empty), step)


def with_sections(pages: DataFrame) -> DataFrame:
    """Adds ``sections`` from ``scan.blocks``.

    Built in named steps, so that no array is computed again for each element
    of another one. Blank blocks go first; a block equal to the one right
    before it in the same section goes next; then every section is a slice.
    """
    b = F.col("_b")
    end = F.size(b)
    staged = (
        pages.withColumn("_b", F.filter(block_texts(F.col("scan.blocks")), lambda x: (x["level"] > 0) | (x["text"] != "")))
        .withColumn(
            "_b",
            F.filter(
                b,
                lambda x, i: (i == 0) | (x["level"] > 0) | (F.get(b, i - 1)["level"] > 0)
                | (F.get(b, i - 1)["text"] != x["text"]),
            ),
        )
        .withColumn(
            "_h",
            F.filter(
                F.transform(b, lambda x, i: F.struct(x["level"].alias("level"), x["text"].alias("text"), i.alias("i"))),
                lambda x: x["level"] > 0,
            ),
        )
        .withColumn("_paths", heading_paths(F.col("_h")))
    )
    at = F.transform("_h", lambda h: h["i"])
    spans = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), at).alias("start"), F.concat(at, F.array(end)).alias("stop"),
        F.col("_paths").alias("path"),
    )

    def section(s: Column) -> Column:
        n = s["stop"] - s["start"] - 1
        texts = F.transform(F.slice(b, s["start"] + 2, n), lambda x: x["text"])
        return F.struct(
            F.coalesce(F.get(s["path"], F.size(s["path"]) - 1), F.lit(fv.UNNAMED_SECTION)).alias("section"),
            s["path"].alias("section_path"),
            web.is_boilerplate(s["path"]).alias("is_boilerplate"),
            n.alias("block_count"),
            F.array_join(texts, "\n").alias("text"),
        )

    return (
        staged.withColumn("_spans", F.filter(spans, lambda s: s["stop"] - s["start"] > 1))
        .withColumn("sections", F.transform("_spans", section))
        .drop("_b", "_h", "_paths", "_spans")
    )


def parse_pages(scanned: DataFrame) -> DataFrame:
    """Page records from rows with url, collections, discovered_from,
    index_link_labels and ``scan``; failed pages are left to :func:`failures`."""
    good = scanned.where(F.col("scan.error").isNull())
    titled = good.withColumn(
        "title", F.coalesce(tx.normalize_ws(F.col("scan.title")), F.lit(""))
    ).withColumn("title", F.when(F.col("scan.title").isNull(), fv.UNTITLED_PAGE).otherwise(F.col("title")))
    titled = titled.withColumn("summary_name", web.strip_title_suffix(F.col("title")))
    shaped = with_sections(titled)
    texts = F.transform("sections", lambda s: s["text"])
    return shaped.select(
        F.lit(fv.PAGE_SOURCE).alias("source"),
        F.lit(fv.PAGE_SOURCE_DOMAIN).alias("source_domain"),
        F.lit(fv.PAGE_COLLECTION).alias("collection"),
        "collections",
        web.topic(F.col("collections")).alias("topic"),
        web.audience(F.col("url"), F.col("title")).alias("audience"),
        F.lit(fv.PAGE_LANGUAGE).alias("language"),
        web.entity_name(F.col("summary_name"), F.col("collections")).alias("cancer_type"),
        "title", "summary_name", "url", "discovered_from", "index_link_labels",
        tx.first_match_date(tx.normalize_ws(F.col("scan.full_text"))).alias("last_updated"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("retrieved_at"),
        F.sha2(F.array_join(texts, "\n\n"), 256).alias("content_sha256"),
        F.size("sections").alias("section_count"),
        "sections",
    )


def failures(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("scan.error").isNotNull()).select(
        "url", "collections", F.col("scan.error").alias("reason")
    )
