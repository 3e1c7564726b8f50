"""Pages to retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens import schemas
from corpuslens.functions import text as tx


def page_fields() -> list[Column]:
    """Page columns, defaulted. Empty strings fall through to their default just like missing ones."""
    stem = F.regexp_extract("source_file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return [
        F.coalesce(tx.truthy(F.col("title")), tx.truthy(F.col("summary_name")), stem).alias("title"),
        tx.truthy(F.col("cancer_type")).alias("cancer_type"),
        F.coalesce(tx.truthy(F.col("topic")), F.lit("general")).alias("topic"),
        F.coalesce(tx.truthy(F.col("audience")), F.lit("unspecified")).alias("audience"),
        F.col("url"), F.col("source_file"), F.col("load_order"),
    ]


def usable_sections(pages: DataFrame) -> DataFrame:
    """One row per section worth indexing, with page fields defaulted.

    ``pages`` holds url, title, summary_name, cancer_type, topic, audience,
    source_file, load_order and sections (array of structs). A narrow step: no shuffle.
    """
    page = pages.where((F.col("url") != "") & F.col("sections").isNotNull()).select(
        *page_fields(),
        # Outer: the filters that Spark derives from a plain explode would
        # build the sections a second time.
        F.posexplode_outer("sections").alias("section_index", "s"),
    )
    return (
        # Tested on the raw text, for a filter on the cleaned one would be
        # pushed down and clean every text twice.
        page.where(~F.coalesce(F.col("s.is_boilerplate"), F.lit(False)) & tx.has_text(F.col("s.text")))
        .withColumn("text", tx.clean_text(F.col("s.text")))
        .withColumn("section", F.coalesce(tx.truthy(F.col("s.section")), F.col("title")))
        .withColumn("section_path", tx.section_path(F.col("s.section_path"), F.col("section")))
        .drop("s")
    )


def split_sections(
    sections: DataFrame, target: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    """Word windows of every section with content-hash IDs; still narrow."""
    windows = tx.word_windows(F.col("text"), F.col("_words"), target, overlap)
    cut = sections.withColumn("_words", tx.words(F.col("text"))).select(
        *[c for c in sections.columns if c != "text"],
        F.posexplode(windows).alias("chunk_index", "text"),
    )
    return cut.withColumn(
        "chunk_id", tx.chunk_id(F.col("url"), F.col("section_path"), F.col("chunk_index"), F.col("text"))
    )


def load_position() -> Column:
    return F.struct("load_order", "section_index", "chunk_index")


def keep_first(chunks: DataFrame) -> DataFrame:
    """First chunk in load order of each chunk_id.

    The rank filter is pruned on the map side (window group limit), so a chunk
    copied a billion times sends one row per task. The output stays hash-
    partitioned by chunk_id, which the index build reuses.
    """
    w = Window.partitionBy("chunk_id").orderBy("load_order", "section_index", "chunk_index")
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chunk_pages(
    pages: DataFrame, target: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    return keep_first(split_sections(usable_sections(pages), target, overlap)).select(
        *schemas.CHUNK_FIELDS, "load_order", "section_index", "chunk_index"
    )


def with_search_text(chunks: DataFrame) -> DataFrame:
    c = F.col
    return chunks.withColumn(
        "search_text",
        tx.search_text(
            c("title"), c("cancer_type"), c("topic"), c("audience"), c("section"), c("section_path"), c("text")
        ),
    )


def first_section(pages: DataFrame) -> DataFrame:
    """First non-boilerplate section with text of every page."""
    good = F.filter(
        "sections",
        lambda s: ~F.coalesce(s["is_boilerplate"], F.lit(False)) & tx.has_text(s["text"]),
    )
    first = pages.select("url", F.get(good, F.lit(0)).alias("s"))
    return first.select("url", "s.section", "s.section_path", "s.text")
