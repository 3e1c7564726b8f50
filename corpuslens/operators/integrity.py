"""Data-integrity report: what manifest, files and pages disagree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx

REQUIRED = ("url", "title", "topic", "audience", "content_sha256")
# Kinds that do not block indexing.
WARNINGS = ("unlisted_file", "empty_page")


def _kinds(**found: Column) -> Column:
    """The names of all that hold."""
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in found.items()]))


def file_faults(manifest: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, subject (a path), detail of the full outer join of manifest and files (path, size, digest) and the files of ``pages``.

    Each side is first brought to a row a path, on the map side, so a path listed often is no hot key.
    """
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("path").agg(
            F.count("*").alias(f"{name}_rows"), F.max("size").alias(f"{name}_size"), F.max("digest").alias(f"{name}_digest"))

    held = pages.groupBy("path").agg(F.count("*").alias("pages"))
    met = one(manifest, "listed").join(one(files, "there"), "path", "full_outer").join(held, "path", "full_outer")
    listed, there, filled = (F.col(c).isNotNull() for c in ("listed_rows", "there_rows", "pages"))
    kinds = _kinds(
        repeated_path=F.col("listed_rows") > 1, missing_file=listed & ~there, unlisted_file=there & ~listed,
        other_size=F.col("listed_size") != F.col("there_size"), other_digest=F.col("listed_digest") != F.col("there_digest"),
        no_pages=there & ~filled, pages_without_file=filled & ~there,
    )
    return met.select(F.explode(kinds).alias("kind"), F.col("path").alias("subject"), F.lit(None).cast("string").alias("detail"))


def page_faults(pages: DataFrame) -> DataFrame:
    """kind, subject (URL, or the path where it has none), detail of ``pages`` (path, the required fields, sections)."""
    name = F.coalesce(tx.truthy(F.col("url")), F.col("path"))
    blank = [F.when(~tx.has_text(F.col(c)), c) for c in REQUIRED]
    missing = pages.select(name.alias("subject"), F.explode(F.array_compact(F.array(*blank))).alias("detail")).select(
        F.lit("missing_field").alias("kind"), "subject", "detail")
    full = F.exists(F.coalesce("sections", F.array().cast(pages.schema["sections"].dataType)),
                    lambda s: ~F.coalesce(s["is_boilerplate"], F.lit(False)) & tx.has_text(s["text"]))
    empty = pages.where(~full).select(F.lit("empty_page").alias("kind"), name.alias("subject"), F.lit(None).cast("string").alias("detail"))
    # Two hashes are enough to tell; their extremes are combined on the map side.
    hashes = pages.where(tx.has_text(F.col("url"))).groupBy("url").agg(F.min("content_sha256").alias("a"), F.max("content_sha256").alias("b"))
    conflicts = hashes.where("a <> b").select(F.lit("conflicting_url").alias("kind"), F.col("url").alias("subject"), F.lit(None).cast("string").alias("detail"))
    return missing.unionByName(empty).unionByName(conflicts)


def integrity_report(manifest: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, subject, detail, is_error: one row per break."""
    found = file_faults(manifest, files, pages.select("path")).unionByName(page_faults(pages))
    return found.withColumn("is_error", ~F.col("kind").isin(*WARNINGS))


def assert_sound(report: DataFrame) -> None:
    """Raise if the report holds errors; they block indexing."""
    counts = report.where("is_error").groupBy("kind").count().orderBy("kind").collect()
    if counts:
        raise ValueError("the corpus is not sound: " + ", ".join(f"{r['kind']} {r['count']}" for r in counts))
