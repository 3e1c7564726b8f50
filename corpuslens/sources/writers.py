"""Writers: tables as CSV, page documents by entity, snapshots."""

from __future__ import annotations

from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import text as tx
from corpuslens.functions import web
from corpuslens.operators.grouping import with_position
from corpuslens.session import broadcast_if_small, store


def csv_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only ``fields``, in order; doubles with 6 decimals, undefined ones blank."""
    types = dict(df.dtypes)

    def cell(name: str):
        if name not in types:
            return F.lit("")
        value = F.col(name)
        # format_string would print NULL as a word.
        text = F.when(value.isNotNull(), F.format_string("%.6f", value)) if types[name] == "double" else value.cast("string")
        return F.coalesce(text, F.lit(""))

    return df.select(*[cell(f).alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str], single_file: bool = False) -> None:
    """``single_file`` is for reports of a few rows; tables keep their partitions."""
    out = csv_columns(df, fields)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')


def entities(pages: DataFrame) -> DataFrame:
    """Adds ``entity`` (name to group by) and ``is_specific``."""
    specific = F.coalesce(F.col("cancer_type"), F.lit("")) != ""
    return pages.withColumn("is_specific", specific).withColumn(
        "entity", F.when(specific, F.col("cancer_type")).otherwise(F.col("summary_name"))
    )


def entity_manifest(pages: DataFrame) -> DataFrame:
    """One row per entity: page_count, sorted topics and audiences, file name.

    Both sets come from short fixed lists, so they stay small whatever the
    number of pages; counts are combined before the shuffle.
    """
    grouped = entities(pages).groupBy("is_specific", "entity").agg(
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_set("topic")).alias("topics"),
        F.array_sort(F.collect_set("audience")).alias("audiences"),
    )
    folder = F.when(F.col("is_specific"), "cancers/").otherwise("general_topics/")
    return grouped.withColumn("slug", tx.slugify("entity")).withColumn(
        "file", F.concat(folder, F.col("slug"), F.lit(".json"))
    )


def file_clashes(manifest: DataFrame) -> DataFrame:
    """Entities whose names lead to the same file: file, entities."""
    return manifest.groupBy("file").agg(F.count("*").alias("n"), F.min("entity").alias("first"),
                                        F.max("entity").alias("last")).where("n > 1")


PAGE_ORDER = ["topic", "audience", "title", "url"]
# Pages in one file: it is written by one task and read as one value.
FILE_PAGES = 10_000


def _head() -> list:
    """Fields of a document before its pages. A specific entity has no scope, the others no type."""
    specific = F.col("is_specific")
    return [
        F.lit(fv.SCHEMA_VERSION).alias("schema_version"), F.lit(fv.PAGE_SOURCE).alias("source"),
        F.lit(fv.PAGE_COLLECTION).alias("collection"), F.when(specific, F.col("entity")).alias("cancer_type"),
        F.when(~specific, F.lit(fv.GENERAL_SCOPE)).alias("scope"), F.when(~specific, F.col("entity")).alias("summary_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at"), "page_count",
    ]


def document_lines(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """is_specific, entity, part, place, line: the JSON documents of each entity, a line at a time.

    Pages are numbered by topic, audience, title and URL. A document holds at most
    ``file_pages`` of them; an entity with more has several documents, parts 0, 1 and so on,
    each complete in itself. Line 0 opens a document, then comes a line per page, and a last one
    closes it. The numbers come from one range sort of all pages, so an entity of any size is sorted by many tasks.
    """
    columns = [c for c in pages.columns if c not in ("load_order", "source_file")]
    order = [F.col("is_specific"), F.col("entity"), *[F.col(c) for c in PAGE_ORDER]]
    rows = store(with_position(entities(pages), order, "_position"), "page-lines")
    totals = rows.groupBy("is_specific", "entity").agg(F.count("*").alias("n_pages"), F.min("_position").alias("_first"))
    kept = totals.select(F.col("is_specific").alias("_kind"), F.col("entity").alias("_name"), "_first")
    same = F.col("is_specific").eqNullSafe(F.col("_kind")) & F.col("entity").eqNullSafe(F.col("_name"))
    at = F.col("_position") - F.col("_first")
    place = at % file_pages + 1
    body = rows.join(broadcast_if_small(kept), same).select(
        "is_specific", "entity", F.floor(at / file_pages).alias("part"), place.alias("place"),
        F.concat(F.when(place > 1, ",").otherwise(""), F.to_json(F.struct(*columns))).alias("line"),
    )
    parts = totals.select(
        "is_specific", "entity", "n_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_pages") - 1) / file_pages))).alias("part")
    ).withColumn("page_count", F.least(F.lit(file_pages), F.col("n_pages") - F.col("part") * file_pages))
    opening = F.regexp_replace(F.to_json(F.struct(*_head())), r"\}$", ',"pages":[')
    ends = parts.select("is_specific", "entity", "part", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("place"), opening.alias("line")),
        F.struct((F.col("page_count") + 1).alias("place"), F.lit("]}").alias("line")),
    )))
    return body.unionByName(ends)


def write_lines(rows: DataFrame, folder: str) -> list[str]:
    """Write rows of file (a relative path), place and line as the files they name; returns the paths.

    The lines of a file are sorted in their task and streamed to it, in a folder beside the
    target; the finished file is renamed, so no text passes the driver.
    """
    spark = rows.sparkSession
    made = f"{folder}/_lines-{uuid4().hex}"
    (
        rows.select("line", "place", "file").repartition("file").sortWithinPartitions("file", "place").drop("place")
        .write.partitionBy("file").text(made)
    )
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = lambda *parts: hadoop.Path("/".join(parts))
    store_of = path(made).getFileSystem(conf)
    files = []
    for entry in store_of.listStatus(path(made)):
        name = unquote(entry.getPath().getName())
        if not name.startswith("file="):
            continue
        name = name.removeprefix("file=")
        parts = [p.getPath() for p in store_of.listStatus(entry.getPath()) if p.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{name} has {len(parts)} parts")
        target = path(folder, name)
        store_of.mkdirs(target.getParent())
        if store_of.exists(target):
            store_of.delete(target, False)
        if not store_of.rename(parts[0], target):
            raise RuntimeError(f"{name} could not be written")
        files.append(name)
    store_of.delete(path(made), True)
    return sorted(files)


def write_page_documents(pages: DataFrame, folder: str) -> list[str]:
    """Write ``cancers/<slug>.json`` and ``general_topics/<slug>.json``, in place of those there; returns these paths.

    Further documents of an entity with more than ``FILE_PAGES`` pages are ``<slug>.2.json`` and so on; readers take
    all files of a folder.
    """
    clash = file_clashes(entity_manifest(pages)).first()
    if clash:
        raise ValueError(f"{clash['first']!r} and {clash['last']!r} lead to the same file {clash['file']}")
    spark = pages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for kind in ("cancers", "general_topics"):
        old = hadoop.Path(f"{folder}/{kind}")
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.mkdirs(old)
    kind = F.when(F.col("is_specific"), "cancers/").otherwise("general_topics/")
    part = F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part") + 1)).otherwise("")
    return write_lines(document_lines(pages).withColumn("file", F.concat(kind, tx.slugify("entity"), part, F.lit(".json"))), folder)


def write_snapshots(pages: DataFrame, path: str) -> None:
    """Raw HTML table keyed by URL hash: key, url, html, saved_at."""
    pages.select(web.raw_html_key(F.col("url")).alias("key"), "url", "html", F.current_timestamp().alias("saved_at")).write.mode("append").parquet(path)
