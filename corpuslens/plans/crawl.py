"""Index pages to page records, entity documents and a manifest."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions import web
from corpuslens.operators import discovery, html
from corpuslens.session import spread, store
from corpuslens.sources import readers, writers
from corpuslens.sources.web import fetch_pages, http_get


def select_collections(names: list[str]) -> list[str]:
    chosen = list(fv.INDEX_URLS) if names == ["all"] else names
    unknown = [n for n in chosen if n not in fv.INDEX_URLS]
    if unknown:
        raise ValueError(f"unknown collection(s): {', '.join(unknown)}")
    return chosen


def index_pages(spark: SparkSession, collections: list[str]) -> DataFrame:
    rows = [(c, fv.INDEX_URLS[c]) for c in collections]
    return spark.createDataFrame(rows, "collection string, url string")


def pages_to_read(index_html: DataFrame) -> DataFrame:
    """Discovered pages from rows with collection, url and html.

    There is one index page per collection, so the lists of a row are short.
    """
    return discovery.discover(discovery.link_facts(discovery.links(html.scan_pages(index_html))))


def parse(pages_html: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page records, failures) of pages with html; scanned once, then stored."""
    scanned = store(html.scan_pages(spread(pages_html, "url")).drop("html"), "scanned")
    pages = html.parse_pages(scanned).withColumn(
        "raw_html_file", F.concat(F.lit("raw_html/"), web.raw_html_key(F.col("url")), F.lit(".html"))
    )
    return pages, html.failures(scanned)


def crawl(
    spark: SparkSession, output: str, *, collections: list[str] | None = None, robots_text: str | None = None,
    user_agent: str = "corpuslens/1.0", use_cache: bool = False, keep_html: bool = True, **fetching,
) -> dict:
    """Read, parse and save the pages of the given collections.

    ``robots_text`` are the site's rules; None means not to apply any.
    """
    chosen = select_collections(collections or ["all"])
    index = index_pages(spark, chosen)
    if robots_text is not None:
        index = discovery.allowed_by_robots(index, robots_text, user_agent).where("allowed").drop("allowed")
    fetching = {"fetcher": partial(http_get, user_agent=user_agent), **fetching}
    index = store(fetch_pages(index, **fetching), "index")
    broken = index.where(F.col("html").isNull()).first()
    if broken:
        raise RuntimeError(f"{broken['url']}: {broken['fetch_error']}")
    found = store(pages_to_read(index), "discovered")
    if robots_text is not None:
        found = discovery.allowed_by_robots(found, robots_text, user_agent)
    else:
        found = found.withColumn("allowed", F.lit(True))
    wanted = found.where("allowed").drop("allowed")
    if use_cache and readers._exists(spark, f"{output}/raw_html"):
        cached = store(readers.with_cached_html(wanted, spark.read.parquet(f"{output}/raw_html")), "cached")
        have = cached.where(F.col("html").isNotNull()).withColumn("fetch_error", F.lit(None).cast("string"))
        fresh = fetch_pages(cached.where(F.col("html").isNull()).drop("html"), **fetching)
        read = have.unionByName(fresh).drop("key")
    else:
        read = fetch_pages(wanted, **fetching)
    read = store(read, "pages")
    if keep_html:
        writers.write_snapshots(read.where(F.col("html").isNotNull()), f"{output}/raw_html")
    pages, failed = parse(read.where(F.col("html").isNotNull()).drop("fetch_error"))
    pages = store(pages, "parsed")
    failed = (
        failed.unionByName(read.where(F.col("html").isNull()).select("url", "collections", F.col("fetch_error").alias("reason")))
        .unionByName(found.where(~F.col("allowed")).select("url", "collections", F.lit("disallowed_by_robots_txt").alias("reason")))
    )
    found.drop("allowed").write.mode("overwrite").json(f"{output}/discovered_pages")
    pages.write.mode("overwrite").json(f"{output}/all_pages")
    files = writers.write_page_documents(pages, output)
    failed.write.mode("overwrite").json(f"{output}/failures")
    entities = store(writers.entity_manifest(pages), "manifest")
    entities.write.mode("overwrite").json(f"{output}/files")
    manifest = counts(found, pages, failed, entities).first().asDict()
    manifest |= {
        "schema_version": fv.SCHEMA_VERSION, "source": fv.PAGE_SOURCE, "collection": fv.PAGE_COLLECTION,
        "base_url": fv.SITE_BASE_URL, "collections_requested": chosen,
        "index_urls": {c: fv.INDEX_URLS[c] for c in chosen},
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "cancer_files": [f for f in files if f.startswith("cancers/")],
        "general_topic_files": [f for f in files if f.startswith("general_topics/")],
        "failures": {r["reason"]: r["count"] for r in failed.select(
            F.regexp_extract("reason", "^([A-Za-z_]+)", 1).alias("reason")).groupBy("reason").count().collect()},
        "tables": {"files": "files", "failures": "failures", "pages": "all_pages", "discovered": "discovered_pages"},
        "notes": ["A page is in the file of its cancer type, or of its title where it names none.",
                  "Failed and disallowed pages are listed with their reasons in the failures table."],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{output}/manifest"
    )
    return manifest


def counts(found: DataFrame, pages: DataFrame, failed: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of totals, each a scalar subquery."""
    def size(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    return found.sparkSession.range(1).select(
        found.agg(F.count_distinct("url")).scalar().alias("discovered_url_count"),
        size(pages).alias("success_count"),
        size(failed).alias("failure_count"),
        size(entities.where("is_specific")).alias("cancer_file_count"),
        size(entities.where("not is_specific")).alias("general_topic_file_count"),
    )
