"""Links of index pages to a table of pages to read."""

from __future__ import annotations

from urllib.parse import unquote, urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens.functions import text as tx
from corpuslens.functions import web


def _join(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute form of a link; a link that cannot be read gives NULL."""
    return pd.Series([_join(b, h) for b, h in zip(base, href)])


def links(scanned: DataFrame) -> DataFrame:
    """collection, index_url, url, label for every link of scanned index pages.

    Absolute http(s) links, by far the most, skip the Python step. The explode is
    an outer one, because the filters Spark derives from a plain explode would
    scan the pages a second time; pages without links drop out as NULL URLs.
    """
    rows = scanned.select("collection", F.col("url").alias("index_url"), F.explode_outer("scan.links").alias("l"))
    absolute = F.col("l.href").rlike("^(?i)https?://[^/?#]")
    target = F.when(absolute, F.col("l.href")).otherwise(
        resolve(F.col("index_url"), F.when(~absolute, F.col("l.href")).otherwise(F.lit("")))
    )
    return rows.select(
        "collection", "index_url", web.canonical_url(target).alias("url"),
        tx.normalize_ws(F.col("l.label")).alias("label"),
    ).where(F.col("url").isNotNull())


def link_facts(found: DataFrame, only_content: bool = True) -> DataFrame:
    """url, kind (collection, from or label), value: what the links say about each URL, once.

    A long table: a URL linked from a third of all pages is spread over all tasks.
    """
    if only_content:
        found = found.where(web.is_content_url(F.col("url")))
    return found.select(
        "url",
        F.inline(F.array(*[
            F.struct(F.lit(kind).alias("kind"), value.alias("value"))
            for kind, value in (
                ("collection", F.col("collection")), ("from", F.col("index_url")), ("label", tx.truthy(F.col("label")))
            )
        ])),
    ).where(F.col("value").isNotNull()).distinct()


def discover(facts: DataFrame) -> DataFrame:
    """One row per URL with its sorted sets of collections, labels and index pages, from :func:`link_facts`.

    A row holds the distinct values of one URL. Where those have no bound, read the
    facts themselves, or :func:`link_counts`.
    """
    def values(kind: str):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    return facts.groupBy("url").agg(
        values("collection").alias("collections"),
        values("label").alias("index_link_labels"),
        values("from").alias("discovered_from"),
    )


def link_counts(facts: DataFrame) -> DataFrame:
    """One row per URL: number of different collections, labels and origins. Combined before the shuffle."""
    names = {"collection": "collections", "label": "labels", "from": "origins"}
    return facts.groupBy("url").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in names.items()])


def robots_rules(robots_text: str, user_agent: str) -> list[tuple[bool, str]]:
    """(allowed, path prefix) in order, for the first group that names the agent, else for all agents."""
    parsed = RobotFileParser()
    parsed.parse(robots_text.splitlines())
    if parsed.disallow_all:
        return [(False, "/")]
    groups = [g for g in parsed.entries if g.applies_to(user_agent)] or [parsed.default_entry]
    return [(r.allowance, unquote(r.path)) for r in groups[0].rulelines] if groups[0] else []


def allowed_by_robots(pages: DataFrame, robots_text: str, user_agent: str) -> DataFrame:
    """Adds ``allowed``: what the first rule says whose path the URL's begins with; True without one.

    The rules are read once, on the driver; URLs are tested by columns.
    """
    rest = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(rest, r"\+", "%2B")), rest)
    path = F.when(decoded == "", "/").otherwise(decoded)
    allowed = F.lit(None).cast("boolean")
    for allow, prefix in reversed(robots_rules(robots_text, user_agent)):
        hit = F.lit(True) if prefix == "*" else path.startswith(prefix)
        allowed = F.when(hit, F.lit(allow)).otherwise(allowed)
    return pages.withColumn("allowed", F.coalesce(allowed, F.lit(True)))
