"""URL and page-metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.functions.text import normalize_ws

# scheme, authority and path of an absolute URL; query and fragment follow.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_part(url: Column, part: int) -> Column:
    return F.regexp_extract(url, _URL, part)


def canonical_url(url: Column) -> Column:
    """Lower-case host, no query or fragment, single slashes, https by default."""
    scheme = F.lower(url_part(url, 1))
    host = F.lower(url_part(url, 2))
    path = F.regexp_replace(url_part(url, 3), "/{2,}", "/")
    host = F.when(host == fv.SITE_BARE_HOST, fv.SITE_HOST).otherwise(host)
    # A host and a path need a slash between them.
    path = F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme == "", "https").otherwise(scheme),
        F.when(host == "", ":").otherwise(F.concat(F.lit("://"), host)),
        path,
    )


def is_content_url(url: Column) -> Column:
    path = F.lower(url_part(url, 3))
    return (
        F.lower(url_part(url, 2)).isin(fv.SITE_HOST, fv.SITE_BARE_HOST)
        & ~path.startswith(fv.INDEX_PATH_PREFIX)
        & path.contains(fv.CONTENT_PATH_MARKER)
    )


def raw_html_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, fv.RAW_HTML_HASH_HEX)


def audience(url: Column, title: Column) -> Column:
    path, title = F.lower(url_part(url, 3)), F.lower(title)
    return (
        F.when(path.contains("/hp/") | title.contains("health professional version"), "health_professional")
        .when(path.contains("/patient/") | title.contains("patient version"), "patient")
        .otherwise("unspecified")
    )


def strip_title_suffix(title: Column) -> Column:
    """'X (PDQ®)–Health Professional Version' becomes 'X'."""
    name = F.regexp_replace(normalize_ws(title), r"(?iu)\s*\(PDQ[^)]*\).*$", "")
    name = F.regexp_replace(name, r"(?iu)\s*[–—-]\s*(Health Professional|Patient) Version\s*$", "")
    return normalize_ws(name)


def topic(collections: Column) -> Column:
    known = F.filter(
        F.array(*[F.lit(t) for t in fv.TOPIC_PRIORITY]), lambda t: F.array_contains(collections, t)
    )
    return F.coalesce(F.get(known, F.lit(0)), F.get(collections, F.lit(0)), F.lit("unknown"))


def entity_name(summary_name: Column, collections: Column) -> Column:
    """Grouping key of a site-specific page; NULL for all others."""
    specific = F.arrays_overlap(collections, F.array(*[F.lit(c) for c in fv.SITE_SPECIFIC_COLLECTIONS]))
    name = summary_name
    for suffix in fv.NAME_SUFFIXES:
        name = F.regexp_replace(name, rf"(?iu)\s+{suffix}$", "")
    name = normalize_ws(name)
    alias = name
    for spelling, canonical in fv.NAME_ALIASES.items():
        alias = F.when(name == spelling, canonical).otherwise(alias)
    return F.when(specific & ~F.lower(name).isin(fv.OVERVIEW_NAMES), alias)


def is_boilerplate(path: Column) -> Column:
    return F.exists(path, lambda p: F.lower(normalize_ws(p)).isin(fv.BOILERPLATE_HEADINGS))
