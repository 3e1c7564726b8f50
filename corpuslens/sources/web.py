"""Reading pages over HTTP as a Spark step, with an injected fetcher."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv

# Address and timeout in, (status, headers, body) out.
Fetcher = Callable[[str, float], tuple[int, dict, str]]


def http_get(address: str, timeout: float, user_agent: str = "corpuslens/1.0") -> tuple[int, dict, str]:
    request = urllib.request.Request(
        address, headers={"User-Agent": user_agent, "Accept": "text/html", "Accept-Language": "en"}
    )
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            charset = reply.headers.get_content_charset() or "utf-8"
            return reply.status, dict(reply.headers), reply.read().decode(charset, "replace")
    except urllib.error.HTTPError as problem:
        return problem.code, dict(problem.headers or {}), ""


def fetch_one(address: str, fetcher: Fetcher, timeout: float, sleep: Callable[[float], None]) -> str:
    """Body of a page; busy answers and lost connections are tried again."""
    for attempt in range(fv.FETCH_RETRIES + 1):
        last = attempt == fv.FETCH_RETRIES
        try:
            status, headers, body = fetcher(address, timeout)
        except OSError:
            if last:
                raise
            sleep(float(2**attempt))
            continue
        if status in fv.FETCH_RETRY_STATUSES and not last:
            wait = str(headers.get("Retry-After", ""))
            sleep(float(wait) if wait.isdigit() else float(2**attempt))
            continue
        if not 200 <= status < 300:
            raise RuntimeError(f"HTTP status {status}")
        return body
    raise AssertionError


def robots_rules(fetcher: Fetcher = http_get, sleep: Callable[[float], None] = time.sleep) -> str:
    """Text of the site's robots.txt; not being able to read it is an error."""
    return fetch_one(f"{fv.SITE_BASE_URL}/robots.txt", fetcher, 30, sleep)


def fetch_pages(
    pages: DataFrame, *, fetcher: Fetcher = http_get, timeout: float = 45, delay: float = 0.75,
    readers: int = 64, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds html and fetch_error to rows with a ``url``.

    Hosts are spread over ``readers`` tasks, each host whole in one, which waits
    ``delay`` seconds between two of its pages: the load on a site does not
    depend on the number of tasks.
    """
    schema = pages.schema.add("html", "string").add("fetch_error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            bodies, errors = [], []
            for url in batch["url"]:
                host = urlsplit(url).netloc.lower()
                if host in seen and delay > 0:
                    sleep(delay)
                seen.add(host)
                try:
                    body, error = fetch_one(url, fetcher, timeout, sleep), None
                except Exception as problem:
                    body, error = None, f"{type(problem).__name__}: {problem}"
                bodies.append(body)
                errors.append(error)
            yield batch.assign(html=bodies, fetch_error=errors)

    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.repartition(readers, host).mapInPandas(run, schema)
