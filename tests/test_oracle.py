"""Every registered query against its reference SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpuslens.catalog import oracle
from corpuslens.catalog.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(oracle.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def test_pages_have_one_heading(duck):
    """The reference SQL for sections relies on it."""
    for (html,) in duck.execute("SELECT html FROM pages").fetchall():
        assert html.count("<h1") == 1 and not any(f"<h{n}" in html for n in range(2, 7))


def test_entry_runs(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql())
