from pathlib import Path

import duckdb
import pytest

from corpuslens.llm.oracle import SQL
from corpuslens.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the given tables")


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    duck = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = duck.execute(SQL[name])
    names = sorted(c[0] for c in found.description)
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == names
    order = [c[0] for c in found.description]
    wanted = sorted(repr([r[order.index(n)] for n in names]) for r in found.fetchall())
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == wanted
