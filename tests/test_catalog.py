"""Every query of the data-structure operators against its SQL in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from cairn import catalog
from tests.conftest import SF

ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.SQL))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    return "" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(made.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = sorted(tuple(plain(row[k]) for k in order) for row in said.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(columns)) for row in made.collect()) == expected


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns
