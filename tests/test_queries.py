"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import math

import duckdb
import pytest

from diurna import queries as library
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return round(float(v), 4) if hasattr(v, "as_tuple") else v


def rows_of(names, rows):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    found = library.queries()[name](spark, SF)
    wanted = duck.sql(library.oracle_sql()[name])
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_runs(spark, name):
    assert library.queries()[name](spark, SF).count() > 0
