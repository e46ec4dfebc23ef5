import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def table(columns, rows):
    """Rows as text with the columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or isinstance(value, float) and math.isnan(value):
            return "null"
        return repr(value + 0.0) if isinstance(value, float) else str(value)

    return sorted(columns), sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    result = entry_points.queries()[name](spark, FOLDER)
    expected = database.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert table(result.columns, result.collect()) == table(columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert entry_points.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())
