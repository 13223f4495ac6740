"""Every registered query with checking SQL gives the same rows on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from chainlens.plans import oracle_queries, spark_queries

DATA = Path("/root/testdata/sf0.001")
ORACLES = oracle_queries()
QUERIES = spark_queries()


def _text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_checking_query_has_a_spark_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(tuple(_text(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [item[0] for item in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(_text(row[i]) for i in order) for row in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, str(DATA)).count() > 0
