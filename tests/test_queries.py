"""Every query against its SQL counterpart on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = Path(driver.SMOKE_FOLDER)
TABLES = "events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER / name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    number = float(value)
    return "None" if math.isnan(number) else repr(number + 0.0)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([plain(row[i]) for i in order] for row in rows)


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(FOLDER))
    rows = [tuple(r) for r in found.collect()]
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert table(found.columns, rows) == table(columns, cursor.fetchall())
