"""Every query at the smallest scale against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, round(v, 2) if isinstance(v, float) else str(v)) for v in row))


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, TESTDATA)
    columns = sorted(df.columns)
    rows = [tuple(row[c] for c in columns) for row in df.collect()]
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = con.execute(sql)
    labels = [d[0] for d in result.description]
    assert sorted(labels) == columns
    at = sorted(range(len(labels)), key=lambda i: labels[i])
    expected = [tuple(row[i] for i in at) for row in result.fetchall()]
    assert len(rows) == len(expected)
    for ours, theirs in zip(ordered(rows), ordered(expected)):
        assert all(same(a, b) for a, b in zip(ours, theirs)), (ours, theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


INVENTORY = {"S": 14, "P": 28, "J": 10, "A": 15, "W": 13, "O": 3, "U": 4, "C": 15, "Q": 2, "M": 15, "R": 8}


def test_the_inventory_is_covered():
    from catalog import all_queries

    covered = {item for query in all_queries().values() for item in query.covers.split()}
    assert {f"{kind}{i}" for kind, n in INVENTORY.items() for i in range(1, n + 1)} <= covered
