"""Every registered query against its SQL in an independent engine, over whole (small) tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from driftspark.plans.oracle import ORACLE
from driftspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in data), key=repr)


def test_every_query_has_its_check():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = entry_point.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    cursor = duck.execute(entry_point.oracle_sql()[name])
    expected = normal([d[0] for d in cursor.description], cursor.fetchall())
    assert normal(got.columns, rows) == expected
    assert rows


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["owner", "app", "method", "path", "field", "change_type", "kind", "message"]
    assert "driftspark" in sys.modules
