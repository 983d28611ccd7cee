"""Queries of this subpackage against their SQL, over whole tables."""

import duckdb
import pytest

from driftspark.llm.queries import ORACLE, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_matches_its_sql(spark, name, folder):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
