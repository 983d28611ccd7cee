"""Stored observations: merges equal one pass, whatever the batches; days, nulls, empty batches, repeated runs."""

import pytest

from conftest import rows
from driftspark.operators.infer import observed_types
from driftspark.sources.observations import Observations, merged_types

BODIES = ['{"a":1}', '{"a":"x","b":[{"c":1.5}]}', "[]", "{broken", None, '{"a":1,"d":{"e":null}}', ""]
COLUMNS = ["k", "node_path", "trail", "depth", "type", "samples", "first_seen", "last_seen"]


@pytest.fixture(scope="module")
def payloads(spark):
    data = [
        ((None, "hot", "hot", "cold")[i % 4], f"2024-01-{1 + i % 5:02d} {i % 24:02d}:00:00" if i % 11 else None, BODIES[i % len(BODIES)], i % 3)
        for i in range(120)
    ]
    return spark.createDataFrame(data, "k string, at string, body string, part int").selectExpr("k", "timestamp(at) AS ts", "body", "part")


def stored(spark, payloads, path, batches):
    store = Observations(spark, str(path), ["k"])
    for batch in batches:
        store.add(payloads.where(f"part = {batch}"), batch)
    return store


def test_batches_in_any_order_and_run_twice(spark, payloads, tmp_path):
    one_pass = rows(observed_types(payloads, ["k"]), *COLUMNS)
    assert rows(stored(spark, payloads, tmp_path / "a", [2, 0, 1, 0]).types(), *COLUMNS) == one_pass


def test_windows_of_days(spark, payloads, tmp_path):
    store = stored(spark, payloads, tmp_path / "b", [0, 1, 2])
    inside = payloads.where("ts >= '2024-01-02' AND ts < '2024-01-05'")
    assert rows(store.types("2024-01-02", "2024-01-04"), *COLUMNS) == rows(observed_types(inside, ["k"]), *COLUMNS)
    assert rows(store.types("2025-01-01"), *COLUMNS) == []
    plan = store.types("2024-01-02", "2024-01-04")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(day" in plan


def test_folded_batches(spark, payloads, tmp_path):
    store = stored(spark, payloads, tmp_path / "c", [0, 1, 2])
    store.fold([0, 1], "first")
    folded = store.parts().where("batch in ('first', '2')")
    assert rows(merged_types(folded, ["k"]), *COLUMNS) == rows(observed_types(payloads, ["k"]), *COLUMNS)
    with pytest.raises(ValueError):
        store.fold([0, 1], 1)


def test_empty_batches_and_clashing_names(spark, payloads, tmp_path):
    store = Observations(spark, str(tmp_path / "d"), ["k"])
    store.add(payloads.where("false"), 0)
    assert rows(store.types(), *COLUMNS) == []
    named = payloads.selectExpr("*", "'x' AS day", "1 AS samples", "2 AS batch", "3 AS type")
    store.add(named, 1)
    assert rows(store.types(), *COLUMNS) == rows(observed_types(payloads, ["k"]), *COLUMNS)
    with pytest.raises(ValueError):
        Observations(spark, str(tmp_path / "e"), ["k", "Day"])
