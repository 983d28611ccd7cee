"""The as-of join against a plain restatement: hot keys over many ranges, ties, nulls, empty sides, clashing names."""

import random

import pytest

from driftspark.operators.as_of import as_of_join
from driftspark.sources import snapshots

ROWS = "k string, at int, n int"
STATES = "k string, at int, v int"


def restated(rows, states):
    out = []
    for k, at, n in rows:
        reached = [(s, v) for key, s, v in states if key is not None and key == k and s is not None and at is not None and s <= at]
        out.append((k, at, n, max(reached)[1] if reached else None))
    return sorted(out, key=repr)


def joined(spark, rows, states, partitions):
    left, right = spark.createDataFrame(rows, ROWS), spark.createDataFrame(states, STATES)
    got = as_of_join(left, right, ["k"], "at", "at", ["v"], partitions=partitions)
    assert got.columns == ["k", "at", "n", "valid"]
    return sorted(((r.k, r.at, r.n, r.valid.v if r.valid else None) for r in got.collect()), key=repr)


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_hot_keys_ties_and_nulls(spark, partitions):
    draw = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", "c", "", None]
    rows = [(draw.choice(keys), draw.choice([None, *range(60)]), draw.randrange(4)) for _ in range(700)]
    states = [(draw.choice(keys[5:]), draw.choice([None, *range(0, 60, 7)]), draw.randrange(9)) for _ in range(80)]
    assert joined(spark, rows, states, partitions) == restated(rows, states)


def test_one_instant_over_many_ranges(spark):
    rows = [("hot", 5, n) for n in range(400)] + [("hot", 4, 0)]
    states = [("hot", 5, 1), ("hot", 5, 2), ("cold", 1, 9)]
    assert joined(spark, rows, states, 8) == restated(rows, states)


def test_states_far_before_their_rows(spark):
    rows = [("hot", at, 0) for at in range(100, 400)] + [("late", 1, 0), ("late", 999, 0)]
    states = [("hot", 1, 1), ("late", 998, 2)]
    assert joined(spark, rows, states, 9) == restated(rows, states)


@pytest.mark.parametrize("rows, states", [([], [("a", 1, 1)]), ([("a", 1, 1), ("a", 1, 1)], []), ([], [])])
def test_empty_sides(spark, rows, states):
    assert joined(spark, rows, states, 3) == restated(rows, states)


def test_names_that_clash(spark):
    columns = ["key", "at", "side", "state", "row", "part", "seen", "carried", "spread"]
    left = spark.createDataFrame([("x", 3, 1, 2, 4, 5, 6, 7, 8)], ", ".join(f"`{c}` {'string' if c == 'key' else 'int'}" for c in columns))
    right = spark.createDataFrame([("x", 2, 1)], "key string, at int, side int")
    got = as_of_join(left, right, ["key"], "at", "at", ["side"], name="found").collect()
    assert [tuple(r) for r in got] == [("x", 3, 1, 2, 4, 5, 6, 7, 8, (1,))]
    with pytest.raises(ValueError):
        as_of_join(left, right, ["key"], "at", "at", ["side"], name="Seen")


def test_columns_without_an_order(spark):
    left = spark.sql("SELECT 'x' AS k, 1 AS at, map('a', 1) AS m, parse_json('{}') AS j")
    right = spark.createDataFrame([("x", 1, 7)], STATES)
    assert as_of_join(left, right, ["k"], "at", "at", ["v"]).selectExpr("m['a'] AS m", "valid.v").collect() == [(1, 7)]


def test_payloads_are_judged_by_the_version_of_their_time(spark):
    contracts = spark.sql(
        "SELECT * FROM VALUES ('o', 'a', 1L, timestamp'2024-01-01 10:00'), ('o', 'a', 2L, timestamp'2024-01-01 12:00') "
        "AS t(owner, app, version, generated_at)"
    )
    endpoints = spark.sql(
        "SELECT 'o' AS owner, 'a' AS app, version, 0L AS ordinal, 'GET' AS method, path, status_codes FROM VALUES "
        "(1L, '/x', array(200)), (2L, '/x', array(200, 404)), (2L, '/y', array(200)) AS t(version, path, status_codes)"
    )
    payloads = spark.sql(
        "SELECT timestamp(ts) AS ts, 'o' AS owner, app, 'GET' AS method, path, status FROM VALUES "
        "('2024-01-01 09:59', 'a', '/x', 200), ('2024-01-01 10:00', 'a', '/x', 404), ('2024-01-01 12:00', 'a', '/x', 404), "
        "('2024-01-01 13:00', 'a', '/x', 404), ('2024-01-01 11:00', 'a', '/y', 200), ('2024-01-01 13:00', 'b', '/y', 200) "
        "AS t(ts, app, path, status)"
    )
    got = snapshots.undocumented(payloads, contracts, endpoints).select("app", "path", "version", "status", "verdict", "calls").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [
            ("a", "/x", None, 200, "no contract", 1), ("a", "/x", 1, 404, "unknown status", 1),
            ("a", "/x", 2, 404, "documented", 2), ("a", "/y", 1, 200, "unknown endpoint", 1),
            ("b", "/y", None, 200, "no contract", 1),
        ],
        key=repr,
    )
