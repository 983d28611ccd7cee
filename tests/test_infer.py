import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftspark.functions.json_types import json_type
from driftspark.operators import infer


def payloads(spark, bodies, path="/x"):
    base = dt.datetime(2024, 1, 1)
    data = [("o", "a", "GET", path, base + dt.timedelta(minutes=i), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, "owner string, app string, method string, path string, ts timestamp, body string")


def schema_of(value, depth=0):
    """Brute force: type per path, from the rules in words."""
    out = {}

    def tag(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, str):
            return "string"
        if isinstance(v, (int, float)):
            f = float(v)
            return "integer" if f == f and abs(f) != float("inf") and f % 1 == 0 else "number"
        return "array" if isinstance(v, list) else "object"

    def walk(v, path, trail, depth):
        out[(tuple(path), trail)] = (tag(v), depth)
        if isinstance(v, dict) and depth <= 6:
            for k, x in v.items():
                walk(x, [*path, k], trail + "p", depth + 1)
        if isinstance(v, list):
            head = v[:3]
            if not head:
                out[((*path, "[]"), trail + "i")] = (None, depth + 1)
            elif len({tag(x) for x in head}) == 1:
                walk(head[0], [*path, "[]"], trail + "i", depth + 1)
            else:
                out[((*path, "[]"), trail + "i")] = (None, depth + 1)
                for i, x in enumerate(head):
                    walk(x, [*path, "[]", f"oneOf#{i}"], trail + "io", depth + 1)

    walk(value, [], "", depth)
    return out


@pytest.mark.parametrize(
    "text, expected",
    [
        ("null", "null"), ('""', "string"), ("1", "integer"), ("1.0", "integer"), ("1e3", "integer"),
        ("2.5", "number"), ("1e400", "number"), ("12345678901234567890", "integer"), ("-0", "integer"),
        ("1.00000000000000000000000000000000000000001", "integer"), ("1.000000000000000000001", "integer"),
        ("true", "boolean"), ("[]", "array"), ("{}", "object"), ("{bad", None), ("1" * 50, "integer"),
    ],
)
def test_type_tags(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(json_type(F.col("t")).alias("k"))
    assert df.first()["k"] == expected


VALUES = [
    {"a": 1, "b": {"c": "x", "d": [1, 2.5, "s"]}, "e": []},
    [1, "a"],
    [1, 2.0, 3, "later elements are not looked at"],
    [{"a": 1}, {"b": 2}],
    [[1], [2]],
    [[1, "x"], [2], []],
    [None, "a"],
    {"a.b": {"[]": 1, "oneOf#0": [True]}},
    {"x": {"x": {"x": {"x": {"x": {"x": {"x": {"x": {"x": 1}}}}}}}}},
    {"l1": [{"l2": [{"l3": [{"l4": 1}]}]}]},
    {},
    [],
    5,
    None,
    {"constructor": 1, "toString": None, "": "empty key"},
    {"STRING": "x", "BIGINT": 1.25, "OBJECT": {"VOID": None, "DECIMAL": 10.50}, "_a1": True, "e": {}},
    {"big": 1234567890123456.5, "huge": 12345678901234567.5, "whole": 3.0, "exp": 1e3, "tiny": 1.0000000000000001},
    {"a": {"b": {"c": [{"d": {"e": 1}}], "f": {"g": "x"}}}, "h": {"i": False}},
]


@pytest.fixture(scope="module")
def many(spark):
    base = dt.datetime(2024, 1, 1)
    data = [("o", "a", "GET", f"/{i}", base, json.dumps(v)) for i, v in enumerate(VALUES)]
    ddl = "owner string, app string, method string, path string, ts timestamp, body string"
    return spark.createDataFrame(data, ddl)


def by_value(df):
    found = {}
    for r in df.collect():
        node = found.setdefault(int(r.path[1:]), {})
        assert (tuple(r.node_path), r.trail) not in node
        node[(tuple(r.node_path), r.trail)] = (r.type, r.depth)
    return found


def test_flatten_matches_brute_force(many):
    found = by_value(infer.flatten_values(many, F.try_parse_json("body"), ["path"]))
    assert found == {i: schema_of(v) for i, v in enumerate(VALUES)}


def test_folded_shapes_give_the_same_nodes(many):
    found = by_value(infer.observed_types(many))
    assert found == {i: schema_of(v) for i, v in enumerate(VALUES)}


def test_duplicate_keys_last_wins_and_bad_json_is_ignored(spark):
    df = payloads(spark, ['{"a": 1, "a": "x"}', "{bad", None])
    got = infer.flatten_values(df, F.try_parse_json("body"), ["path"])
    assert rows(got, "node_path", "type") == [(["a"], "string"), ([], "object")]


def test_examples_only_for_primitives(spark):
    df = payloads(spark, ['{"a": "z", "b": 2, "c": null, "d": [true], "e": 1.5}', '{"a": "k", "b": 3}'])
    got = infer.observed_types(df, examples=True)
    found = {(tuple(r.node_path), r.type): r.example for r in got.collect()}
    assert found[(("a",), "string")] == '"k"'
    assert found[(("b",), "integer")] == "2"
    assert found[(("c",), "null")] is None
    assert found[(("d",), "array")] is None
    assert found[(("d", "[]"), "boolean")] == "true"
    assert found[((), "object")] is None


def test_union_counts_types_and_times(spark):
    df = payloads(spark, ['{"a": 1}', '{"a": "x", "b": 1}', '{"a": 2}'])
    got = {(tuple(r.node_path), r.type): (r.samples, r.first_seen.minute, r.last_seen.minute) for r in infer.observed_types(df).collect()}
    assert got == {
        ((), "object"): (3, 0, 2), (("a",), "integer"): (2, 0, 2), (("a",), "string"): (1, 1, 1), (("b",), "integer"): (1, 1, 1),
    }


def test_observed_nodes_keep_first_type_and_drop_orphans(spark):
    df = payloads(spark, ['{"a": {"x": 1}, "b": "s", "c": [1, "m"]}', '{"a": "s", "b": {"y": 1}, "c": [{"z": 1}]}'])
    got = rows(infer.observed_nodes(infer.observed_types(df)), "node_path", "type", "trail")
    assert got == sorted(
        [
            ([], "object", ""), (["a"], "object", "p"), (["a", "x"], "integer", "pp"), (["b"], "string", "p"),
            (["c"], "array", "p"), (["c", "[]"], "object", "pi"), (["c", "[]", "z"], "integer", "pip"),
        ],
        key=repr,
    )


def test_latest_takes_newest_readable_payload(spark):
    df = payloads(spark, ['{"a": 1}', '{"b": 1}'])
    assert rows(infer.latest_schema(df), "node_path", "type") == [(["b"], "integer"), ([], "object")]
    plan = infer.latest_payloads(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_union_items_option(spark):
    df = payloads(spark, ['[{"a": 1}, {"b": "x"}]'])
    got = infer.observed_types(df, union_items=True)
    assert (["[]", "b"], "string") in rows(got, "node_path", "type")


def test_order_and_partitioning_do_not_matter(spark):
    bodies = [json.dumps(v) for v in VALUES]
    a = infer.observed_nodes(infer.observed_types(payloads(spark, bodies)))
    b = infer.observed_nodes(infer.observed_types(payloads(spark, bodies).orderBy(F.rand(7)).repartition(7)))
    assert rows(a) == rows(b)


def test_arrays_nested_beyond_the_unrolled_steps(spark):
    from driftspark.operators import infer

    bodies = [("[" * 14 + '{"a": [[1]]}' + "]" * 14,), ("[" * 14 + '{"a": [["x"]]}' + "]" * 14,), ("[1]",)]
    df = spark.createDataFrame([("p", b[0], 0) for b in bodies], "path string, body string, ts int")
    types = infer.observed_types(df, keys=["path"], levels=3)
    deepest = types.orderBy("depth", ascending=False).first()
    assert deepest["depth"] == 14 and types.where("depth = 13").first()["samples"] == 2
    flat = infer.flatten_values(df, F.try_parse_json("body"), ["path"], levels=2)
    assert flat.where("depth = 14").count() == 2
    shallow = spark.createDataFrame([("p", '{"a": [[[[[[1.5, "x"]]]]]]}', 0)], "path string, body string, ts int")
    assert infer.observed_types(shallow, keys=["path"], levels=2).where("trail like '%o'").count() == 2
