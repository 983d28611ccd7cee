import json
import re

import pytest
from conftest import Contract, contract_of, endpoints_of, nodes_of, obj, rows, typ

from driftspark.model import as_nodes, nodes_to_schema
from driftspark.operators import merge

S = {"x-contract-source": "sampled"}
KEY = ("GET", "/x", "response")


def documents(nodes):
    return {(r.method, r.path, r.location): json.loads(r.schema) for r in nodes_to_schema(nodes).collect()}


CASES = {
    # name: (baseline, observed, merged)
    "no baseline": (None, obj({"a": typ("string")}), obj({"a": typ("string")}, **S)),
    "no baseline, nested": (None, obj({"a": obj({"b": typ("null")})}), obj({"a": obj({"b": typ("null")})}, **S)),
    "unknown is replaced and marked": (
        typ("unknown", **{"x-contract-note": "why"}),
        obj({"a": obj({"b": typ("string")}), "l": typ("array", items=obj({"c": typ("string")}))}),
        obj({"a": obj({"b": typ("string", **S)}, **S), "l": typ("array", items=obj({"c": typ("string")}), **S)}, **S),
    ),
    "unknown property": (
        obj({"a": typ("unknown"), "b": typ("string")}),
        obj({"a": obj({"c": typ("integer")}), "b": typ("string")}),
        obj({"a": obj({"c": typ("integer", **S)}, **S), "b": typ("string")}, **S),
    ),
    "unknown items": (
        typ("array", items=typ("unknown")),
        typ("array", items=obj({"c": typ("integer")})),
        typ("array", items=obj({"c": typ("integer", **S)}, **S)),
    ),
    "new field is added and marked, its children are not": (
        obj({"a": typ("string")}), obj({"a": typ("string"), "n": obj({"m": typ("integer")})}),
        obj({"a": typ("string"), "n": obj({"m": typ("integer")}, **S)}, **S),
    ),
    "static field missing in the sample stays": (
        obj({"a": typ("string"), "b": obj({"c": typ("number")})}), obj({"a": typ("string")}),
        obj({"a": typ("string"), "b": obj({"c": typ("number")})}, **S),
    ),
    "sampled field missing in the sample goes": (
        obj({"a": typ("string"), "b": obj({"c": typ("number")}, **S)}), obj({"a": typ("string")}),
        obj({"a": typ("string")}, **S),
    ),
    "field of a sampled object goes": (
        obj({"a": typ("string"), "b": obj({"c": typ("number")})}, **S), obj({"a": typ("string")}),
        obj({"a": typ("string")}, **S),
    ),
    "nested sampled object": (
        obj({"o": obj({"x": typ("string"), "y": obj({"z": typ("string")})}, **S), "k": typ("string")}),
        obj({"o": obj({"x": typ("string")})}),
        obj({"o": obj({"x": typ("string")}, **S), "k": typ("string")}, **S),
    ),
    "array merges its items, container unmarked": (
        typ("array", items=obj({"a": typ("string")})), typ("array", items=obj({"a": typ("string"), "b": typ("null")})),
        typ("array", items=obj({"a": typ("string"), "b": typ("null", **S)}, **S)),
    ),
    "empty items are not learned": (
        typ("array", items={}), typ("array", items=obj({"a": typ("string")})), typ("array", items={}),
    ),
    "conflict keeps the baseline and notes the sample": (
        obj({"a": obj({"b": typ("string")})}), obj({"a": typ("string")}),
        obj({"a": obj({"b": typ("string")}, **{
            "x-contract-sampled-type": "string", "x-contract-note": "Static type: object, runtime sample saw: string"})}, **S),
    ),
    "conflict at the root": (
        obj({"a": typ("string")}), typ("array", items=typ("string")),
        obj({"a": typ("string")}, **{
            "x-contract-sampled-type": "array", "x-contract-note": "Static type: object, runtime sample saw: array"}),
    ),
    "same primitive: baseline wins": (
        obj({"a": typ("string", examples=["old"])}), obj({"a": typ("string")}), obj({"a": typ("string", examples=["old"])}, **S),
    ),
    "untyped baseline wins": (
        {"oneOf": [obj({"a": typ("string")}), obj({"b": typ("string")})]}, obj({"c": typ("string")}),
        {"oneOf": [obj({"a": typ("string")}), obj({"b": typ("string")})]},
    ),
    "untyped sample loses": (
        obj({"l": typ("array", items=typ("string"))}),
        obj({"l": typ("array", items={"oneOf": [typ("string"), typ("integer")]})}),
        obj({"l": typ("array", items=typ("string"))}, **S),
    ),
    "integer against number is a conflict": (
        obj({"a": typ("number")}), obj({"a": typ("integer")}),
        obj({"a": typ("number", **{
            "x-contract-sampled-type": "integer", "x-contract-note": "Static type: number, runtime sample saw: integer"})}, **S),
    ),
    "inherited names are ordinary fields": (
        obj({"constructor": typ("string")}), obj({"toString": typ("string")}),
        obj({"constructor": typ("string"), "toString": typ("string", **S)}, **S),
    ),
    "field called like an item marker": (
        obj({"[]": typ("unknown"), "oneOf#0": typ("string")}), obj({"[]": obj({"[]": typ("null")})}),
        obj({"[]": obj({"[]": typ("null", **S)}, **S), "oneOf#0": typ("string")}, **S),
    ),
    "not sampled at all: unchanged": (
        obj({"a": typ("string", **S)}, required=["a"], **S), None, obj({"a": typ("string", **S)}, required=["a"], **S),
    ),
}


@pytest.fixture(scope="module")
def sides(spark):
    def side(i):
        docs = [("o", "a", "GET", f"/{n}", "response", c[i]) for n, c in enumerate(CASES.values()) if c[i] is not None]
        return nodes_of(spark, docs).cache()

    return side(0), side(1)


def test_schema_documents_round_trip(spark, sides):
    for side, i in zip(sides, (0, 1)):
        found = documents(side)
        for n, case in enumerate(CASES.values()):
            if case[i] is not None:
                assert found[("GET", f"/{n}", "response")] == case[i]


def test_merge_decision_table(sides):
    found = documents(merge.merge_nodes(*sides))
    for n, (name, case) in enumerate(CASES.items()):
        assert found[("GET", f"/{n}", "response")] == case[2], name


def test_merge_without_observations_changes_nothing(sides):
    base, observed = sides
    assert rows(merge.merge_nodes(base, observed.limit(0))) == rows(base)


def test_two_merges_drop_static_fields(spark):
    """A static-only field survives the first merge, which marks the object, and falls to the second."""
    base = nodes_of(spark, {KEY: obj({"static": typ("string"), "seen": typ("string")})})
    sample = nodes_of(spark, {KEY: obj({"seen": typ("string")})})
    once = merge.merge_nodes(base, sample)
    twice = merge.merge_nodes(once, sample)
    assert documents(once)[KEY] == obj({"static": typ("string"), "seen": typ("string")}, **S)
    assert documents(twice)[KEY] == obj({"seen": typ("string")}, **S)


def test_field_summary(spark):
    base = nodes_of(spark, {
        ("GET", "/a", "response"): obj({"x": typ("string"), "gone": typ("string", **S)}),
        ("GET", "/b", "response"): typ("unknown"),
        ("GET", "/d", "response"): typ("string"),
    })
    seen = nodes_of(spark, {
        ("GET", "/a", "response"): obj({"x": typ("string"), "new": obj({"deep": typ("null")})}),
        ("GET", "/b", "response"): obj({"p": typ("string"), "q": typ("string")}),
        ("GET", "/c", "response"): obj({"r": typ("string")}),
        ("GET", "/d", "response"): obj({"s": typ("string")}),
    })
    assert rows(merge.field_summary(merge.plan_merge(base, seen)), "path", "name", "change") == [
        ("/a", "gone", "removed"), ("/a", "new", "new"), ("/b", "p", "new"), ("/b", "q", "new"), ("/c", "r", "new"),
    ]


def test_apply_only_when_the_field_set_changes(spark):
    base = nodes_of(spark, {
        ("GET", "/same", "response"): obj({"x": obj({"y": typ("string")})}),
        ("GET", "/new", "response"): obj({"x": typ("string")}),
        ("GET", "/list", "response"): typ("unknown"),
    })
    seen = nodes_of(spark, {
        ("GET", "/same", "response"): obj({"x": obj({"y": typ("string"), "nested": typ("string")})}),
        ("GET", "/new", "response"): obj({"x": typ("string"), "z": typ("null")}),
        ("GET", "/list", "response"): typ("array", items=typ("string")),
    })
    applied = documents(merge.apply_samples(base, seen))
    assert applied[("GET", "/same", "response")] == obj({"x": obj({"y": typ("string")})})
    assert applied[("GET", "/new", "response")] == obj({"x": typ("string"), "z": typ("null", **S)}, **S)
    assert applied[("GET", "/list", "response")] == typ("unknown")
    always = documents(merge.apply_samples(base, seen, apply="always"))
    assert always[("GET", "/list", "response")] == typ("array", items=typ("string"), **S)
    assert "nested" in always[("GET", "/same", "response")]["properties"]["x"]["properties"]


def test_options(spark):
    base = nodes_of(spark, {KEY: obj({"n": typ("number"), "l": typ("array", items={})})})
    seen = nodes_of(spark, {KEY: obj({"n": typ("integer"), "l": typ("array", items=typ("string"))})})
    merged = documents(merge.merge_nodes(base, seen, learn_empty_items=True, widen_numbers=True))[KEY]
    assert merged == obj({"n": typ("number"), "l": typ("array", items=typ("string", **S))}, **S)
    conflicts = merge.type_conflicts(merge.merge_nodes(base, seen))
    assert rows(conflicts, "node_path", "type", "sampled_type") == [(["n"], "number", "integer")]


def test_carry_forward_and_accept(spark):
    endpoints = [("GET", f"/{p}", [200], None) for p in "abcd"]
    known, unknown = obj({"k": typ("string")}), typ("unknown")
    scanned = contract_of(spark, endpoints, {
        ("GET", "/a", "response"): unknown, ("GET", "/b", "response"): obj({"fresh": typ("string")}),
        ("GET", "/c", "response"): unknown, ("GET", "/a", "query"): obj({"q": typ("string")}),
    })
    baseline = contract_of(spark, endpoints, {
        ("GET", "/a", "response"): known, ("GET", "/b", "response"): known,
        ("GET", "/c", "response"): unknown, ("GET", "/d", "response"): known,
    })
    carried = merge.carry_forward(scanned, baseline)
    found = documents(carried.nodes)
    assert found[("GET", "/a", "response")] == known
    assert found[("GET", "/b", "response")] == obj({"fresh": typ("string")})
    assert found[("GET", "/c", "response")] == unknown
    assert found[("GET", "/d", "response")] == known
    assert found[("GET", "/a", "query")] == obj({"q": typ("string")})

    runtime = nodes_of(spark, {("GET", "/b", "response"): obj({"live": typ("string")}, **S), ("GET", "/z", "response"): known})
    accepted = merge.accept(carried, runtime, endpoints_of(spark, [("GET", "/b", [], None), ("GET", "/z", [], None)]), 5)
    found = documents(accepted.nodes)
    assert found[("GET", "/b", "response")] == obj({"live": typ("string")}, **S)
    assert found[("GET", "/a", "response")] == known
    assert ("GET", "/z", "response") not in found
    assert {r.version for r in accepted.endpoints.collect()} == {5}


def test_a_mark_above_many_nodes_is_broadcast(spark):
    place = ["'o' AS owner", "'a' AS app", "'GET' AS method", "'/' AS path", "'response' AS location"]
    ids = spark.range(20_000).selectExpr(*place, "array(concat(id, sha2(string(id), 256))) AS node_path", "'p' AS trail", "'string' AS type", "cast(null as string) AS source")
    root = spark.range(1).selectExpr(*place, "cast(array() as array<string>) AS node_path", "'' AS trail", "'object' AS type", "'sampled' AS source")
    nodes = as_nodes(ids.unionByName(root))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        plan = merge.plan_merge(nodes, nodes)
        assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.where("winner = 'b'").count() == 20_001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_steps_and_marks_move_without_texts(spark):
    def schema(kind):
        return nodes_of(spark, {("GET", "/a", "response"): obj({"x": obj({"y": typ(kind)}), "z": typ("string")})})

    plan = merge.plan_merge(schema("string"), schema("integer"))
    joins = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 2
    assert not any(re.search(r"\b(owner|app|method|path|prefix|node_path)#", line) for line in joins)
    assert rows(merge.merged_nodes(plan), "name", "type", "sampled_type") == [
        ("x", "object", None), ("y", "string", "integer"), ("z", "string", None), (None, "object", None),
    ]
