import re

import pytest
from conftest import Contract, contract_of, endpoints_of, nodes_of, obj, rows, typ
from pyspark.sql import functions as F

from driftspark.operators import diff, shapes

B, N, A = "breaking", "non-breaking", "additive"
ONE = typ("string")

# name: (location, old schema, new schema, [(class, field, message)])
TABLE = {
    "request schema added": ("body", None, obj({"a": ONE}), [(A, "body", "body schema added")]),
    "query schema added": ("query", None, obj({"a": ONE}), [(A, "query", "query schema added")]),
    "response schema added": ("response", None, obj({"a": ONE}), [(N, "response", "response schema added")]),
    "request schema removed": ("body", obj({"a": ONE}), None, [(B, "body", "body schema removed")]),
    "response schema removed": ("response", typ("string"), None, [(B, "response", "response schema removed")]),
    "field removed": ("response", obj({"a": ONE, "b": ONE}), obj({"a": ONE}), [(B, "response.b", 'Field "response.b" was removed')]),
    "field removed from body": ("body", obj({"b": ONE}), obj(), [(B, "body.b", 'Field "body.b" was removed')]),
    "type refined": ("response", obj({"a": typ("unknown")}), obj({"a": ONE}), [(N, "response.a", 'Field "response.a" type refined from unknown to string')]),
    "type lost": ("query", obj({"a": ONE}), obj({"a": typ("unknown")}), [(B, "query.a", 'Field "query.a" type changed from string to unknown')]),
    "type changed": ("body", obj({"a": typ("integer")}), obj({"a": typ("number")}), [(B, "body.a", 'Field "body.a" type changed from integer to number')]),
    "untyped old side": ("response", obj({"a": {"oneOf": [ONE]}}), obj({"a": ONE}), []),
    "untyped new side": ("response", obj({"a": ONE}), obj({"a": {}}), []),
    "optional field added to a request": ("body", obj(), obj({"a": ONE}), [(N, "body.a", 'Field "body.a" was added')]),
    "required field added to a request": ("body", obj(), obj({"a": ONE}, ["a"]), [(B, "body.a", 'Required field "body.a" was added to request body')]),
    "required field added to a query": ("query", obj(), obj({"a": ONE}, ["a"]), [(B, "query.a", 'Required field "query.a" was added to request body')]),
    "required field added to a response": ("response", obj(), obj({"a": ONE}, ["a"]), [(N, "response.a", 'Field "response.a" was added')]),
    "required to optional": ("body", obj({"a": ONE}, ["a"]), obj({"a": ONE}), [(N, "body.a", 'Field "body.a" changed from required to optional')]),
    "required to optional in a response": ("response", obj({"a": ONE}, ["a"]), obj({"a": ONE}), [(N, "response.a", 'Field "response.a" changed from required to optional')]),
    "optional to required in a request": ("query", obj({"a": ONE}), obj({"a": ONE}, ["a"]), [(B, "query.a", 'Field "query.a" changed from optional to required in request body')]),
    "optional to required in a response": ("response", obj({"a": ONE}), obj({"a": ONE}, ["a"]), [(N, "response.a", 'Field "response.a" is now required in response')]),
    "required and type at once": ("body", obj({"a": ONE}), obj({"a": typ("number")}, ["a"]), [
        (B, "body.a", 'Field "body.a" changed from optional to required in request body'),
        (B, "body.a", 'Field "body.a" type changed from string to number')]),
    "required field removed": ("body", obj({"a": ONE}, ["a"]), obj(), [(B, "body.a", 'Field "body.a" was removed')]),
    "nested change is out of reach": ("response", obj({"a": obj({"b": ONE})}), obj({"a": obj()}), []),
    "one response becomes two": ("response", obj({"a": ONE}), {"oneOf": [obj({"a": ONE}), obj()]}, [(B, "response.a", 'Field "response.a" was removed')]),
    "object becomes array": ("response", obj({"a": ONE}), typ("array", items=obj({"a": ONE})), [(B, "response.a", 'Field "response.a" was removed')]),
    "path parameters are not compared": ("path", obj({"a": ONE}), obj({"b": ONE}), []),
    "inherited names": ("response", obj({"constructor": ONE}), obj({"toString": ONE}), [
        (B, "response.constructor", 'Field "response.constructor" was removed'), (N, "response.toString", 'Field "response.toString" was added')]),
    "key with a dot": ("response", obj({"a.b": ONE}), obj(), [(B, "response.a.b", 'Field "response.a.b" was removed')]),
    "no change": ("response", obj({"a": ONE}, ["a"]), obj({"a": ONE}, ["a"]), []),
}


@pytest.fixture(scope="module")
def sides(spark):
    endpoints = [("POST", f"/{i}", [200], None) for i in range(len(TABLE))]

    def side(k):
        docs = {("POST", f"/{i}", c[0]): c[k] for i, c in enumerate(TABLE.values()) if c[k] is not None}
        return contract_of(spark, endpoints, docs)

    return side(1), side(2)


def test_field_decision_table(sides):
    found = {}
    for r in diff.diff_contracts(*sides).collect():
        found.setdefault(r.path, []).append((r.change_type, r.field, r.message))
    for i, (name, case) in enumerate(TABLE.items()):
        assert sorted(found.get(f"/{i}", [])) == sorted(case[3]), name


def test_same_contract_has_no_changes(sides):
    assert diff.diff_contracts(sides[0], sides[0]).isEmpty()


def test_endpoints_status_and_description(spark):
    old = contract_of(spark, [("GET", "/gone", [200], None), ("GET", "/k", [200, 404, 404], "Old."), ("GET", "/t", [200], "T"), ("GET", "/u", [200], None)], {
        ("GET", "/gone", "response"): obj({"a": ONE})})
    new = contract_of(spark, [("GET", "/new", [200], None), ("GET", "/k", [201, 200], "New."), ("GET", "/t", [200], ""), ("GET", "/u", [200], None)], {
        ("GET", "/new", "response"): obj({"a": ONE})})
    assert rows(diff.diff_contracts(old, new), "change_type", "path", "field", "message") == sorted(
        [
            (B, "/gone", None, "Endpoint GET /gone was removed"), (N, "/new", None, "Endpoint GET /new was added"),
            (B, "/k", "statusCode.404", "Status code 404 was removed"), (N, "/k", "statusCode.201", "Status code 201 was added"),
            (A, "/k", "description", "Description updated"),
        ],
        key=repr,
    )
    forth = diff.endpoint_changes(old.endpoints, new.endpoints).where("kind = 'endpoint_added'").count()
    assert forth == diff.endpoint_changes(new.endpoints, old.endpoints).where("kind = 'endpoint_removed'").count()


def test_last_duplicate_wins(spark):
    endpoints = endpoints_of(spark, [("GET", "/d", [200], "first"), ("GET", "/d", [500], "second")])
    first = nodes_of(spark, {("GET", "/d", "response"): obj({"first": ONE})})
    second = nodes_of(spark, {("GET", "/d", "response"): obj({"second": ONE})}).selectExpr("* except (endpoint_ordinal)", "1L as endpoint_ordinal")
    one = diff.last_wins(Contract(endpoints, first.unionByName(second)))
    assert rows(one.endpoints, "description") == [("second",)]
    assert rows(one.nodes.where("depth = 1"), "name") == [("second",)]


def test_deeper_comparison_reports_the_topmost_difference(spark):
    endpoints = [("GET", "/x", [200], None)]
    key = ("GET", "/x", "response")
    old = contract_of(spark, endpoints, {key: obj({"a": obj({"b": obj({"c": ONE}), "k": ONE}), "l": typ("array", items=obj({"z": ONE}))})})
    new = contract_of(spark, endpoints, {key: obj({"a": obj({"k": typ("integer")}), "l": typ("array", items=obj({"z": ONE, "y": ONE}))})})
    assert rows(diff.diff_contracts(old, new, max_depth=9), "change_type", "field") == sorted(
        [(B, "response.a.b"), (B, "response.a.k"), (N, "response.l.[].y")], key=repr)
    assert diff.diff_contracts(old, new).isEmpty()
    widened = contract_of(spark, endpoints, {key: obj({"n": typ("number")})})
    narrow = contract_of(spark, endpoints, {key: obj({"n": typ("integer")})})
    assert diff.diff_contracts(narrow, widened, widen_numbers=True).isEmpty()


def test_report_and_gate(spark):
    changes = spark.createDataFrame(
        [("o", "bad", B), ("o", "bad", N), ("o", "fine", N), ("o", "fine", A), ("o", "fine", A)], "owner string, app string, change_type string")
    apps = spark.createDataFrame([("o", "bad"), ("o", "fine"), ("o", "quiet")], "owner string, app string")
    assert rows(diff.report(changes, apps)) == [
        ("o", "bad", 1, 1, 0, True), ("o", "fine", 0, 1, 2, False), ("o", "quiet", 0, 0, 0, False)]


def test_required_names_without_a_property(spark):
    old = contract_of(spark, [("POST", "/x", [200], None)], {("POST", "/x", "body"): obj({"a": typ("string"), "k": typ("string")}, ["b"])})
    new = contract_of(spark, [("POST", "/x", [200], None)], {("POST", "/x", "body"): obj({"b": typ("string"), "k": typ("string")}, ["a"])})
    found = rows(diff.field_changes(old, new), "kind", "field")
    assert found == [("field_added", "body.b"), ("field_removed", "body.a"), ("now_optional", "body.b"), ("now_required", "body.a")]


# --- structural hashes and alternatives ---------------------------------------------------------------


def response(spark, *schemas):
    return nodes_of(spark, {("GET", f"/{i}", "response"): s for i, s in enumerate(schemas)})


def test_hashes_ignore_order_and_notes_but_nothing_else(spark):
    a, b = obj({"x": ONE, "y": typ("array", items=obj({"z": ONE}, ["z"]))}, ["x"]), typ("integer")
    same = [{"oneOf": [a, b]}, {"oneOf": [b, {**a, "x-contract-source": "sampled", "x-contract-note": "n"}]}]
    other = [
        {"oneOf": [a]}, {"oneOf": [a, b, b]}, obj({"oneOf#0": a, "oneOf#1": b}), {"oneOf": [a, typ("string")]},
        {"oneOf": [obj({"x": ONE, "y": typ("array", items=obj({"z": ONE}))}, ["x"]), b]}, {"oneOf": [{**a, "required": ["x", "none"]}, b]}, {},
    ]
    roots = shapes.subtree_hashes(response(spark, *same, *other)).where("size(node_path) = 0").collect()
    by_path = {int(r.path[1:]): r.subtree_hash for r in roots}
    assert by_path[0] == by_path[1] and len({by_path[i] for i in by_path if i != 1}) == len(other) + 1
    every = shapes.endpoint_shapes(response(spark, *same, *other), diff.COMPARED)
    kept = shapes.endpoint_shapes(None, diff.COMPARED, shapes.subtree_hashes(response(spark, *same, *other)))
    assert rows(every) == rows(kept)
    assert shapes.subtree_hashes(response(spark, a).limit(0)).count() == 0


def alternatives(spark, old, new, **options):
    endpoints = [("GET", f"/{i}", [200], None) for i in range(len(old))]
    side = lambda docs: contract_of(spark, endpoints, {("GET", f"/{i}", "response"): d for i, d in enumerate(docs)})
    found = diff.diff_contracts(side(old), side(new), alternatives=True, **options)
    return rows(found, "path", "change_type", "message")


def test_alternatives(spark):
    a, b, c = obj({"a": ONE}), obj({"e": ONE}), typ("array", items=ONE)
    old = [{"oneOf": [a, b]}, {"oneOf": [a, b]}, a, {"oneOf": [a, c]}, a, {"oneOf": [a, b]}]
    new = [{"oneOf": [b, a]}, {"oneOf": [c, a, b]}, {"oneOf": [a, b]}, a, obj({"a": typ("integer")}), {"oneOf": [a, obj({"e": typ("integer")})]}]
    assert alternatives(spark, old, new) == sorted([
        ("/1", B, 'Alternative array of "response" was added'), ("/2", B, 'Alternative object of "response" was added'),
        ("/3", N, 'Alternative array of "response" was removed'), ("/4", B, 'Field "response.a" type changed from string to integer'),
        ("/5", B, 'Alternative object of "response" was added'), ("/5", N, 'Alternative object of "response" was removed'),
    ])


def test_alternatives_below_the_root(spark):
    a, b = obj({"a": ONE}), typ("string")
    old, new = obj({"f": {"oneOf": [a, b]}, "g": ONE}), obj({"f": {"oneOf": [b, typ("integer"), a]}, "h": ONE})
    assert alternatives(spark, [old], [new], max_depth=3) == sorted([
        ("/0", B, 'Alternative integer of "response.f" was added'), ("/0", B, 'Field "response.g" was removed'), ("/0", N, 'Field "response.h" was added'),
    ])


def test_few_changed_endpoints_and_stored_hashes_give_the_same(spark):
    old = contract_of(spark, [("GET", f"/{i}", [200], None) for i in range(9)], {("GET", f"/{i}", "response"): obj({"a": ONE, "b": obj({"c": ONE})}) for i in range(9)})
    docs = {("GET", f"/{i}", "response"): obj({"a": ONE, "b": obj({"c": ONE})}) for i in range(8)}
    new = contract_of(spark, [("GET", f"/{i}", [200], None) for i in range(9)], {**docs, ("GET", "/8", "response"): obj({"b": obj()})})
    want = [("/8", 'Field "response.a" was removed'), ("/8", 'Field "response.b.c" was removed')]
    kept = [Contract(c.endpoints, c.nodes, shapes.subtree_hashes(c.nodes)) for c in (old, new)]
    for sides in ((old, new), kept):
        assert rows(diff.diff_contracts(*sides, max_depth=2), "path", "message") == want
        assert rows(diff.diff_contracts(*sides), "path", "message") == want[:1]


def test_alternatives_are_hashed_once(spark, monkeypatch):
    either = {"oneOf": [typ("string"), obj({"a": ONE})]}
    old, new = (contract_of(spark, [("GET", "/", [200], None)], {("GET", "/", "response"): doc}) for doc in (either, typ("string")))
    given, made = [], []
    shaped, hashed = shapes.endpoint_shapes, shapes.subtree_hashes
    monkeypatch.setattr(shapes, "endpoint_shapes", lambda nodes, at, hashes=None, deepest=None: given.append(hashes) or shaped(nodes, at, hashes, deepest))
    monkeypatch.setattr(shapes, "subtree_hashes", lambda nodes: made.append(nodes) or hashed(nodes))
    assert rows(diff.field_changes(old, new, alternatives=True), "kind", "change_type") == [("alternative_removed", N)]
    assert len(made) == 2 and len(given) == 2 and None not in given


def test_alternatives_meet_once_at_the_node_that_offers_them(spark):
    a, b = obj({"a": ONE}), typ("integer")
    docs = [({"oneOf": [a, b]}, a), (obj({"x": {"oneOf": [a, b, {}]}}), obj({"x": {"oneOf": [b, a]}})), (a, obj({"a": typ("integer")}))]
    old, new = (contract_of(spark, [("GET", f"/{i}", [200], None) for i in range(3)], {("GET", f"/{i}", "response"): d[k] for i, d in enumerate(docs)}) for k in (0, 1))
    want = sorted([("/0", "response", "alternative_removed"), ("/1", "response.x", "alternative_removed"), ("/2", "response.a", "type_changed")])
    found = diff.field_changes(old, new, alternatives=True)
    assert rows(found, "path", "field", "kind") == want
    # Nodes and hashes are not joined again: what is left are joins of changes.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 5
    stored = [Contract(c.endpoints, c.nodes, shapes.subtree_hashes(c.nodes)) for c in (old, new)]
    assert rows(diff.field_changes(*stored, alternatives=True), "path", "field", "kind") == want
    twice = [Contract(c.endpoints, c.nodes.union(c.nodes)) for c in (old, new)]
    repeated = diff.field_changes(*twice, alternatives=True).where("kind LIKE 'alternative%'")
    assert rows(repeated, "path", "field", "kind") == want[:2]
    assert rows(repeated, "message") == [('Alternative integer of "response" was removed',), ('Alternative untyped of "response.x" was removed',)]


def test_nodes_move_with_hashes_of_their_endpoint(spark):
    def version(kind):
        return contract_of(spark, [("GET", "/a", [200], None)], {("GET", "/a", "response"): obj({"x": typ(kind)})})

    changes = diff.field_changes(version("string"), version("integer"))
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    outer = [line for line in plan.splitlines() if "Join FullOuter" in line]
    assert len(outer) == 1 and "key1" in outer[0]
    assert not re.search(r"\b(owner|app|method|path)#", outer[0])
    assert rows(changes, "path", "field", "kind") == [("/a", "response.x", "type_changed")]


def test_a_key_with_a_null_part_has_no_hashes(spark):
    from driftspark.model import key_hashes

    texts = spark.createDataFrame([("a", None), (None, "a"), ("a", "b"), ("ab", "")], "x string, y string")
    found = texts.select(*key_hashes("k", F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in found[:2]] == [(None, None)] * 2
    assert len({*found[2], *found[3]}) == 4
