import pytest
from conftest import contract_of, nodes_of, obj, rows, typ
from pyspark.sql import functions as F

from driftspark.operators import registry


@pytest.fixture(scope="module")
def published(spark):
    data = [("ann", "Shop", 1, "nextjs-hybrid"), ("ann", "Shop", 3, "nextjs-app-router"), ("ann", "blog", 1, "nextjs-hybrid"), ("bob", "shopping", 2, "nextjs-app-router")]
    data += [("zed", f"s{i:02}", 1, "nextjs-hybrid") for i in range(60)]
    return spark.createDataFrame(data, "owner string, app string, version bigint, stack string")


def test_current_and_lookup(published):
    assert rows(registry.lookup(published, "ann", "Shop"), "version") == [(3,)]
    assert registry.current(published).count() == 63


@pytest.mark.parametrize("query, stack, expected", [
    ("SHOP", None, ["ann/Shop", "bob/shopping"]), ("n/", None, ["ann/Shop", "ann/blog"]), ("shop", "nextjs-app-router", ["ann/Shop", "bob/shopping"]), ("blog", "nextjs-app-router", []),
])
def test_search(published, query, stack, expected):
    assert [r.slug for r in registry.search(published, query, stack).collect()] == expected


def test_search_limits(published):
    assert registry.search(published).count() == 10
    assert registry.search(published, limit=500).count() == 50
    assert registry.search(published, limit=500).first()["matches"] == 63
    assert registry.search(published, limit=None, most=None).count() == 63


def test_names(spark):
    paths = ["/api/users/[id]", "/api//x/[...rest]", "plain", "/", "/_a_/b"]
    df = spark.createDataFrame([("GET", p) for p in paths], "method string, path string")
    names = [r[0] for r in df.select(registry.tool_name(F.col("method"), F.col("path"))).collect()]
    assert names == ["get_api_users_id", "get_api_x_...rest", "get_plain", "get_", "get__a_b"]
    df = spark.createDataFrame([(None, None, "/home/me/app"), ("f", "c", "/r"), (None, "c", "/r"), (None, None, "")], "a string, b string, c string")
    named = [r[0] for r in df.select(registry.published_name(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert named == ["app", "f", "c", "my-app"]


def test_tools(spark):
    contract = contract_of(spark, [("GET", "/users/[id]", [], None), ("GET", "/users/id", [], "Find."), ("POST", "/users", [], None)], {})
    assert rows(registry.tools(contract.endpoints), "path", "tool", "description", "name_count") == [
        ("/users", "post_users", "POST /users", 1), ("/users/[id]", "get_users_id", "GET /users/[id]", 2), ("/users/id", "get_users_id", "Find.", 2)]


def test_tool_inputs(spark):
    nodes = nodes_of(spark, {
        ("PUT", "/u/[id]", "path"): obj({"id": typ("string"), "x": typ("string")}, ["id", "x"]),
        ("PUT", "/u/[id]", "query"): obj({"x": typ("integer"), "q": typ("string")}, ["q"]),
        ("PUT", "/u/[id]", "body"): obj({"x": typ("boolean"), "b": typ("object"), "c": typ("null")}, ["b"]),
        ("PUT", "/u/[id]", "response"): obj({"r": typ("string")}),
        ("POST", "/o", "body"): typ("unknown", properties={"hidden": typ("string")}),
        ("POST", "/o", "query"): obj({"q": typ("string")}),
    })
    assert rows(registry.tool_inputs(nodes), "path", "name", "type", "required") == [
        ("/o", "q", "string", False), ("/u/[id]", "b", "object", True), ("/u/[id]", "c", "null", False),
        ("/u/[id]", "id", "string", True), ("/u/[id]", "q", "string", False), ("/u/[id]", "x", "boolean", True)]


def test_tool_schemas(spark):
    nodes = nodes_of(spark, {
        ("PUT", "/u", "query"): obj({"x": typ("integer")}),
        ("PUT", "/u", "body"): obj({"x": obj({"y": typ("array", items=typ("string"))}, ["y"]), "z": typ("string")}, ["z"]),
    })
    import json
    found = {r["name"]: (json.loads(r["schema"]), r["required"]) for r in registry.tool_schemas(nodes).collect()}
    assert found == {"x": (obj({"y": typ("array", items=typ("string"))}, ["y"]), False), "z": (typ("string"), True)}
