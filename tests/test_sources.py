import json
import re

import pytest
from conftest import endpoints_of, nodes_of, obj, rows, typ
from pyspark.sql import functions as F

from driftspark.model import Contract
from driftspark.session import dealt
from driftspark.sources import corpus, payloads, snapshots

DOC = {
    "schemaSyncVersion": "0.1.0", "generatedAt": "2024-05-01T10:00:00.000Z", "projectRoot": "/home/me/app", "stack": "nextjs-app-router",
    "endpoints": [
        {"path": "/api/u/[id]", "method": "GET", "sourceFile": "app/api/u/[id]/route.ts",
         "pathParams": obj({"id": typ("string")}, ["id"]),
         "responseSchema": obj({"a": typ("array", items={"oneOf": [typ("string"), obj({"b \"q\"": typ("number", examples=[1.5])})]})}, **{"x-contract-source": "sampled"}),
         "statusCodes": [200, 404], "description": "Finds."},
        {"path": "/api/u", "method": "POST", "sourceFile": "app/api/u/route.ts", "requestSchema": typ("unknown", **{"x-contract-note": "n"}), "statusCodes": [201]},
    ],
}


def put(root, owner, app, version, text):
    folder = root / f"owner={owner}" / f"app={app}" / f"version={version}"
    folder.mkdir(parents=True)
    (folder / "contract.json").write_text(text)


def test_snapshot_round_trip(spark, tmp_path):
    put(tmp_path / "in", "me", "app", 1, json.dumps(DOC, indent=2))
    put(tmp_path / "in", "me", "app", 2, json.dumps({**DOC, "endpoints": []}))
    put(tmp_path / "in", "me", "bad", 1, "{ not json")
    put(tmp_path / "in", "me", "none", 1, "{}")
    documents = snapshots.read_document_files(spark, str(tmp_path / "in"))
    assert rows(snapshots.unreadable(documents), "app", "reason") == [("bad", "not JSON"), ("none", "no endpoints")]
    contracts = snapshots.contracts_table(documents)
    assert rows(contracts, "app", "version", "endpoint_count") == [("app", 1, 2), ("app", 2, 0)]
    first = snapshots.contract_as_of(contracts, snapshots.to_contract(documents, levels=6), 1)
    assert rows(first.endpoints, "ordinal", "method", "status_codes", "description") == [(0, "GET", [200, 404], "Finds."), (1, "POST", [201], None)]
    snapshots.write_tables(first, str(tmp_path / "tables"))
    again = snapshots.read_tables(spark, str(tmp_path / "tables"))
    assert rows(again.nodes.select(sorted(again.nodes.columns))) == rows(first.nodes.select(sorted(first.nodes.columns)))
    heads = contracts.where("version = 1").withColumn("schema_version", F.lit("0.1.0"))
    exported = snapshots.to_documents(heads, again)
    assert json.loads(exported.first()["document"]) == DOC
    snapshots.write_documents(exported, str(tmp_path / "out"))
    copied = snapshots.read_documents(spark, str(tmp_path / "out"))
    assert rows(snapshots.contracts_table(copied), "owner", "app", "version", "endpoint_count") == [("me", "app", 1, 2)]


def test_annotations_of_any_prefix_and_required_names_without_a_property(spark, tmp_path):
    schema = obj({"a": typ("string", **{"x-learned-source": "sampled"})}, ["a", "b"])
    doc = {"schemaSyncVersion": "1", "generatedAt": "2024-05-01T10:00:00.000Z", "projectRoot": "/r", "stack": "s",
           "endpoints": [{"path": "/", "method": "GET", "responseSchema": schema, "statusCodes": [], "description": 'say "x-contract-'}]}
    put(tmp_path / "in", "me", "app", 1, json.dumps(doc))
    documents = snapshots.read_document_files(spark, str(tmp_path / "in"))
    contract = snapshots.to_contract(documents, levels=3)
    assert rows(contract.nodes, "name", "source", "required", "required_names") == sorted([(None, None, False, ["b"]), ("a", "sampled", True, None)], key=repr)
    again = snapshots.to_documents(snapshots.contracts_table(documents).withColumn("schema_version", F.lit("1")), contract).first()["document"]
    assert json.loads(again) == doc


def test_schema_deeper_than_the_levels_stops_the_job(spark, tmp_path):
    deep = typ("string")
    for _ in range(5):
        deep = obj({"a": deep})
    put(tmp_path, "me", "deep", 1, json.dumps({"endpoints": [{"path": "/", "method": "GET", "responseSchema": deep, "statusCodes": []}]}))
    documents = snapshots.read_document_files(spark, str(tmp_path))
    assert snapshots.to_contract(documents, levels=5).nodes.count() == 6
    with pytest.raises(Exception, match="nested deeper than 4"):
        snapshots.to_contract(documents, levels=4).nodes.collect()


def test_as_of(spark):
    history = spark.createDataFrame([("o", "a", 1), ("o", "a", 4), ("o", "b", 3)], "owner string, app string, version bigint")
    assert rows(snapshots.as_of(history, 3)) == [("o", "a", 1), ("o", "b", 3)]
    wanted = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "c")], "owner string, app string")
    assert rows(snapshots.as_of_status(wanted, history, 2)) == sorted(
        [("o", "a", 1, "found"), ("o", "b", None, "missing"), ("o", "c", None, "missing")], key=repr)


def test_corpus(spark, tmp_path):
    root = tmp_path / "my code"
    for path in ("r1/app/api/u/[id]/route.ts", "r1/node_modules/x.js", "r1/a+b%20c.tsx", "r2/my code/z.js", "r2/.git/h.js", "r2/.next/k.js", "r2/notes.md"):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("line 1\nline 2 of " + path)
    found = rows(corpus.read_corpus(spark, str(root)))
    assert found == [(r, p, f"line 1\nline 2 of {r}/{p}") for r, p in [("r1", "a+b%20c.tsx"), ("r1", "app/api/u/[id]/route.ts"), ("r2", "my code/z.js")]]


def test_payload_eligibility(spark):
    js = "application/json; charset=utf-8"
    data = [
        ("GET", "/a", 200, js, "{}", {}), ("POST", "/a", 200, js, "{}", {}), ("DELETE", "/a/[id]/[x]", 200, js, "1", {"id": "1"}),
        ("GET", "/h", 200, "text/html", "<p>", {}), ("GET", "/n", 200, None, "{}", {}), ("GET", "/b", 200, js, "{oops", {}), ("GET", "/e", 500, js, '{"error": 1}', {}),
    ]
    df = spark.createDataFrame(data, "method string, path string, status int, content_type string, body string, params map<string,string>")
    found = rows(payloads.classify(df, params="params"), "method", "path", "outcome", "reason")
    assert found == sorted([
        ("GET", "/a", "sampled", None), ("POST", "/a", "skipped", "POST skipped (write methods are not sampled)"),
        ("DELETE", "/a/[id]/[x]", "skipped", "Path param(s) not provided: [x]"), ("GET", "/h", "failed", "Not JSON (content-type: text/html)"),
        ("GET", "/n", "failed", "Not JSON (content-type: none)"), ("GET", "/b", "failed", "Request failed: body is not valid JSON"), ("GET", "/e", "sampled", None),
    ], key=repr)
    assert rows(payloads.classify(df, include_writes=True, success_only=True).where("path in ('/e', '/a')"), "method", "path", "outcome") == [
        ("GET", "/a", "sampled"), ("GET", "/e", "skipped"), ("POST", "/a", "sampled")]


def test_sampling_targets(spark):
    endpoints = endpoints_of(spark, [("GET", "/s", [], None), ("GET", "/t", [], None)])
    nodes = nodes_of(spark, {("GET", "/s", "response"): obj(**{"x-contract-source": "sampled"}), ("GET", "/t", "response"): obj()})
    assert payloads.sampling_targets(endpoints, nodes).count() == 2
    assert rows(payloads.sampling_targets(endpoints, nodes, sampled_only=True), "path") == [("/s",)]


def test_tables_of_many_apps(spark, tmp_path):
    owners = [*(f"o{i}" for i in range(30)), "007", "", None]
    endpoints = spark.createDataFrame(
        [(owner, f"a{n % 3}", 1, n, "GET", f"/p{n}") for owner in owners for n in range(20)],
        "owner string, app string, version bigint, ordinal bigint, method string, path string",
    )
    nodes = endpoints.withColumn("node_path", F.array("path"))
    root = str(tmp_path / "t")
    for _ in range(2):
        snapshots.write_tables(Contract(endpoints, nodes), root)
    files = spark.read.parquet(f"{root}/nodes").select("owner", F.input_file_name().alias("file")).distinct()
    # Two writes of four ranges each: an app lies in one or two files of a write, never in one per path.
    assert files.groupBy("owner").count().agg(F.max("count")).first()[0] <= 4
    assert rows(snapshots.read_tables(spark, root).endpoints.select(endpoints.columns)) == rows(endpoints.union(endpoints))
    for owner in ("007", "", "o3", "nobody"):
        one = snapshots.read_tables(spark, root, owner)
        wanted = endpoints.where(F.col("owner") == owner)
        assert rows(one.endpoints.select(endpoints.columns)) == rows(wanted.union(wanted))
        plan = one.nodes._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", plan)


def shuffle_files(spark):
    """Shuffles whose files are still there."""
    return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def test_writes_give_their_shuffle_files_back(spark, tmp_path):
    endpoints = spark.range(40).selectExpr(
        "'o' AS owner", "concat('a', id % 3) AS app", "1L AS version", "id AS ordinal", "'GET' AS method", "concat('/p', id) AS path"
    )
    documents = endpoints.groupBy("owner", "app", "version").agg(F.max("path").alias("document"))
    before = shuffle_files(spark)
    snapshots.write_tables(Contract(endpoints, endpoints.withColumn("node_path", F.array("path"))), str(tmp_path / "t"))
    snapshots.write_documents(documents, str(tmp_path / "d"))
    assert shuffle_files(spark) <= before
    assert rows(spark.read.parquet(str(tmp_path / "d"))) == rows(documents)


def shuffles(df):
    """Shuffles of a result, without those that a plan uses again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|round)", plan))


def test_versions_of_apps_and_what_is_counted_in_them_move_once(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [("o", app, version, f"/{n}") for app, last in (("a", 3), ("b", 1), (None, 2)) for version in range(last + 1) for n in range(version + 1)]
        nodes = spark.createDataFrame(data + data[:2], "owner string, app string, version bigint, path string")
        heads = nodes.select("owner", "app", "version").distinct()
        kept = snapshots.contract_as_of(heads, Contract(nodes, nodes), 2).nodes
        assert rows(kept) == sorted([*[("o", "a", 2, f"/{n}") for n in range(3)], *[("o", "b", 1, f"/{n}") for n in range(2)]], key=repr)
        none = snapshots.contract_as_of(heads, Contract(nodes, nodes), -1).nodes
        assert none.count() == 0
        counted = kept.groupBy("owner", "app", "version").agg(F.countDistinct("path"))
        assert shuffles(counted) <= shuffles(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_nodes_of_a_document_move_once_and_what_it_holds_is_counted_in_place(spark, tmp_path):
    from driftspark.model import as_nodes, nodes_to_schema

    nested = obj({"a": obj({"b": typ("string"), "[]": typ("integer")}, ["b", "[]"]), "l": typ("array", items=obj({"c": typ("string")}, ["c"]))}, ["a", "gone"])
    docs = {("GET", "/", "response"): nested, ("GET", "/", "body"): obj({"x": typ("string")}, ["x"]), ("PUT", "/", "body"): typ("array")}
    nodes = nodes_of(spark, docs)
    written = nodes_to_schema(nodes)
    assert {(r.method, r.path, r.location): json.loads(r.schema) for r in written.collect()} == {
        **docs, ("GET", "/", "response"): {**nested, "required": ["a", "gone"], "properties": {
            **nested["properties"], "a": {**nested["properties"]["a"], "required": ["[]", "b"]}}},
        ("PUT", "/", "body"): {"type": "array", "items": {}},
    }
    assert shuffles(nodes_to_schema(nodes)) == 1
    # A null in the key of a schema: its required names are told to nobody, as before.
    nameless = nodes_to_schema(nodes.where("location = 'body' AND method = 'GET'").withColumn("owner", F.lit(None).cast("string")))
    assert [json.loads(r.schema) for r in nameless.collect()] == [obj({"x": typ("string")})]
    text = json.dumps({"endpoints": [{"path": "/", "method": "GET", "responseSchema": nested}]})
    documents = spark.createDataFrame([("o", f"a{n}", 1, text) for n in range(5)], "owner string, app string, version bigint, document string")
    snapshots.write_documents(documents, str(tmp_path / "d"))
    plain, keyed = (snapshots.to_contract(snapshots.read_documents(spark, str(tmp_path / "d"), k), levels=3).nodes for k in ((), ["owner", "app"]))
    assert rows(keyed) == rows(plain)
    assert shuffles(keyed.groupBy("owner", "app", "name").agg(F.count_distinct("path"))) == 1


def test_tables_of_one_large_task_are_dealt_out(spark, tmp_path):
    spark.range(30_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    moved = dealt(one)
    assert moved.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 5_000
    assert rows(moved) == [(i,) for i in sorted(range(30_000), key=lambda i: repr((i,)))]
    even = spark.range(0, 30_000, 1, 8)
    assert dealt(even) is even and dealt(one, counted=False) is one
