import re

import pytest
from conftest import rows

from driftspark.model import CHANGES_DDL, SOURCE_FILES_DDL
from driftspark.operators import impact
from driftspark.session import shared_folder

FILES = [
    ("o/a", "src/one.ts", "const x = data.name;\n\tuse(nameOf, name_1);\r\n  name  name \n$ref a-b a-bc x.$ref"),
    ("o/a", "src/two.tsx", "\n\nuser-id and user-ids; my user-id\n" + "name\n" * 20),
    ("o/a", "app/api/x.ts", "name"), ("o/a", "web/pages/api/y.ts", "name"), ("o/a", "dist/z.js", "name"),
    ("o/a", "x/.next/z.js", "name"), ("o/a", "README.md", "name"), ("o/a", "builder/ok.jsx", "é name é" + "y" * 200),
    ("o/b", "src/other.js", "name a.b aXb\nName"),
]
FIELDS = [("o/a", f) for f in ("name", "user-id", "$ref", "a-b", "nope", "é", "ref")] + [("o/b", "a.b"), ("o/b", "name")]


def brute_force():
    out = []
    word = "[A-Za-z0-9_]"
    for repo, path, content in FILES:
        if not re.search(r"\.(ts|tsx|js|jsx)$", path) or "app/api" in path or "pages/api" in path:
            continue
        if set(path.split("/")[:-1]) & {"node_modules", "dist", ".git", ".next", "build", "out", ".turbo"}:
            continue
        for i, line in enumerate(content.split("\n")):
            for r, field in FIELDS:
                if r == repo and re.search(r"\b" + re.escape(field) + r"\b", line, re.ASCII):
                    out.append((repo, field, path, i + 1, line.strip()[:120]))
    assert word
    return sorted(set(out))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(FILES, SOURCE_FILES_DDL), spark.createDataFrame(FIELDS, "repo string, field string")


@pytest.mark.parametrize("threshold", ["10m", "-1"], ids=["broadcast", "merge join"])
def test_lines_match_brute_force(spark, tables, threshold):
    files, fields = tables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert rows(impact.consumer_lines(files, fields, 120)) == sorted(brute_force(), key=repr)
        whole = impact.consumer_refs(files, fields, limit=None, max_text=None)
        assert rows(whole, "repo", "field", "file", "line") == sorted((r[:4] for r in brute_force()), key=repr)
        assert max(len(r.text) for r in whole.collect()) > 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_at_most_twelve_in_file_order(tables):
    files, fields = tables
    refs = impact.consumer_refs(files, fields)
    expected = [r for r in brute_force() if r[:2] == ("o/a", "name")]
    expected = sorted(expected, key=lambda r: (r[2], r[3]))[:12]
    total = len([r for r in brute_force() if r[:2] == ("o/a", "name")])
    assert total > 12
    assert rows(refs.where("repo = 'o/a' and field = 'name'")) == sorted((r + (total,) for r in expected), key=repr)
    assert "WindowGroupLimit" in refs._jdf.queryExecution().toString()


def test_impact_table(tables):
    files, fields = tables
    found = {(r.repo, r.field): r for r in impact.impact_table(fields, impact.consumer_refs(files, fields)).collect()}
    assert found[("o/a", "nope")].listing == "none found" and found[("o/a", "nope")].references == 0
    assert found[("o/b", "a.b")].listing == "  src/other.js:1  name a.b aXb"
    assert found[("o/a", "name")].references > 12 and found[("o/a", "name")].listing.count("\n") == 11


def test_broken_fields(spark):
    changes = spark.createDataFrame(
        [("o", "a", "GET", "/", "response.x", "breaking", "k", 'Field "response.x" was removed'),
         ("o", "a", "GET", "/", "response.x.y", "breaking", "k", 'Field "response.x.y" type changed from a to b'),
         ("o", "a", "GET", "/", "response.z", "non-breaking", "k", 'Field "response.z" was added'),
         ("o", "a", "GET", "/", "body.w", "breaking", "k", 'Field "body.w" was removed'),
         ("o", "a", "GET", "/", "response", "breaking", "k", "response schema removed")], CHANGES_DDL)
    assert rows(impact.broken_fields(changes), "field_name") == [("x",), ("x.y",)]


def test_listing_writes_no_texts_of_plain_names_and_counts_copies_of_a_file(spark):
    body = "const a = one;\n" + "filler;\n" * 5 + "two(one)"
    # A path that comes twice counts as before: each of its lines for every copy, with that copy's text.
    files = spark.createDataFrame(
        [("moved", "src/a.ts", body), ("moved", "src/b.ts", body), ("moved", "src/b.ts", body)], "repo string, rel_path string, content string"
    )
    fields = spark.createDataFrame([("moved", "one"), ("moved", "two"), ("moved", "two(one")], "repo string, field string")
    every = rows(impact.consumer_lines(files, fields, 120))
    listed = impact.consumer_refs(files, fields, limit=100)
    assert rows(listed.drop("total")) == every
    assert {(r["field"], r["total"]) for r in listed.collect()} == {("one", 10), ("two", 5), ("two(one", 5)}
    written = spark.read.parquet(f"{shared_folder(spark)}/references-*").where("repo = 'moved'")
    assert written.count() == 20 and written.where("field <> 'two(one' AND text IS NOT NULL").count() == 0
