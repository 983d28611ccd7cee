import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftspark.model import PAYLOADS_DDL, SOURCE_FILES_DDL, Contract
from driftspark.operators import diff
from driftspark.plans import workflows
from driftspark.session import settle

HEALTH = 'export async function GET() {{ return NextResponse.json({body}); }}'
FILES = [
    ("me/shop", "app/api/health/route.ts", HEALTH.format(body='{ status: "ok" }')),
    ("me/shop", "app/api/users/[id]/route.ts", "export async function GET(req) { return Response.json({}); }\nexport async function DELETE(req) { return Response.json({}, { status: 204 }); }"),
    ("me/shop", "web/view.tsx", "const s = health.status;\nshow(status, user.mail);"),
    ("me/shop", "web/other.ts", "nothing here"),
]


def table(spark, contract, version=1):
    stamp = F.lit(version).cast("bigint")
    return Contract(
        settle(contract.endpoints.withColumn("version", stamp), "e"), settle(contract.nodes.withColumn("version", stamp), "n")
    )


def payload(path, body, minute=0):
    return (dt.datetime(2024, 1, 1, 0, minute), "me", "shop", "GET", path, 200, "application/json", json.dumps(body))


@pytest.fixture(scope="module")
def start(spark):
    files = spark.createDataFrame(FILES, SOURCE_FILES_DDL)
    return files, table(spark, workflows.contract_of_corpus(files))


def run(spark, baseline, files, payloads):
    scanned = table(spark, workflows.contract_of_corpus(files))
    return workflows.check(baseline, scanned, spark.createDataFrame(payloads, PAYLOADS_DDL), files, next_version=2)


def test_first_payloads_fill_unknown_responses_and_later_ones_break(spark, start):
    files, baseline = start
    first = run(spark, baseline, files, [payload("/api/health", {"status": "ok"})])
    assert first.static_changes.isEmpty()
    assert rows(first.runtime_changes, "change_type", "message") == [("non-breaking", 'Field "response.status" was added')]
    assert rows(first.report, "app", "breaking", "failed") == [("shop", 0, False)]
    accepted = Contract(settle(first.accepted.endpoints, "e"), settle(first.accepted.nodes, "n"))

    second = run(spark, accepted, files, [payload("/api/health", {"alive": True})])
    assert second.static_changes.isEmpty()
    assert rows(second.runtime_changes, "change_type", "message") == [
        ("breaking", 'Field "response.status" was removed'), ("non-breaking", 'Field "response.alive" was added')]
    assert rows(second.report, "app", "breaking", "non_breaking", "failed") == [("shop", 1, 1, True)]
    assert rows(second.impact, "field", "references") == [("status", 2)]

    added = run(spark, accepted, files, [payload("/api/health", {"status": "ok", "version": "1"})])
    assert rows(added.report, "breaking", "failed") == [(0, False)]


def test_removed_handler_breaks(spark, start):
    files, baseline = start
    fewer = files.withColumn("content", F.regexp_replace("content", "export async function DELETE.*", ""))
    changes = diff.diff_contracts(baseline, table(spark, workflows.contract_of_corpus(fewer)))
    assert rows(changes, "change_type", "message") == [("breaking", "Endpoint DELETE /api/users/[id] was removed")]
    assert diff.diff_contracts(baseline, baseline).isEmpty()


def test_compare_with_a_version(spark, start):
    files, baseline = start
    contracts = spark.createDataFrame([("me", "shop", 1)], "owner string, app string, version bigint")
    changes, status = workflows.diff_with_version(contracts, baseline, 5, baseline)
    assert changes.isEmpty() and rows(status) == [("me", "shop", 1, "found")]
    changes, status = workflows.diff_with_version(contracts, baseline, 0, baseline)
    assert changes.isEmpty() and rows(status, "status") == [("missing",)]
