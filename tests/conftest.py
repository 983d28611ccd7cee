import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftspark.model import NODES_DDL, ENDPOINTS_DDL, Contract, as_nodes, schema_to_nodes  # noqa: E402
from driftspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", 4, warehouse=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield session
    session.stop()


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def nodes_of(spark, docs, annotations="x-contract"):
    """docs: {(method, path, location): schema dict} or list of (owner, app, method, path, location, dict)."""
    if isinstance(docs, dict):
        docs = [("o", "a", *key, doc) for key, doc in docs.items()]
    ddl = "owner string, app string, method string, path string, location string, doc string"
    raw = spark.createDataFrame([(*d[:5], json.dumps(d[5])) for d in docs], ddl)
    parsed = raw.selectExpr("owner", "app", "method", "path", "location", "parse_json(doc) as schema")
    nodes = as_nodes(
        schema_to_nodes(parsed, ["owner", "app", "method", "path", "location"], annotations=annotations, levels=5)
    )
    return spark.createDataFrame(nodes.collect(), NODES_DDL)


def endpoints_of(spark, items):
    """items: (method, path, codes, description) with owner o and app a; duplicates are numbered from 0."""
    seen = {}
    data = []
    for m, p, codes, text in items:
        ordinal = seen[(m, p)] = seen.get((m, p), -1) + 1
        data.append(("o", "a", 1, ordinal, m, p, None, None, list(codes), text))
    return spark.createDataFrame(data, ENDPOINTS_DDL)


def contract_of(spark, endpoints, docs):
    nodes = nodes_of(spark, docs) if docs else spark.createDataFrame([], NODES_DDL)
    return Contract(endpoints_of(spark, endpoints), nodes)


def obj(properties=None, required=None, **more):
    out = {"type": "object", "properties": properties or {}}
    if required:
        out["required"] = required
    return {**out, **more}


def typ(name, **more):
    return {"type": name, **more}
