"""Registered queries: every operator over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.functions.json_types import json_type
from driftspark.model import ENDPOINT, Contract, as_nodes
from driftspark.operators import diff, impact, infer, merge, registry, routes, shapes
from driftspark.plans import tables as T
from driftspark.session import configure, settle, shared_folder
from driftspark.sources import payloads as log
from driftspark.sources import snapshots
from driftspark.plans.workflows import contract_of_corpus
from driftspark.sources.corpus import outside, read_corpus
from driftspark.sources.observations import Observations
from driftspark.streaming.debounce import LateRows, debounce, debounce_hot_stream, debounce_stream
from driftspark.streaming.drift import DriftCheck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    QUERIES[run.__name__] = configured
    return configured


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def node_text() -> Column:
    return F.array_join("node_path", "/").alias("node")


# --- inference (I1-I5, S5, S6) --------------------------------------------------------------------


@query
def payload_type_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 on values of every kind, one per order."""
    value = (
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN cast(o_totalprice as string) WHEN '2' THEN concat('\"', o_orderstatus, '\"') "
        "WHEN '3' THEN concat(cast(o_orderkey as string), 'e', cast(o_custkey % 7 - 3 as string)) "
        "WHEN '4' THEN CASE o_orderstatus WHEN 'F' THEN 'null' WHEN 'O' THEN 'true' ELSE concat('[', cast(o_custkey as string), ']') END "
        "ELSE CASE o_orderstatus WHEN 'F' THEN '{}' WHEN 'O' THEN '{broken' ELSE concat(cast(o_orderkey as string), '.0') END END"
    )
    orders = T.table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS priority", f"{value} AS value")
    return orders.groupBy("priority", F.coalesce(json_type(F.col("value")), F.lit("unreadable")).alias("type")).agg(
        F.count(F.lit(1)).alias("samples")
    )


@query
def payload_field_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, I2, I5 ``union`` over all event payloads."""
    types = infer.observed_types(T.event_payloads(spark, sf_dir))
    return types.select(
        "path", node_text(), "type", "samples", stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_seen")).alias("last_seen")
    )


@query
def payload_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 from stored summaries: events in three batches that share all days, one of them run twice; a window of days."""
    payloads = T.event_payloads(spark, sf_dir)
    store = Observations(spark, f"{shared_folder(spark)}/observations-{uuid.uuid4().hex}")
    for batch in (0, 1, 2, 1):
        store.add(payloads.where(F.col("event_id") % 3 == batch), batch)
    return store.types("2024-01-08", "2024-01-21").select(
        "path", node_text(), "type", "samples", stamp(F.col("first_seen")).alias("first_seen"), stamp(F.col("last_seen")).alias("last_seen")
    )


@query
def payload_nested_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 with the depth cap and I3 on nested order payloads."""
    types = infer.observed_types(T.order_payloads(spark, sf_dir))
    return types.select("owner", "app", node_text(), "depth", "type", "samples")


@query
def payload_deep_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 on arrays nested deeper than one round of steps opens."""
    types = infer.observed_types(T.deep_payloads(spark, sf_dir))
    return types.select("path", "depth", "trail", "type", "samples")


@query
def payload_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every order as one array of mixed elements."""
    element = (
        "CASE l_returnflag WHEN 'R' THEN concat('\"', l_linestatus, '\"') WHEN 'A' THEN cast(l_quantity + l_tax as string) "
        "ELSE concat('{\"line\":', cast(l_linenumber as string), '}') END"
    )
    lines = T.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "struct(l_linenumber AS n, l_suppkey AS s, l_partkey AS p, l_quantity AS q, l_returnflag AS f, l_tax AS t) AS k", f"{element} AS e"
    )
    arrays = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("es"))
    bodies = arrays.select(
        F.lit("/lines").alias("path"), F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x.e), ","), F.lit("]")).alias("body"),
        F.lit(0).alias("ts"),
    )
    return infer.observed_types(bodies, keys=["path"]).select(node_text(), "trail", "type", "samples")


@query
def payload_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the least example per primitive."""
    types = infer.observed_types(T.order_payloads(spark, sf_dir), examples=True)
    return types.where("example is not null").select("owner", "app", node_text(), "type", "example")


@query
def payload_latest_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 ``latest``: schema of the newest payload per endpoint."""
    return infer.latest_schema(T.order_payloads(spark, sf_dir)).select(
        "owner", "app", stamp(F.col("ts")).alias("ts"), node_text(), "type"
    )


@query
def payload_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 over all event payloads."""
    return log.classify(T.event_payloads(spark, sf_dir)).groupBy("method", "path", "outcome", "reason").agg(
        F.count(F.lit(1)).alias("payloads")
    )


@query
def sample_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sampling gave for every endpoint of the events, and for one nobody calls."""
    payloads = T.event_payloads(spark, sf_dir)
    called = settle(payloads.select(*ENDPOINT).distinct(), "endpoints")
    endpoints = called.union(called.select("owner", "app", "method", F.concat("path", F.lit("/archive"))))
    types = settle(infer.observed_types(log.sampled(payloads)), "types")
    plan = merge.plan_merge(_event_baseline(called), infer.observed_nodes(types))
    status = log.sample_status(endpoints, payloads, merge.field_summary(plan))
    return status.select(
        "method", "path", "outcome", "reason", "status", F.array_join("new_fields", ",").alias("new_fields"),
        F.array_join("removed_fields", ",").alias("removed_fields"),
    )


@query
def sampling_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints whose response was sampled before."""
    nodes = T.part_nodes(spark, sf_dir, observed=False)
    endpoints = T.table(spark, sf_dir, "part").selectExpr(*T.payload_sql_list(T.ENDPOINT_OF_PART))
    return log.sampling_targets(endpoints, nodes, sampled_only=True)


# --- merge (M1-M10) -------------------------------------------------------------------------------


def _part_merge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return T.part_nodes(spark, sf_dir, observed=False), T.part_nodes(spark, sf_dir, observed=True)


_MERGED = ["owner", "app", "path", "type", "source", "sampled_type", "note"]


@query
def merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: merged response schema of every part endpoint."""
    return merge.merge_nodes(*_part_merge(spark, sf_dir)).select(*_MERGED, node_text())


@query
def merge_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples merged a second time: static fields of objects sampled meanwhile are dropped."""
    base, observed = _part_merge(spark, sf_dir)
    once = settle(merge.merge_nodes(base, observed), "merged")
    return merge.merge_nodes(once, observed).select(*_MERGED, node_text())


@query
def merge_wide_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 on an object keyed by ids: one mark, above as many properties as there are orders."""
    merged = merge.merge_nodes(T.wide_nodes(spark, sf_dir, observed=False), T.wide_nodes(spark, sf_dir, observed=True))
    return merged.select(*_MERGED, node_text())


@query
def sample_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: fields that sampling adds and removes, per endpoint."""
    return merge.field_summary(merge.plan_merge(*_part_merge(spark, sf_dir))).select("owner", "app", "path", "name", "change")


@query
def sample_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: response schemas after sampling, adopted only where the field set changed."""
    return merge.apply_samples(*_part_merge(spark, sf_dir)).select("owner", "app", "path", "type", "source", node_text())


def _known(source: str) -> tuple[str, str]:
    scanned = "CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'unknown' WHEN p_type = 'SMALL' THEN 'array' ELSE 'object' END"
    baseline = "CASE WHEN p_size < 10 THEN 'unknown' ELSE 'object' END"
    return (scanned, "p_type <> 'LARGE'") if source == "scanned" else (baseline, "p_size < 40")


def _root_contract(spark: SparkSession, sf_dir: str, source: str) -> Contract:
    kind, there = _known(source)
    parts = T.table(spark, sf_dir, "part").selectExpr(
        *T.payload_sql_list(T.ENDPOINT_OF_PART), "0 AS ordinal", "array(200) AS status_codes", "cast(null as string) AS description",
        "'' AS trail", "cast(array() as array<string>) AS node_path", "'response' AS location", f"{kind} AS type",
        f"'{source}' AS note", f"{there} AS there",
    )
    return Contract(parts.select(*ENDPOINT, "ordinal", "status_codes", "description"), as_nodes(parts.where("there")))


@query
def carry_forward_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown responses carried over, then sampled ones accepted as version 2."""
    scanned, baseline = _root_contract(spark, sf_dir, "scanned"), _root_contract(spark, sf_dir, "baseline")
    current = merge.carry_forward(scanned, baseline)
    sampled = T.table(spark, sf_dir, "part").where("p_size between 15 and 25").selectExpr(*T.payload_sql_list(T.ENDPOINT_OF_PART))
    runtime = baseline.nodes.withColumn("note", F.lit("runtime"))
    accepted = merge.accept(current, runtime, sampled, 2)
    return accepted.nodes.select("owner", "app", "path", "version", "type", "note")


# --- diff (D0-D15) --------------------------------------------------------------------------------


@query
def contract_diff_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2."""
    old, new = T.order_versions(spark, sf_dir)
    return diff.endpoint_changes(old.endpoints, new.endpoints).select(*ENDPOINT, "change_type", "kind", "message")


@query
def contract_diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3-D11."""
    return diff.field_changes(*T.order_versions(spark, sf_dir))


@query
def contract_diff_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3-D11 with alternatives told apart by structural hashes: reordered, widened and narrowed ones."""
    orders = T.contract_orders(spark, sf_dir)
    old, new = (T.alternative_contract(spark, sf_dir, new, orders) for new in (False, True))
    return diff.field_changes(old, new, alternatives=True)


@query
def contract_diff_stored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 between versions whose structural hashes are kept beside their nodes, where few endpoints changed."""
    old = T.order_contract(spark, sf_dir, new=True, everything=True)
    few = F.expr("location = 'response' AND name = 'status' AND substring(app, -1, 1) = '7'")
    new = Contract(old.endpoints, old.nodes.withColumn("type", F.when(few, "boolean").otherwise(F.col("type"))))
    kept = [Contract(c.endpoints, c.nodes, settle(shapes.subtree_hashes(c.nodes), "hashes")) for c in (old, new)]
    return diff.diff_contracts(*kept, unique=True).select(*ENDPOINT, "field", "change_type", "message")


@query
def contract_diff_status_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, D13."""
    old, new = T.order_versions(spark, sf_dir)
    return diff.status_and_description_changes(old.endpoints, new.endpoints)


@query
def duplicate_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line declares the endpoint of its part; the last line wins."""
    lines = T.table(spark, sf_dir, "lineitem").selectExpr(
        "'shop' AS owner", "'lines' AS app", "'GET' AS method", "concat('/api/parts/', cast(l_partkey as string)) AS path",
        "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS ordinal",
    )
    nodes = as_nodes(
        lines.selectExpr("*", "ordinal AS endpoint_ordinal", "'' AS trail", "cast(array() as array<string>) AS node_path", "'response' AS location", "'object' AS type")
    )
    last = diff.last_wins(Contract(lines, nodes))
    declared = last.nodes.groupBy(*ENDPOINT, "endpoint_ordinal").agg(F.count(F.lit(1)).alias("nodes"))
    return last.endpoints.join(declared, ENDPOINT).select("path", "ordinal", "endpoint_ordinal", (F.col("nodes") > 0).alias("has_nodes"))


@query
def corpus_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D0 on a scanned corpus: App files before Pages files, files by path; the last declaration counts."""
    contract = diff.last_wins(contract_of_corpus(T.duplicate_files(spark, sf_dir)))
    return contract.endpoints.select("owner", "app", "method", "path", "source_file", "router_type")


@query
def drift_report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per class and the verdict for every app."""
    old, new = T.order_versions(spark, sf_dir)
    return diff.report(diff.diff_contracts(old, new, unique=True), old.endpoints)


@query
def payload_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields of the order payloads changed between two periods, and is that breaking?"""
    payloads = T.order_payloads(spark, sf_dir)
    early = F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")
    # Before 1998 clients saw no tags; the column is cut from the text to make a first version.
    old = payloads.where(early).withColumn("body", F.regexp_replace("body", ',"tags":.*$', "}"))
    new = payloads.where(~early).withColumn("body", F.replace("body", F.lit('"customer":'), F.lit('"client":')))

    def contract(df: DataFrame, name: str) -> Contract:
        types = settle(infer.observed_types(df), name)
        nodes = infer.observed_nodes(types)
        return Contract(types.where("size(node_path) = 0").select(*ENDPOINT).distinct(), nodes)

    changes = diff.field_changes(contract(old, "early"), contract(new, "late"))
    return changes.select("owner", "app", "path", "field", "change_type", "message")


# --- routes (R1-R13, S4) --------------------------------------------------------------------------


@query
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files outside skipped directories, by path alone."""
    files = T.part_files(spark, sf_dir)
    kept = files.where(outside(F.col("rel_path"), ["node_modules", ".git", ".next"]))
    return kept.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("characters"))


@query
def corpus_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, one folder per language, and read as a source corpus."""
    root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    texts = T.table(spark, sf_dir, "documents").selectExpr("lang", "text")
    texts.write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(root)
    files = read_corpus(spark, root, ("txt",))
    lines = F.split("content", "\n", -1)
    return files.groupBy(F.replace("repo", F.lit("lang="), F.lit("")).alias("lang")).agg(
        F.sum(F.length("content")).alias("characters"),
        F.sum(F.size(lines) - 1).alias("lines"),
        F.sum(F.size(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("words"),
    )


@query
def repo_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1."""
    return routes.detect_stack(T.part_files(spark, sf_dir))


@query
def route_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route inventory."""
    return routes.route_inventory(T.part_files(spark, sf_dir)).select("repo", "rel_path", "path", "method", "router_type", "branching")


@query
def route_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7."""
    found = routes.route_inventory(T.part_files(spark, sf_dir)).select("repo", "path", "method")
    return routes.path_parameters(found).select("repo", "path", "method", "ordinal", "name", "type", "required")


@query
def route_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths filled with an ``id``; catch-all parameters stay open."""
    found = routes.route_inventory(T.part_files(spark, sf_dir)).select("repo", "path", "method")
    resolved = routes.resolve_paths(found, F.create_map(F.lit("id"), F.col("repo")))
    return resolved.select("repo", "path", "method", "resolved", F.array_join("missing", ",").alias("missing"))


@query
def source_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9-R12."""
    return routes.route_inventory(T.part_files(spark, sf_dir)).select(
        "repo", "path", "method", "inferability", "description", "note",
        F.array_join(F.array_sort("query_names"), ",").alias("query_names"),
        F.array_join(F.array_sort("status_codes"), ",").alias("status_codes"),
    )


@query
def handler_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9-R12 where comments, strings, templates and brackets look like signals."""
    return routes.route_inventory(T.handler_files(spark, sf_dir)).select(
        "repo", "path", "method", "inferability", "description", "note",
        F.array_join(F.array_sort("query_names"), ",").alias("query_names"),
        F.array_join(F.array_sort("status_codes"), ",").alias("status_codes"),
    )


# --- impact (C1-C4) -------------------------------------------------------------------------------


@query
def broken_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on the field changes of all orders."""
    changes = diff.field_changes(*T.order_versions(spark, sf_dir))
    return impact.broken_fields(changes).groupBy("owner", "field_name").agg(F.count(F.lit(1)).alias("changes"))


@query
def consumer_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words as broken fields, documents as source files; every reference."""
    refs = impact.consumer_refs(T.document_files(spark, sf_dir), T.benchmark_fields(spark, sf_dir), limit=None)
    return refs.select("repo", "field", "file", "line")


@query
def consumer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first references of each field, with the number of all."""
    return impact.consumer_refs(T.document_files(spark, sf_dir), T.benchmark_fields(spark, sf_dir))


@query
def impact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    fields = T.benchmark_fields(spark, sf_dir)
    return impact.impact_table(fields, impact.consumer_refs(T.document_files(spark, sf_dir), fields))


# --- snapshots and registry (S1-S3, G1-G6) --------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One published version per order: the app is the customer, versions are order keys."""
    return T.table(spark, sf_dir, "orders").selectExpr(
        "concat('user', cast(o_custkey % 97 as string)) AS owner", "concat('App-', cast(o_custkey as string)) AS app", "o_orderkey AS version",
        "CASE WHEN o_orderstatus = 'F' THEN 'nextjs-app-router' WHEN o_orderstatus = 'O' THEN 'nextjs-pages-router' ELSE 'nextjs-hybrid' END AS stack",
        "concat('/home/', o_orderpriority, '/app', cast(o_custkey as string)) AS project_root",
    )


@query
def contract_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the version of every app at a point of the history, and the apps that had none yet."""
    published = _published(spark, sf_dir)
    return snapshots.as_of_status(published, published, 3000).withColumn(
        "found_version", F.coalesce("found_version", F.lit(-1).cast("bigint"))
    )


@query
def payload_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 at the time of every payload: all events against the versions that one app had, hour by hour."""
    history = T.event_history(spark, sf_dir)
    endpoints = history.selectExpr("owner", "app", "version", T.inline(T.EVENT_ENDPOINTS))
    found = snapshots.undocumented(T.event_payloads(spark, sf_dir), history, endpoints)
    return found.select(
        "method", "path", F.coalesce("version", F.lit(-1).cast("bigint")).alias("version"), "status", "verdict", "calls",
        stamp(F.col("first_call")).alias("first_call"), stamp(F.col("last_call")).alias("last_call"),
    )


@query
def registry_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: current version and published name of every app."""
    current = registry.current(_published(spark, sf_dir))
    none = F.lit(None).cast("string")
    name = registry.published_name(F.when(F.col("stack") == "nextjs-hybrid", F.lower("app")), none, F.col("project_root"))
    return current.select("owner", "app", "version", "stack", name.alias("name"))


@query
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current apps of one stack whose slug matches."""
    found = registry.search(_published(spark, sf_dir), "R1", "nextjs-app-router", None, None)
    return found.select("slug", "version", "stack")


@query
def registry_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 as the interactive search shows it: at most 50, with the number of all matches."""
    found = registry.search(_published(spark, sf_dir), "R1", "nextjs-app-router", 200)
    return found.select("slug", "version", "stack", "matches")


@query
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    return registry.lookup(_published(spark, sf_dir), "user5", "App-5").select("owner", "app", "version", "stack")


@query
def tool_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 and G6 on the route inventory."""
    found = routes.route_inventory(T.part_files(spark, sf_dir))
    endpoints = found.select(F.lit("org").alias("owner"), F.col("repo").alias("app"), "method", "path", "description")
    return registry.tools(settle(endpoints, "endpoints")).select("app", "method", "path", "tool", "description", "name_count")


@query
def tool_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 on the contract of all orders."""
    inputs = registry.tool_inputs(T.order_contract(spark, sf_dir, new=True, everything=True).nodes)
    return inputs.select("owner", "app", "method", "path", "tool", "name", "type", "location", "required")


@query
def tool_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 with the whole schema of each input; customers of the body have a nested id."""
    nodes = T.order_contract(spark, sf_dir, new=True, everything=True).nodes
    customer = nodes.where("location = 'body' and name = 'customer'")
    nested = customer.withColumn("node_path", F.array(F.lit("customer"), F.lit("id"))).withColumn("trail", F.lit("pp")).withColumn(
        "name", F.lit("id")).withColumn("depth", F.lit(2)).withColumn("type", F.lit("string")).withColumn("required", F.lit(True))
    schemas = registry.tool_schemas(nodes.unionByName(nested))
    return schemas.select("owner", "app", "method", "path", "name", "location", "required", "schema")


@query
def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of every app written as tables in two versions, read back as a whole."""
    root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    orders = T.contract_orders(spark, sf_dir)
    for new in (False, True):
        contract = T.order_contract(spark, sf_dir, new=new, everything=True, orders=orders)
        version = F.lit(int(new)).cast("bigint")
        snapshots.write_tables(
            Contract(contract.endpoints.withColumn("version", version), contract.nodes.withColumn("version", version)), root
        )
    read = snapshots.read_tables(spark, root)
    kept = snapshots.contract_as_of(read.endpoints.select("owner", "app", "version").distinct(), read, 1)
    # An app has one version by now: with it in the key, rows stay where they met their version.
    return kept.nodes.groupBy("owner", "app", "version", "location", F.coalesce("name", F.lit("")).alias("name"), "type").agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("path").alias("endpoints")
    ).drop("version")


@query
def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of every app written as a JSON document, read back, and flattened again."""
    contract = T.order_contract(spark, sf_dir, new=True, everything=True)
    endpoints = contract.endpoints.withColumn("source_file", F.lit("a.ts")).withColumn("router_type", F.lit(None).cast("string"))
    nodes = contract.nodes.withColumn("source", F.when(F.col("name") == "total", "sampled")).withColumn(
        "required_names", F.when(F.expr("location = 'body' and size(node_path) = 0"), F.array(F.lit("nowhere")))
    )
    heads = endpoints.select("owner", "app").distinct().selectExpr(
        "owner", "app", "1L AS version", "timestamp '2024-01-01 00:00:00' AS generated_at", "'/r' AS project_root", "'nextjs-hybrid' AS stack",
        "'x-learned' AS annotations",
    )
    root = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    snapshots.write_documents(snapshots.to_documents(heads, Contract(endpoints, nodes)), root)
    # Texts are small beside the rows they hold, and what is counted is counted inside an app.
    documents = snapshots.read_documents(spark, root, ["owner", "app"])
    again = snapshots.to_contract(documents, levels=3).nodes
    return again.groupBy(
        "owner", "app", "location", F.coalesce("name", F.lit("")).alias("name"), "type", "required", "source",
        F.array_join("required_names", ",").alias("required_names"),
    ).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("path").alias("endpoints"))


# --- streaming (T1-T3) ----------------------------------------------------------------------------

QUIET_MICROS = 30 * 60 * 1_000_000
HOT_QUIET_MICROS = 5 * 60 * 1_000_000


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query
def debounced_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 on a table: bursts of events per user, half an hour of quiet between them."""
    return debounce(T.table(spark, sf_dir, "events"), ["user_id"], "ts", QUIET_MICROS)


@query
def debounced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 and T3 on a stream: bursts per user that the watermark has closed."""
    folder = f"{shared_folder(spark)}/bursts-{uuid.uuid4().hex}"
    bursts = debounce_stream(_event_stream(spark, sf_dir), ["user_id"], "ts", "30 minutes", "10 minutes")
    writer = bursts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    done = spark.read.schema(bursts.schema).parquet(f"{folder}/out")
    return done.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "events")


@query
def debounced_hot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 on a stream with five hot keys: bursts per event type, five minutes of quiet between them."""
    folder = f"{shared_folder(spark)}/hot-{uuid.uuid4().hex}"
    bursts = debounce_hot_stream(_event_stream(spark, sf_dir), ["event_type"], "ts", HOT_QUIET_MICROS)
    writer = bursts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(bursts.schema).parquet(f"{folder}/out")


@query
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come too late, for each of three batches of a stream."""
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    late = LateRows(spark, folder, "ts", 10 * 60 * 1_000_000)
    _three_batches(spark, sf_dir, folder, lambda stream: late.run(stream, f"{folder}/checkpoint"))
    return late.table().select("batch", "rows", "late", "watermark")


def _three_batches(spark: SparkSession, sf_dir: str, folder: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """All events as three batches of a stream: a third of the ids each, written and then taken up in one go."""
    events = T.table(spark, sf_dir, "events")
    for third in range(3):
        events.where(F.col("event_id") % 3 == third).write.mode("append").parquet(f"{folder}/input")
        run(spark.readStream.schema(events.schema).parquet(f"{folder}/input")).awaitTermination()


def _event_baseline(endpoints: DataFrame) -> DataFrame:
    event = F.element_at(F.split("path", "/"), -1)

    def node(name: str, kind: str, source: str | None = None) -> Column:
        return F.struct(F.lit(name).alias("n"), F.lit(kind).alias("type"), F.lit(source).cast("string").alias("source"))

    known = (
        F.when(event == "click", F.array(node("", "unknown")))
        .when(event == "view", F.array(node("", "object"), node("k", "integer"), node("gone", "string", "sampled")))
        .when(event == "purchase", F.array(node("", "object"), node("k", "string"), node("kept", "string")))
    )
    return as_nodes(endpoints.select(*ENDPOINT, F.explode(known).alias("x")).select(
        *ENDPOINT, "x.type", "x.source", F.lit("response").alias("location"),
        F.when(F.col("x.n") == "", F.array().cast("array<string>")).otherwise(F.array("x.n")).alias("node_path"),
        F.when(F.col("x.n") == "", "").otherwise("p").alias("trail"),
    ))


def _drift(spark: SparkSession, sf_dir: str) -> DriftCheck:
    folder = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    endpoints = settle(T.event_payloads(spark, sf_dir).select(*ENDPOINT).distinct(), "endpoints")
    files = T.table(spark, sf_dir, "documents").selectExpr(
        "'shop/tracker' AS repo", "concat('src/', cast(doc_id as string), '.ts') AS rel_path", "concat(source, ' gone ', lang) AS content"
    )
    check = DriftCheck(spark, folder, endpoints, files=files, compact_every=2).start_from(_event_baseline(endpoints))
    payload = T.payload_sql_list(T.EVENT_PAYLOAD)
    _three_batches(spark, sf_dir, folder, lambda stream: check.run(stream.selectExpr("ts", *payload), f"{folder}/checkpoint"))
    return check


@query
def continuous_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of a stream of event payloads, in three batches, against a baseline with one rule per event type."""
    return _drift(spark, sf_dir).changes().select("batch", "path", "field", "change_type", "kind", "message")


@query
def continuous_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and gate of each batch, the references of the fields it broke, and the baseline it left."""
    check = _drift(spark, sf_dir)
    left = check.baseline(3).groupBy().agg(F.count(F.lit(1)).alias("nodes"))
    reports = check.reports().join(
        check.broken().groupBy("batch").agg(F.sum("references").alias("references")), "batch", "left"
    )
    last = F.broadcast(left.select("nodes", F.lit(2).cast("bigint").alias("last")))  # one row
    return reports.join(last, F.col("batch") == F.col("last"), "left").select(
        "batch", "owner", "app", "breaking", "non_breaking", "additive", "failed",
        F.coalesce("references", F.lit(0)).cast("bigint").alias("references"), "nodes",
    )


def names() -> list[str]:
    return list(QUERIES)
