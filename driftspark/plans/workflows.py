"""The three end-to-end jobs: infer a contract, check it, compare with an earlier version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, Contract, as_nodes
from driftspark.session import settle
from driftspark.operators import diff, impact, infer, merge, routes
from driftspark.sources import payloads as log
from driftspark.sources import snapshots

UNTYPED = "response is typed from payloads"


def scan_order() -> Column:
    """The place of an endpoint's declaration in the scan, as a number.

    App routes come before Pages routes, files by path, methods of a file in order; of declarations of one
    endpoint the last one wins, so only the order within (owner, app, method, path) has to be right. Few files
    declare one endpoint, so the window never holds a large group.
    """
    same = Window.partitionBy("owner", "app", "method", "path")
    return F.row_number().over(same.orderBy(F.col("router_type") == "pages", "source_file", "position")).cast("bigint") - 1


def contract_of_corpus(files: DataFrame) -> Contract:
    """Contract found in a source corpus: owner and app are the two parts of ``repo`` (``owner/app``).

    Path and query schemas come from the text. Responses start as ``unknown`` and are filled by
    payloads.
    """
    # Endpoints and nodes both start from the inventory: settled, the corpus is read once.
    found = settle(routes.route_inventory(files), "inventory").select(
        F.substring_index("repo", "/", 1).alias("owner"),
        F.expr("substring(repo, locate('/', repo) + 1)").alias("app"),
        F.lit(0).cast("bigint").alias("version"),
        "method", "path", F.col("rel_path").alias("source_file"), "router_type", "status_codes", "description",
        "query_names", "note", "position",
    )
    found = found.withColumn("ordinal", scan_order())
    endpoints = found.drop("query_names", "note", "position")

    key = ["owner", "app", "version", "method", "path", F.col("ordinal").alias("endpoint_ordinal")]
    node = "struct<location:string,node_path:array<string>,trail:string,ordinal:int,type:string,required:boolean,note:string>"

    def one(location: str, node_path, trail: str, ordinal, kind, required, note=F.lit(None)):
        return F.struct(
            F.lit(location).alias("location"), node_path.cast("array<string>").alias("node_path"), F.lit(trail).alias("trail"),
            ordinal.cast("int").alias("ordinal"), kind.cast("string").alias("type"), required.alias("required"),
            note.cast("string").alias("note"),
        ).cast(node)

    no, zero, none = F.lit(False), F.lit(0), F.array()
    raw = F.regexp_extract_all("path", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    names = routes.path_parameter_names(F.col("path"))
    path_nodes = F.flatten(
        F.transform(
            raw,
            lambda r, i: F.when(
                r.startswith("..."),
                F.array(
                    one("path", F.array(F.get(names, i)), "p", i, F.lit("array"), F.lit(True)),
                    one("path", F.array(F.get(names, i), F.lit("[]")), "pi", zero, F.lit("string"), no),
                ),
            ).otherwise(F.array(one("path", F.array(F.get(names, i)), "p", i, F.lit("string"), F.lit(True)))),
        )
    )
    empty = F.array().cast(f"array<{node}>")
    root = lambda location, when: F.when(when, F.array(one(location, none, "", zero, F.lit("object"), no))).otherwise(empty)
    query_nodes = F.transform("query_names", lambda q, i: one("query", F.array(q), "p", i, F.lit("string"), no))
    response = F.array(
        one("response", none, "", zero, F.lit("unknown"), no, F.coalesce("note", F.lit(UNTYPED)))
    )
    rows = F.concat(
        root("path", F.size(raw) > 0), path_nodes, root("query", F.size("query_names") > 0), query_nodes, response
    )
    return Contract(endpoints, as_nodes(found.select(*key, F.explode(rows).alias("n")).select(
        "owner", "app", "version", "method", "path", "endpoint_ordinal", "n.*"
    )))


@dataclass(frozen=True)
class Check:
    static_changes: DataFrame
    runtime_changes: DataFrame
    report: DataFrame
    impact: DataFrame
    accepted: Contract


def check(
    baseline: Contract,
    scanned: Contract,
    payloads: DataFrame,
    files: DataFrame,
    next_version: int = 1,
    sampled_only: bool = False,
) -> Check:
    """Baseline against code and against payloads; both are compared with the same baseline.

    ``files`` carries ``repo`` as ``owner/app``, so that consumers are sought in the app's own code.
    """
    baseline, scanned = diff.last_wins(baseline), diff.last_wins(scanned)
    current = merge.carry_forward(scanned, baseline)
    static_changes = diff.diff_contracts(baseline, current, unique=True)

    targets = log.sampling_targets(baseline.endpoints, baseline.nodes, sampled_only)
    seen_types = settle(infer.observed_types(log.targeted(log.sampled(payloads), targets)), "types")
    observed = settle(infer.observed_nodes(seen_types), "observed")
    runtime_nodes = settle(merge.apply_samples(baseline.nodes, observed), "runtime")
    runtime = Contract(baseline.endpoints, runtime_nodes)
    runtime_changes = diff.field_changes(baseline, runtime)

    everything = settle(static_changes.unionByName(runtime_changes), "changes")
    apps = baseline.endpoints.select("owner", "app").distinct()
    broken = impact.broken_fields(everything).select(
        F.concat_ws("/", "owner", "app").alias("repo"), F.col("field_name").alias("field")
    )
    refs = impact.consumer_refs(files, broken)  # a bounded listing, with the full count in ``total``
    seen = observed.where("size(node_path) = 0").select(*ENDPOINT)
    accepted = merge.accept(current, runtime_nodes, seen, next_version)
    return Check(static_changes, runtime_changes, diff.report(everything, apps), impact.impact_table(broken, refs), accepted)


def diff_with_version(contracts: DataFrame, history: Contract, version: int, scanned: Contract) -> tuple[DataFrame, DataFrame]:
    """Changes of the scanned contract against a version, and the status of every scanned app.

    Apps that have no such version are reported as ``missing`` and left out of the changes.
    """
    status = snapshots.as_of_status(scanned.endpoints, contracts, version)
    found = status.where("status = 'found'").select("owner", "app")
    old = snapshots.contract_as_of(contracts, history, version)
    both = ["owner", "app"]
    new = Contract(
        scanned.endpoints.join(found, both, "left_semi"), scanned.nodes.join(found, both, "left_semi")
    )
    old = Contract(old.endpoints.join(found, both, "left_semi"), old.nodes.join(found, both, "left_semi"))
    return diff.diff_contracts(old, new), status
