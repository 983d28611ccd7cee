"""Provenance-aware merge of a baseline with observed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, NODE, NODE_ATTRIBUTES, Contract, as_nodes, is_property, key_hashes, node_hash, parent_path, prefixes
from driftspark.session import settle

SAMPLED = "sampled"
_WHERE = [*ENDPOINT, "location"]


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(node_hash(), *NODE, F.struct(*NODE_ATTRIBUTES).alias(name))


def _place(name: str, path: str) -> list[Column]:
    """A place in a schema, told by hashes: steps and what they find move without texts. Null segments count."""
    return key_hashes(name, *[F.col(c) for c in [*_WHERE, path]], F.transform(path, lambda segment: segment.isNull()))


def _rule(learn_empty_items: bool, widen_numbers: bool) -> Column:
    b, o = F.col("b"), F.col("o")
    same_number = F.lit(False)
    if widen_numbers:
        same_number = b["type"].isin("integer", "number") & o["type"].isin("integer", "number")
    rule = (
        F.when(b.isNull(), "add")
        .when(o.isNull(), "base_only")
        .when(b["type"] == "unknown", "replace")
        .when((b["type"] == "object") & (o["type"] == "object"), "object")
        .when((b["type"] == "array") & (o["type"] == "array"), "array")
        .when(same_number, "keep")
        .when(b["type"] != o["type"], "conflict")
    )
    if learn_empty_items:
        learnable = (F.substring(b["trail"], -1, 1) == "i") & b["type"].isNull() & (F.col("b_alternatives") == 0)
        rule = rule.when(learnable, "replace")
    return rule.otherwise("keep")


def plan_merge(
    baseline: DataFrame, observed: DataFrame, learn_empty_items: bool = False, widen_numbers: bool = False
) -> DataFrame:
    """Both sides of every node, the side that wins (``winner``: b, o or none) and its marks.

    A node that is an object, or an array, on both sides is merged child by child. Any other node
    *stops* the descent, and its whole subtree follows the decision made there. Only stops that can
    have children, and objects that were sampled before, matter to other nodes. They are a table of marks, which
    the proper prefixes of every path meet in an equi-join on (endpoint, location, prefix): a mark with very many
    nodes below it is one row on one side, so the join can be split, and nothing is gathered per schema. What
    a node finds is folded per node, at most one value for each of its levels.
    The outer join is written once, as it is read for both sides of that join. In that join nodes and marks stand under
    hashes of their places (see :func:`driftspark.model.key_hashes`), so texts are moved with the nodes alone.
    """
    if learn_empty_items:
        options = (
            baseline.where("trail like '%o'")
            .groupBy(*_WHERE, parent_path(F.col("node_path")).alias("node_path"))
            .agg(F.count(F.lit(1)).alias("b_alternatives"))
        )
        b_side = _side(baseline, "b").join(options, NODE, "left").fillna(0, ["b_alternatives"])
    else:
        b_side = _side(baseline, "b")
    both = b_side.join(_side(observed, "o"), ["node_hash", *NODE], "full_outer")
    both = settle(both.withColumn("rule", _rule(learn_empty_items, widen_numbers)).drop("b_alternatives", "node_hash"), "both")

    def holds_children(side: str) -> Column:
        node = F.col(side)
        return node.isNotNull() & (node["type"].isin("object", "array") | node["type"].isNull())

    stops = ~F.col("rule").isin("object", "array")
    sampled_object = (F.col("rule") == "object") & F.coalesce(F.col("b.source") == SAMPLED, F.lit(False))
    marks = both.where((stops & (holds_children("b") | holds_children("o"))) | sampled_object).select(
        *_WHERE, F.col("node_path").alias("prefix"), stops.alias("stops"), F.size("node_path").alias("level"), "rule",
        F.coalesce("b.trail", "o.trail").alias("trail"), F.coalesce(F.col("b.source") == SAMPLED, F.lit(False)).alias("sampled"),
    )
    # Marks are written, so that Spark knows their true size: a few marks above very many nodes are broadcast, and the
    # nodes do not meet in the task of one key.
    mark, node = ["mark1", "mark2"], ["node1", "node2"]
    marks = settle(marks.select(*_place("mark", "prefix"), "stops", "level", "rule", "trail", "sampled"), "marks")
    placed = both.select(*_place("node", "node_path"), "*")
    steps = placed.select(*node, *_WHERE, F.explode(prefixes(F.col("node_path"))).alias("prefix")).select(*node, *_place("mark", "prefix"))
    above = steps.join(marks, mark).groupBy(*node).agg(
        F.min(F.when(F.col("stops"), F.struct("level", "rule", "trail", "sampled"))).alias("stop"),
        F.collect_list(F.when(~F.col("stops"), F.col("level"))).alias("sampled_levels"),
    )
    planned = placed.join(above, node, "left").select(*NODE, "b", "o", "rule", "stop", "sampled_levels")

    no_levels = F.array().cast("array<int>")
    sampled_levels = F.coalesce("sampled_levels", no_levels)

    def gone(trail: Column, level: Column, own_mark: Column) -> Column:
        """A baseline-only property is dropped when it, or the object around it, was sampled."""
        marked = own_mark | F.array_contains(sampled_levels, level - 1)
        return (level > 0) & is_property(trail) & marked

    b, o, stop, rule = F.col("b"), F.col("o"), F.col("stop"), F.col("rule")
    b_only_gone = gone(b["trail"], F.size("node_path"), F.coalesce(b["source"] == SAMPLED, F.lit(False)))
    items_only_observed = (rule == "add") & (F.substring(o["trail"], -1, 1) == "i")
    own = (
        F.when(items_only_observed, "empty")
        .when(rule.isin("add", "replace"), "o")
        .when((rule == "base_only") & b_only_gone, "none")
        .otherwise("b")
    )
    stop_adds = (stop["rule"] == "add") & (F.substring(stop["trail"], -1, 1) != "i")
    inherited = (
        F.when(stop_adds | (stop["rule"] == "replace"), F.when(o.isNotNull(), "o"))
        .when(stop["rule"] == "add", F.lit(None))
        .when((stop["rule"] == "base_only") & gone(stop["trail"], stop["level"], stop["sampled"]), F.lit(None))
        .when(b.isNotNull(), "b")
    )
    by_properties = F.length(F.translate(o["trail"], "p", "")) == F.length(F.translate(stop["trail"], "p", ""))
    marked = F.when(stop.isNull(), (own == "o") | (rule == "object")).otherwise(
        (stop["rule"] == "replace") & by_properties
    )
    return planned.select(
        *NODE, "b", "o",
        F.when(stop.isNull(), rule).alias("rule"),
        F.coalesce(F.when(stop.isNull(), own).otherwise(inherited), F.lit("none")).alias("winner"),
        F.coalesce(marked, F.lit(False)).alias("marked"),
    )


def merged_nodes(plan: DataFrame) -> DataFrame:
    """The merged schema (M1-M6) out of :func:`plan_merge`."""
    winner, rule = F.col("winner"), F.col("rule")
    # The note is a fixed text of the merge.
    conflict = F.coalesce((rule == "conflict") & (winner == "b"), F.lit(False))
    kept = plan.where("winner <> 'none'")
    chosen = F.when(winner == "b", F.col("b")).otherwise(F.col("o"))
    columns = {name: chosen[name] for name in NODE_ATTRIBUTES}
    blank = winner == "empty"
    columns["type"] = F.when(~blank, chosen["type"])
    columns["example"] = F.when(~blank, chosen["example"])
    columns["source"] = F.when(F.col("marked"), SAMPLED).when(~blank, chosen["source"])
    columns["sampled_type"] = F.when(conflict, F.col("o.type")).otherwise(chosen["sampled_type"])
    columns["note"] = F.when(
        conflict, F.format_string("Static type: %s, runtime sample saw: %s", F.col("b.type"), F.col("o.type"))
    ).otherwise(chosen["note"])
    return as_nodes(kept.select(*NODE, *[column.alias(name) for name, column in columns.items()]))


def merge_nodes(
    baseline: DataFrame, observed: DataFrame, learn_empty_items: bool = False, widen_numbers: bool = False
) -> DataFrame:
    return merged_nodes(plan_merge(baseline, observed, learn_empty_items, widen_numbers))


def field_summary(plan: DataFrame) -> DataFrame:
    """M7: top-level properties a merge adds or removes, one row each.

    An absent or unknown baseline makes every property new and none removed.
    """
    top = plan.where("size(node_path) = 1 and coalesce(b.trail, o.trail) = 'p'")
    change = F.when((F.col("winner") != "none") & F.col("b").isNull(), "new").when(
        (F.col("winner") == "none") & F.col("b").isNotNull(), "removed"
    )
    return top.select(*_WHERE, F.element_at("node_path", 1).alias("name"), change.alias("change")).where(
        "change is not null"
    )


def apply_samples(
    baseline: DataFrame, observed: DataFrame, apply: str = "changed", **options: bool
) -> DataFrame:
    """M8: take the merged schema only where the set of top-level fields changed.

    ``apply="always"`` also takes merges that only change nested or array schemas.
    """
    plan = plan_merge(baseline, observed, **options)
    if apply == "always":
        return merged_nodes(plan)
    plan = settle(plan, "plan")
    changed = settle(field_summary(plan).select(*_WHERE).distinct(), "changed")
    adopted = merged_nodes(plan.join(changed, _WHERE, "left_semi"))
    # The baseline's own rows are the ``b`` sides of the plan: nothing is read or joined again.
    rest = plan.where("b is not null").join(changed, _WHERE, "left_anti").select(*NODE, "b.*")
    return adopted.unionByName(as_nodes(rest))


def type_conflicts(merged: DataFrame) -> DataFrame:
    """Fields whose samples disagree with the baseline type; a merge alone never shows them as a change."""
    return merged.where("sampled_type is not null").select(*NODE, "type", "sampled_type", "note")


def response_known(nodes: DataFrame) -> DataFrame:
    """Endpoints whose response schema is present and not ``unknown``."""
    return nodes.where("location = 'response' and size(node_path) = 0 and not (type <=> 'unknown')").select(*ENDPOINT)


def _belonging_to(nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Nodes from elsewhere, attached to the (last) declaration of their endpoint among ``endpoints``."""
    last = endpoints.groupBy(*ENDPOINT).agg(F.max("ordinal").alias("endpoint_ordinal"))
    return as_nodes(nodes.drop("endpoint_ordinal").join(last, ENDPOINT))


def carry_forward(scanned: Contract, baseline: Contract) -> Contract:
    """M9: a response the scan could not infer keeps the baseline's known one."""
    carried = (
        scanned.endpoints.select(*ENDPOINT)
        .join(response_known(scanned.nodes), ENDPOINT, "left_anti")
        .join(response_known(baseline.nodes), ENDPOINT, "left_semi")
        .distinct()
    )
    response = F.col("location") == "response"
    kept = scanned.nodes.where(~response).unionByName(
        scanned.nodes.where(response).join(carried, ENDPOINT, "left_anti")
    )
    taken = baseline.nodes.where(response).join(carried, ENDPOINT, "left_semi")
    return Contract(scanned.endpoints, as_nodes(kept).unionByName(_belonging_to(taken, scanned.endpoints)))


def accept(scanned: Contract, runtime_nodes: DataFrame, sampled: DataFrame, version: Column | int) -> Contract:
    """The next baseline. Endpoints with a sample take the runtime response, the rest the scanned one."""
    keys = sampled.select(*ENDPOINT).distinct()
    response = F.col("location") == "response"
    kept = scanned.nodes.where(~response).unionByName(
        scanned.nodes.where(response).join(keys, ENDPOINT, "left_anti")
    )
    taken = runtime_nodes.where(response).join(keys, ENDPOINT, "left_semi")
    nodes = as_nodes(kept).unionByName(_belonging_to(taken, scanned.endpoints))
    stamp = version if isinstance(version, Column) else F.lit(version)
    return Contract(
        scanned.endpoints.withColumn("version", stamp.cast("bigint")),
        nodes.withColumn("version", stamp.cast("bigint")),
    )
