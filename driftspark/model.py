"""Table layouts, and the translation between JSON Schema documents and node rows.

A JSON Schema tree is stored as one row per position (*node*). ``node_path`` holds the segments
from the root (a property name, ``[]`` for array items, ``oneOf#i`` for an alternative) and ``trail``
one letter per segment telling which of the three it is (``p``, ``i``, ``o``), so a property that
happens to be called ``[]`` is never taken for array items.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINT = ["owner", "app", "method", "path"]
NODE = [*ENDPOINT, "location", "node_path"]

# Fixed values of the contract model.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]
LOCATIONS = ["body", "query", "path", "response"]
STACKS = {"app": "nextjs-app-router", "pages": "nextjs-pages-router", "hybrid": "nextjs-hybrid"}
DOCUMENT_KEYS = {
    "body": "requestSchema",
    "query": "querySchema",
    "path": "pathParams",
    "response": "responseSchema",
}

CONTRACTS_DDL = (
    "owner string, app string, version bigint, generated_at timestamp, project_root string, stack string"
)
ENDPOINTS_DDL = (
    "owner string, app string, version bigint, ordinal bigint, method string, path string, source_file string, "
    "router_type string, status_codes array<int>, description string"
)
NODES_DDL = (
    "owner string, app string, version bigint, method string, path string, location string, "
    "node_path array<string>, trail string, depth int, name string, ordinal int, endpoint_ordinal bigint, "
    "type string, required boolean, source string, sampled_type string, note string, example string, required_names array<string>"
)
PAYLOADS_DDL = (
    "ts timestamp, owner string, app string, method string, path string, status int, content_type string, body string"
)
CHANGES_DDL = (
    "owner string, app string, method string, path string, field string, change_type string, kind string, message string"
)
SOURCE_FILES_DDL = "repo string, rel_path string, content string"

NODE_ATTRIBUTES = [
    "trail", "depth", "name", "ordinal", "endpoint_ordinal",
    "type", "required", "source", "sampled_type", "note", "example", "required_names",
]


@dataclass(frozen=True)
class Contract:
    """A set of contract snapshots, at most one version per (owner, app).

    ``hashes`` are those of :func:`driftspark.operators.shapes.subtree_hashes`, where they are kept beside the nodes.
    """

    endpoints: DataFrame
    nodes: DataFrame
    hashes: DataFrame | None = None


def as_nodes(df: DataFrame) -> DataFrame:
    """Fill the node columns that ``df`` lacks and put them in table order."""
    defaults = {
        "version": F.lit(0).cast("bigint"),
        "depth": F.length("trail"),
        "name": F.when(F.size("node_path") > 0, F.element_at("node_path", -1)),
        "ordinal": F.lit(0),
        "endpoint_ordinal": F.lit(0),
        "required": F.lit(False),
    }
    columns = []
    for field in NODES_DDL.split(", "):
        name, kind = field.split(" ")
        value = F.col(name) if name in df.columns else defaults.get(name, F.lit(None))
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


def node_hash() -> Column:
    """Leading join key of node joins. The full key decides; the hash lets the sort in front of a
    merge join compare one long instead of six texts that mostly begin alike."""
    return F.xxhash64(*NODE).alias("node_hash")


def key_hashes(name: str, *parts: Column) -> list[Column]:
    """Two hashes, ``<name>1`` and ``<name>2``, that stand for the texts of a key where these would be shuffled with every
    row; null where a part is, so that such rows meet nothing. Different keys share both with a probability of 2 ** -128."""
    there = parts[0].isNotNull()
    for part in parts[1:]:
        there = there & part.isNotNull()
    hashes = F.xxhash64(*parts), F.xxhash64(F.lit(name), *parts)
    return [F.when(there, value).alias(f"{name}{i}") for i, value in enumerate(hashes, 1)]


def is_property(trail: Column) -> Column:
    return F.substring(trail, -1, 1) == "p"


def parent_path(node_path: Column) -> Column:
    """Path without its last segment; the root is its own parent."""
    return F.slice(node_path, F.lit(1), F.greatest(F.size(node_path) - 1, F.lit(0)))


def prefixes(node_path: Column) -> Column:
    """All proper prefixes of a path, the root first. Total, as the optimizer may evaluate it before any filter."""
    lengths = F.when(F.size(node_path) > 0, F.sequence(F.lit(0), F.greatest(F.size(node_path) - 1, F.lit(0))))
    return F.transform(F.coalesce(lengths, F.array().cast("array<int>")), lambda n: F.slice(node_path, 1, n))


def schema_to_nodes(
    docs: DataFrame,
    keys: Sequence[str],
    schema: str = "schema",
    annotations: str | Column = "x-contract",
    levels: int = 16,
) -> DataFrame:
    """One row per node of the JSON Schema documents in the VARIANT column ``schema``.

    One narrow stage: each level explodes only the nodes that still have children. A document
    nested deeper than ``levels`` stops the job rather than losing its tail. ``annotations`` is the prefix of
    the annotation keys, or one of the ``keys`` that holds it for each row; ``required_names`` are the required
    names that are no property.
    """
    prefix = annotations if isinstance(annotations, Column) else F.lit(annotations)
    kid_type = "array<struct<key:string,value:variant,kind:string,required:boolean>>"
    empty = F.array().cast(kid_type)
    own = F.expr(
        "array(named_struct('key', cast(null as string), 'value', cast(null as variant), "
        "'kind', cast(null as string), 'required', false))"
    )

    def text(v: Column, path: str | Column) -> Column:
        return F.try_variant_get(v, path, "string")

    def note(v: Column, name: str) -> Column:
        if not isinstance(annotations, Column):
            return text(v, f"$['{annotations}-{name}']")
        return F.when(prefix != "", text(v, F.concat(F.lit("$['"), prefix, F.lit(f"-{name}']"))))

    def attributes(v: Column) -> Column:
        example = F.try_variant_get(v, "$.examples[0]", "variant")
        required = F.try_variant_get(v, "$.required", "array<string>")
        properties = F.map_keys(F.try_variant_get(v, "$.properties", "map<string,variant>"))
        unmatched = F.array_except(required, F.coalesce(properties, F.array().cast("array<string>")))
        return F.struct(
            text(v, "$.type").alias("type"),
            note(v, "source").alias("source"),
            note(v, "sampled-type").alias("sampled_type"),
            note(v, "note").alias("note"),
            F.to_json(example).alias("example"),
            F.when(F.size(unmatched) > 0, unmatched).alias("required_names"),
        )

    def children(v: Column) -> Column:
        required = F.coalesce(F.try_variant_get(v, "$.required", "array<string>"), F.array().cast("array<string>"))
        entries = F.coalesce(
            F.map_entries(F.try_variant_get(v, "$.properties", "map<string,variant>")),
            F.array().cast("array<struct<key:string,value:variant>>"),
        )
        properties = F.transform(
            entries,
            lambda e: F.struct(
                e.key.alias("key"), e.value.alias("value"), F.lit("p").alias("kind"),
                F.array_contains(required, e.key).alias("required"),
            ),
        )
        item = F.coalesce(F.try_variant_get(v, "$.items", "variant"), F.parse_json(F.lit("{}")))
        items = F.array(
            F.struct(F.lit("[]").alias("key"), item.alias("value"), F.lit("i").alias("kind"), F.lit(False).alias("required"))
        )
        options = F.coalesce(F.try_variant_get(v, "$.oneOf", "array<variant>"), F.array().cast("array<variant>"))
        alternatives = F.transform(
            options,
            lambda o, i: F.struct(
                F.concat(F.lit("oneOf#"), i.cast("string")).alias("key"), o.alias("value"),
                F.lit("o").alias("kind"), F.lit(False).alias("required"),
            ),
        )
        has_items = (text(v, "$.type") == "array") | F.try_variant_get(v, "$.items", "variant").isNotNull()
        return F.concat(
            properties.cast(kid_type),
            F.when(has_items, items.cast(kid_type)).otherwise(empty),
            alternatives.cast(kid_type),
        )

    level = docs.where(F.col(schema).isNotNull()).select(
        *keys,
        F.array().cast("array<string>").alias("node_path"),
        F.lit("").alias("trail"),
        F.lit(0).alias("ordinal"),
        F.lit(False).alias("required"),
        attributes(F.col(schema)).alias("a"),
        F.col(schema).alias("v"),
    )
    for depth in range(levels + 1):
        kids = children(F.col("v"))
        if depth == levels:
            too_deep = F.raise_error(F.lit(f"schema nested deeper than {levels} levels; raise `levels`"))
            kids = F.when(F.size(kids) == 0, kids).otherwise(too_deep.cast(kid_type))
        out = [*keys, "node_path", "trail", "ordinal", "required", "a"]
        level = level.select(
            *out, F.posexplode(F.when(F.col("v").isNull(), own).otherwise(F.concat(own, kids))).alias("pos", "kid")
        )
        is_self = F.col("kid.key").isNull()
        level = level.select(
            *keys,
            F.when(is_self, F.col("node_path")).otherwise(F.concat("node_path", F.array("kid.key"))).alias("node_path"),
            F.when(is_self, F.col("trail")).otherwise(F.concat("trail", "kid.kind")).alias("trail"),
            F.when(is_self, F.col("ordinal")).otherwise(F.col("pos") - 1).alias("ordinal"),
            F.when(is_self, F.col("required")).otherwise(F.col("kid.required")).alias("required"),
            F.when(is_self, F.col("a")).otherwise(attributes(F.col("kid.value"))).alias("a"),
            F.col("kid.value").alias("v"),
        )
    return level.select(
        *keys, "node_path", "trail", F.length("trail").alias("depth"),
        F.when(F.size("node_path") > 0, F.element_at("node_path", -1)).alias("name"),
        "ordinal", "required", "a.*",
    )


def json_quote(text: Column) -> Column:
    """JSON string literal of a text column; SQL NULL stays NULL."""
    wrapped = F.to_json(F.array(text))
    return F.when(text.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - 2))


def nodes_to_schema(nodes: DataFrame, annotations: str = "x-contract") -> DataFrame:
    """JSON Schema text per (endpoint, location): the inverse of :func:`schema_to_nodes`.

    The nodes of one schema document are put in pre-order, where a node's text and the brackets it
    closes depend only on its two neighbours. One grouping rebuilds trees of any depth. Nodes move once; the
    required names of an object are found beside it in the list of its schema.
    """
    where = [*ENDPOINT, "location"]
    moved = ["node_path", "trail", "type", "source", "sampled_type", "note", "example", "name", "required", "required_names"]
    packed = nodes.groupBy(*where).agg(F.collect_list(F.struct(*moved)).alias("nodes"))
    # Nodes, and the names that are required below a node at the place of that node; those of one place are a run of ``all``.
    none = F.lit(None).cast("string")
    own = F.transform("nodes", lambda x: F.struct(x.node_path.alias("at"), none.alias("child"), x.alias("node")))
    of_parent = F.transform(
        F.filter("nodes", lambda x: x.required),
        lambda x: F.struct(parent_path(x.node_path).alias("at"), x["name"].alias("child"), F.when(F.lit(False), x).alias("node")),
    )
    placed = packed.select(*where, F.array_sort(F.concat(own, of_parent)).alias("all"))

    def at(i: Column) -> Column:
        return F.try_element_at(F.col("all"), i)["at"]

    first = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: (i == 1) | ~at(i).eqNullSafe(at(F.greatest(i - 1, F.lit(1)))))
    runs = F.transform("first", lambda i, k: F.slice("all", i, F.coalesce(F.try_element_at("first", k + 2), F.size("all") + 1) - i))
    # A key with a null part is no place.
    there = F.lit(True)
    for part in where:
        there = there & F.col(part).isNotNull()

    def names(run: Column, node: Column) -> Column:
        empty = F.array().cast("array<string>")
        below = F.array_compact(F.transform(run, lambda x: x.child))
        both = F.array_union(F.when(there & node.node_path.isNotNull(), below).otherwise(empty), F.coalesce(node.required_names, empty))
        return F.when(F.size(both) > 0, F.array_join(F.transform(F.array_sort(both), json_quote), ","))

    # oneOf#10 must follow oneOf#9: alternatives sort by number, properties by name.
    def option(node: Column, i: Column) -> Column:
        return node.trail.substr(i + 1, F.lit(1)) == "o"

    def order(node: Column) -> Column:
        return F.transform(node.node_path, lambda s, i: F.struct(
            F.when(option(node, i), "oneOf").otherwise(s).alias("text"),
            F.when(option(node, i), F.substring_index(s, "#", -1).try_cast("bigint")).otherwise(F.lit(0)).alias("number"),
        ))

    def member(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}":'), value)

    def attributes(run: Column, node: Column) -> Column:
        return F.array_compact(
            F.array(
                member("type", json_quote(node["type"])),
                member("examples", F.concat(F.lit("["), node.example, F.lit("]"))),
                member(f"{annotations}-source", json_quote(node.source)),
                member(f"{annotations}-sampled-type", json_quote(node.sampled_type)),
                member(f"{annotations}-note", json_quote(node.note)),
                member("required", F.concat(F.lit("["), names(run, node), F.lit("]"))),
            )
        )

    def told(run: Column) -> Column:
        return F.transform(F.filter(run, lambda x: x.node.isNotNull()), lambda x: F.struct(
            order(x.node).alias("order"), x.node.trail.alias("trail"), x.node["type"].alias("type"),
            attributes(run, x.node).alias("attributes"), json_quote(x.node["name"]).alias("name"),
        ))

    rows = placed.select(*where, "all", first.alias("first")).select(*where, F.array_sort(F.flatten(F.transform(runs, told))).alias("n"))

    def piece(node: Column, i: Column) -> Column:
        n = F.col("n")
        following = F.try_element_at(n, i + 2)
        depth = F.length(node.trail)
        next_depth = F.coalesce(F.length(following.trail), F.lit(0))
        has_kids = following.isNotNull() & (next_depth > depth)
        previous_depth = F.when(i > 0, F.length(F.try_element_at(n, F.when(i > 0, i).otherwise(F.lit(1))).trail))
        separator = F.when((depth > 0) & (previous_depth >= depth), ",").otherwise("")
        label = F.when(is_property(node.trail), F.concat(node["name"], F.lit(":"))).otherwise("")
        kind = F.substring(following.trail, -1, 1)
        wrapper = (
            F.when(has_kids & (kind == "p"), '"properties":{')
            .when(has_kids & (kind == "i"), '"items":')
            .when(has_kids & (kind == "o"), '"oneOf":[')
            .when(node["type"] == "object", '"properties":{}')
            .when(node["type"] == "array", '"items":{}')
        )
        body = F.array_join(F.array_compact(F.concat(node["attributes"], F.array(wrapper))), ",")
        stop = F.when(following.isNull(), F.lit(0)).otherwise(next_depth)
        closing = F.reverse(node.trail.substr(stop + 1, depth - stop))
        closing = F.replace(F.replace(F.replace(closing, F.lit("p"), F.lit("}}")), F.lit("i"), F.lit("}")), F.lit("o"), F.lit("]}"))
        return F.concat(
            separator, label, F.lit("{"), body, F.when(has_kids, F.lit("")).otherwise(F.concat(F.lit("}"), closing))
        )

    return rows.select(*where, F.array_join(F.transform("n", piece), "").alias("schema"))
