"""Schemas learned from JSON values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.json_types import tag_sql
from driftspark.model import ENDPOINT, as_nodes, prefixes
from driftspark.session import settle

# Fixed values of schema learning: objects below this depth lose their properties; array elements looked at.
MAX_OBJECT_DEPTH = 6
ITEMS_INSPECTED = 3

_ENTRY = "named_struct('key', {key}, 'value', {value})"
_SELF = _ENTRY.format(key="cast(null as string)", value="cast(null as variant)")
_NO_ITEM = _ENTRY.format(key="'[]'", value="cast(null as variant)")


def _children_sql(union_items: bool) -> str:
    """Array of the entries below a value, from its columns ``type``, ``depth``, ``v`` and, for arrays,
    the inspected elements ``i0..`` and their tags ``t0..``."""
    indexes = range(ITEMS_INSPECTED)
    option = [_ENTRY.format(key=f"'oneOf#{i}'", value=f"i{i}") for i in indexes]
    alike = [_ENTRY.format(key="'[]'", value=f"i{i}") for i in indexes]
    mixed = " OR ".join(f"coalesce(t{i} <> t0, false)" for i in indexes[1:])
    cases = ["WHEN type = 'object' AND depth <= {0} THEN map_entries(try_variant_get(v, '$', 'map<string,variant>'))"]
    cases += ["WHEN type <> 'array' THEN NULL", f"WHEN t0 IS NULL THEN array({_NO_ITEM})"]
    for size in range(1, ITEMS_INSPECTED + 1):
        shorter = f"t{size} IS NULL AND " if size < ITEMS_INSPECTED else ""
        if size > 1:
            cases.append(f"WHEN {shorter}({mixed}) THEN array({', '.join([_NO_ITEM, *option[:size]])})")
        if size > 1 and union_items:
            cases.append(f"WHEN {shorter}true THEN array({', '.join(alike[:size])})")
    return f"CASE {' '.join(cases)} ELSE array({alike[0]}) END".replace("{0}", str(MAX_OBJECT_DEPTH))


# An object whose schema text settles the type of every node below it: without arrays (their text
# mixes all elements), floating-point numbers (maybe whole), quoted names, or decimals that a double
# cannot tell apart.
_SETTLED = (
    "startswith(kind, 'OBJECT<') AND NOT contains(kind, 'ARRAY<') AND NOT contains(kind, 'DOUBLE') "
    "AND NOT contains(kind, '`') AND NOT (contains(kind, 'DECIMAL') AND kind rlike 'DECIMAL[(](1[6-9]|[23][0-9]),')"
)
_SHAPE = (
    "CASE WHEN contains(kind, 'DECIMAL') THEN regexp_replace(regexp_replace(kind, "
    "'DECIMAL[(][0-9]+,0[)]', 'BIGINT'), 'DECIMAL[(][0-9]+,[0-9]+[)]', 'DECIMAL') ELSE kind END"
)


def _descend(
    carry: Sequence[str], own: Sequence[str], levels: int, union_items: bool, arrays: bool, fold: bool
) -> list[list[str]]:
    """SELECT lists that unroll ``levels`` steps from ``node_path, trail, depth, <own>, is_self, item, kind``.

    Each step types the new rows, keeps the value ``v`` of those that have children to show, and
    explodes "myself, then my children". All steps are plain expressions of one narrow stage.
    """
    carried = [f"`{name}`" for name in carry]
    place = ["node_path", "trail", "depth"]
    indexes = range(ITEMS_INSPECTED)
    items = [f"CASE WHEN type = 'array' THEN try_variant_get(v, '$[{i}]', 'variant') END AS i{i}" for i in indexes]
    kinds = [f"schema_of_variant(i{i}) AS k{i}" for i in indexes]
    tags = [f"{tag_sql(f'k{i}', f'i{i}')} AS t{i}" for i in indexes]
    held = [f"i{i}" for i in indexes]
    example = (
        "CASE WHEN kind <> 'VOID' AND NOT startswith(kind, 'OBJECT<') AND NOT startswith(kind, 'ARRAY<') "
        "THEN to_json(item) END"
    )
    tag = tag_sql("kind", "item")
    container = "startswith(kind, 'OBJECT<') OR startswith(kind, 'ARRAY<')"
    if fold:
        tag = f"CASE WHEN {_SETTLED} THEN {_SHAPE} ELSE {tag} END"
        container = f"({container}) AND NOT ({_SETTLED})"
    found = {"type": tag, "example": example}
    if arrays:
        children = f"coalesce({_children_sql(union_items)}, array())"
        step = (
            "WHEN type = 'array' AND e.key <> '[]' THEN concat(node_path, array('[]', e.key)) "
            "ELSE concat(node_path, array(e.key)) END"
        )
        letters = "WHEN type = 'object' THEN concat(trail, 'p') WHEN e.key = '[]' THEN concat(trail, 'i') ELSE concat(trail, 'io') END"
    else:
        children = (
            f"CASE WHEN depth <= {MAX_OBJECT_DEPTH} THEN map_entries(try_variant_get(v, '$', 'map<string,variant>')) "
            "ELSE array() END"
        )
        step, letters = "ELSE concat(node_path, array(e.key)) END", "ELSE concat(trail, 'p') END"

    typed = [
        *carried, *place,
        *[f"CASE WHEN is_self THEN {name} ELSE {found[name]} END AS {name}" for name in own],
        f"CASE WHEN {container} THEN item END AS v",
    ]
    step_down = [
        [
            *carried, *place, *own,
            f"explode(CASE WHEN v IS NULL THEN array({_SELF}) ELSE concat(array({_SELF}), {children}) END) AS e",
        ],
        [
            *carried,
            f"CASE WHEN e.key IS NULL THEN node_path {step} AS node_path",
            f"CASE WHEN e.key IS NULL THEN trail {letters} AS trail",
            "CASE WHEN e.key IS NULL THEN depth ELSE depth + 1 END AS depth",
            *own, "e.key IS NULL AS is_self", "e.value AS item", "schema_of_variant(e.value) AS kind",
        ],
        typed,
    ]
    if arrays:
        step_down = [["*", *items], ["*", *kinds], [*carried, *place, *own, "v", *held, *tags], *step_down]
    # What the unrolled steps leave unopened goes along as text, for :func:`_complete`.
    rest = f"CASE WHEN v IS NOT NULL AND (type = 'array' OR depth <= {MAX_OBJECT_DEPTH}) THEN to_json(v) END AS rest"
    last = [*carried, *place, *own, rest] if arrays else [*carried, *place, *own]
    return [typed, *(step_down * levels), last]


def _select(df: DataFrame, stages: Sequence[Sequence[str]], at_once: int = 6) -> DataFrame:
    """Apply one SELECT after the other, many per statement, so that the chain is analysed few times."""
    for start in range(0, len(stages), at_once):
        text = "".join(" |> SELECT " + ", ".join(stage) for stage in stages[start : start + at_once])
        df = df.sparkSession.sql("FROM {source}" + text.replace("{", "{{").replace("}", "}}"), source=df)
    return df


def flatten_values(
    df: DataFrame,
    value: Column,
    carry: Sequence[str],
    levels: int = 10,
    examples: bool = False,
    union_items: bool = False,
    fold: bool = False,
) -> DataFrame:
    """One row per schema node of a VARIANT value.

    Rows whose value is SQL NULL (unreadable JSON) give nothing. Objects stop at depth 6, arrays are followed
    to any depth: ``levels`` steps are unrolled into one stage, and what is nested deeper is opened in further
    rounds of as many steps. With ``fold``, an object whose schema text settles its whole subtree
    stays one row with that text as type; :func:`unfold_shapes` brings out its nodes later.
    """
    flat = _flatten(df, value, carry, levels, examples, union_items, fold)
    own = ["type", "example"] if examples else ["type"]
    return _complete(flat, carry, own, levels, union_items, fold and not examples)


def _complete(
    flat: DataFrame, carry: Sequence[str], own: Sequence[str], levels: int, union_items: bool, fold: bool
) -> DataFrame:
    """Opens what the unrolled steps left as ``rest``, round by round, until nothing is left.

    The rows so far are written, as they are read for both sides of each round."""
    steps = _descend(carry, own, levels, union_items, arrays=True, fold=fold)[1:]
    columns = [*carry, "node_path", "trail", "depth", *own]
    done = None
    while True:
        flat = settle(flat, "flat")
        closed = flat.where("rest is null").select(*columns)
        done = closed if done is None else done.unionByName(closed)
        beyond = flat.where("rest is not null")
        if beyond.isEmpty():
            return done
        flat = _select(beyond, [[*[f"`{c}`" for c in columns], "try_parse_json(rest) AS v"], *steps])


def _flatten(
    df: DataFrame, value: Column, carry: Sequence[str], levels: int, examples: bool, union_items: bool, fold: bool
) -> DataFrame:
    own = ["type", "example"] if examples else ["type"]
    start = [
        *[f"`{name}`" for name in carry],
        "cast(array() as array<string>) AS node_path", "'' AS trail", "0 AS depth",
        *[f"cast(null as string) AS {name}" for name in own],
        "false AS is_self", "item", "schema_of_variant(item) AS kind",
    ]
    steps = _descend(carry, own, levels, union_items, arrays=True, fold=fold and not examples)
    flat = _select(df.select(*carry, value.alias("item")), [start, *steps])
    # Unreadable values are dropped at the end: a filter before the descent would be pushed below
    # the projection that parses and make every text parse twice.
    return flat.where("depth > 0 or type is not null")


def unfold_shapes(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Nodes of the folded shapes among ``rows``; other rows pass unchanged.

    A settled schema text is rewritten to JSON with one value per type and flattened like a payload.
    Done after grouping, on a handful of shapes per endpoint.
    """
    json = "regexp_replace(type, '([A-Za-z_][A-Za-z0-9_]*): ', '\"$1\":')"
    for kind, sample in (("BIGINT", "0"), ("DECIMAL", "0.5"), ("STRING", '""'), ("BOOLEAN", "true"), ("VOID", "null")):
        json = f"replace({json}, ':{kind}', ':{sample}')"
    json = f"replace(replace({json}, 'OBJECT<', '{{'), '>', '}}')"
    start = [
        *[f"`{name}`" for name in carry], "node_path", "trail", "depth", "type",
        f"try_parse_json(CASE WHEN startswith(type, 'OBJECT<') THEN {json} END) AS item",
    ]
    steps = _descend(carry, ["type"], MAX_OBJECT_DEPTH + 1, False, arrays=False, fold=False)
    return _select(rows, [start, ["*", "item IS NULL AS is_self", "schema_of_variant(item) AS kind"], *steps])


def observed_types(
    payloads: DataFrame,
    keys: Sequence[str] = ENDPOINT,
    body: str = "body",
    ts: str = "ts",
    examples: bool = False,
    levels: int = 10,
    union_items: bool = False,
) -> DataFrame:
    """I5 ``union``: every (node, type) any sample showed, with its count and first and last time.

    Equal shapes are folded before anything is shuffled, so the map side shrinks a hot endpoint to
    its few distinct shapes, and nodes are counted from those.
    """
    node = [*keys, "node_path", "trail", "depth", "type"]
    flat = _flatten(payloads, F.try_parse_json(F.col(body)), [*keys, ts], levels, examples, union_items, not examples)
    counted = ["samples", "first_seen", "last_seen"]
    least = [F.min("example").alias("example")] if examples else []
    shapes = flat.groupBy(*node, "rest").agg(
        F.count(F.lit(1)).alias("samples"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *least
    )
    # Grouped first: what is nested too deep is opened once for all payloads that share it.
    shapes = _complete(shapes, [*keys, *counted], ["type", "example"] if examples else ["type"], levels, union_items, not examples)
    if examples:
        return shapes.groupBy(*node).agg(
            F.sum("samples").alias("samples"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
            F.min("example").alias("example"),
        )
    return unfold_shapes(shapes, [*keys, *counted]).groupBy(*node).agg(
        F.sum("samples").alias("samples"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def latest_payloads(
    payloads: DataFrame, keys: Sequence[str] = ENDPOINT, body: str = "body", ts: str = "ts"
) -> DataFrame:
    """I5 ``latest``: the newest readable payload per endpoint (ties: the greater body text).

    ``row_number() = 1`` becomes a per-task limit in front of the shuffle, so at most one payload
    per endpoint and task moves, however hot the endpoint.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(body).desc())
    readable = payloads.where(F.try_parse_json(F.col(body)).isNotNull())
    return readable.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank")


def latest_schema(
    payloads: DataFrame,
    keys: Sequence[str] = ENDPOINT,
    body: str = "body",
    ts: str = "ts",
    examples: bool = False,
    levels: int = 10,
) -> DataFrame:
    newest = latest_payloads(payloads, keys, body, ts)
    return flatten_values(newest, F.try_parse_json(F.col(body)), [*keys, ts], levels, examples)


def observed_nodes(
    types: DataFrame, location: str = "response", keys: Sequence[str] = ENDPOINT, widen_numbers: bool = False
) -> DataFrame:
    """One node row per path out of :func:`observed_types`.

    Where samples disagree, the earliest type stays, as it would when samples are merged one after
    the other; nodes that hang below a type that lost are removed with it. ``types`` is read
    several times: settle it first when it comes straight from payloads.
    """
    if widen_numbers:
        widened = F.when(F.col("type") == "integer", "number").otherwise(F.col("type"))
        types = types.withColumn("type", widened)
    node = [*keys, "node_path"]
    group = Window.partitionBy(*node)
    first = group.orderBy(F.col("type").isNull(), "first_seen", F.col("samples").desc(), "type", "trail")
    chosen = (
        types.withColumn("rank", F.row_number().over(first))
        .withColumn("kinds", F.count(F.lit(1)).over(group))
        .where("rank = 1")
        .drop("rank")
    )
    # Ancestors seen with several types or kinds: only these can orphan a node.
    disputed = chosen.where("kinds > 1").select(
        *keys, F.col("node_path").alias("prefix"), F.col("trail").alias("p_trail"), F.col("type").alias("p_type")
    )
    letter = F.col("trail").substr(F.length("p_trail") + 1, F.lit(1))
    fits = (
        F.col("trail").startswith(F.col("p_trail"))
        & F.coalesce(
            F.when(F.col("p_type") == "object", letter == "p").when(F.col("p_type") == "array", letter == "i"),
            F.col("p_type").isNull() & (letter == "o"),
        )
    )
    orphans = (
        chosen.where("size(node_path) > 0")
        .select(*node, "trail", F.explode(prefixes(F.col("node_path"))).alias("prefix"))
        .join(disputed, [*keys, "prefix"])
        .where(~fits)
        .select(*node)
        .distinct()
    )
    kept = chosen.join(orphans, node, "left_anti").withColumn("location", F.lit(location))
    return as_nodes(kept)


def sample_nodes(schema: DataFrame, location: str = "response") -> DataFrame:
    """Node rows out of :func:`latest_schema`."""
    return as_nodes(schema.withColumn("location", F.lit(location)))
