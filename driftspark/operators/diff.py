"""Contract diff and change classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, NODE, Contract, key_hashes, parent_path, prefixes
from driftspark.operators import shapes
from driftspark.session import settle

BREAKING, NON_BREAKING, ADDITIVE = "breaking", "non-breaking", "additive"
CHANGE = [*ENDPOINT, "field", "change_type", "kind", "message"]
# The message texts below are fixed values of the report. Path parameters are not compared.
COMPARED = ["body", "query", "response"]
_WHERE = [*ENDPOINT, "location"]
_KEY = ["key1", "key2"]


def _key() -> list[Column]:
    """The endpoint in rows that are moved by the node: its texts come back from the pairs, a row for each endpoint."""
    return key_hashes("key", *[F.col(name) for name in ENDPOINT])


def last_wins(contract: Contract) -> Contract:
    """Of endpoints declared twice, the last one counts."""
    last = Window.partitionBy(*ENDPOINT).orderBy(F.col("ordinal").desc())
    endpoints = contract.endpoints.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank")
    winners = endpoints.select(*ENDPOINT, F.col("ordinal").alias("endpoint_ordinal"))
    return Contract(endpoints, contract.nodes.join(winners, [*ENDPOINT, "endpoint_ordinal"], "left_semi"))


def _message(template: str, *args: Column) -> Column:
    """``template`` with its ``%s`` filled; plain concatenation, much cheaper per row than a formatter."""
    texts = template.split("%s")
    pieces = [F.lit(texts[0])]
    for arg, text in zip(args, texts[1:]):
        pieces += [arg, F.lit(text)]
    return F.concat(*pieces)


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoints of both sides in one full outer join: the endpoint, and the other columns as structs ``o`` and ``n``."""

    key = ["endpoint_hash", *ENDPOINT]

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df if "endpoint_hash" in df.columns else df.withColumn("endpoint_hash", shapes.endpoint_hash())
        return keyed.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))

    return side(old, "o").join(side(new, "n"), key, "full_outer").drop("endpoint_hash")


def compared_endpoints(old: Contract, new: Contract, deepest: int | None = None) -> DataFrame:
    """:func:`paired` with what D1, D2, D12 and D13 look at, and the ``schemas`` and ``shape`` of the compared
    locations (see :func:`shapes.endpoint_shapes`), written once.

    Hashes are taken from the contracts if both have them, so nodes need not be read; else they are made of the
    nodes down to the depth ``deepest``.
    """
    kept = old.hashes is not None and new.hashes is not None

    def side(contract: Contract) -> DataFrame:
        found = shapes.endpoint_shapes(contract.nodes, COMPARED, contract.hashes if kept else None, deepest)
        told = [
            F.col(name) if name in contract.endpoints.columns else F.lit(None).cast(kind).alias(name)
            for name, kind in (("status_codes", "array<int>"), ("description", "string"))
        ]
        keyed = contract.endpoints.select(shapes.endpoint_hash(), *ENDPOINT, *told)
        return keyed.join(found, ["endpoint_hash", *ENDPOINT], "left")

    return settle(paired(side(old), side(new)), "pairs")


def _change(field: Column, change_type: str, kind: str, message: Column) -> Column:
    return F.struct(
        field.cast("string").alias("field"), F.lit(change_type).alias("change_type"), F.lit(kind).alias("kind"), message.alias("message")
    )


def _listed(pairs: DataFrame, changes: Column) -> DataFrame:
    return pairs.select(*ENDPOINT, F.explode(changes).alias("c")).select(*ENDPOINT, "c.*")


def _one_sided() -> Column:
    """D1 and D2 of a pair."""

    def told(change_type: str, verb: str) -> Column:
        message = _message(f"Endpoint %s %s was {verb}", F.col("method"), F.col("path"))
        return _change(F.lit(None), change_type, f"endpoint_{verb}", message)

    return F.array_compact(F.array(
        F.when(F.col("n").isNull(), told(BREAKING, "removed")).when(F.col("o").isNull(), told(NON_BREAKING, "added"))
    ))


def _codes_and_text() -> Column:
    """D12 and D13 of a pair with both sides."""

    def code_changes(gone: Column, change_type: str, verb: str) -> Column:
        return F.transform(gone, lambda code: _change(
            F.concat(F.lit("statusCode."), code.cast("string")), change_type, f"status_{verb}",
            F.concat(F.lit("Status code "), code.cast("string"), F.lit(f" was {verb}")),
        ))

    none = F.array().cast("array<int>")
    before, after = F.coalesce("o.status_codes", none), F.coalesce("n.status_codes", none)
    updated = _change(F.lit("description"), ADDITIVE, "description_updated", F.lit("Description updated"))
    rewritten = ~F.col("o.description").eqNullSafe(F.col("n.description")) & (F.coalesce("n.description", F.lit("")) != "")
    changes = F.concat(
        code_changes(F.array_except(before, after), BREAKING, "removed"),
        code_changes(F.array_except(after, before), NON_BREAKING, "added"),
        F.array_compact(F.array(F.when(rewritten, updated))),
    )
    return F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), changes)


def endpoint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Endpoints on one side only."""
    there = [df.select(*ENDPOINT, F.lit(True).alias("there")) for df in (old, new)]
    return _listed(paired(*there), _one_sided())


def status_and_description_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """D12 and D13 for endpoints on both sides, in one join."""
    sides = [df.select(*ENDPOINT, "status_codes", "description") for df in (old, new)]
    return _listed(paired(*sides), _codes_and_text())


def field_changes(
    old: Contract, new: Contract, max_depth: int = 1, widen_numbers: bool = False, alternatives: bool = False, pairs: DataFrame | None = None
) -> DataFrame:
    """Schemas and fields of endpoints present on both sides.

    Endpoints of one shape on both sides (equal structural hashes; two different schemas share one with
    a probability of 2 ** -64) have no change. Where that leaves less than half of the endpoints, only the nodes of
    those are read further; otherwise taking nodes out first would cost more than it saves. One full outer join
    on the node key finds every difference; it is keyed down to the field, so no endpoint forms a hot key. Nodes move with
    two hashes of their endpoint in place of its texts (see :func:`driftspark.model.key_hashes`), and messages are made
    behind the last join.
    ``max_depth=1`` compares top-level properties, more also looks into nested ones and array items.
    ``alternatives=True`` compares what is a ``oneOf`` on either side by :func:`alternative_changes` instead of field
    by field. ``pairs`` is :func:`compared_endpoints`, if it is there already.
    """
    if alternatives:
        old, new = _hashed(old), _hashed(new)
    if pairs is None:  # codes and descriptions are not looked at here
        bare = [Contract(c.endpoints.select(*ENDPOINT), c.nodes, c.hashes) for c in (old, new)]
        pairs = compared_endpoints(*bare, None if alternatives else max_depth)
    both_sides = pairs.where("o IS NOT NULL AND n IS NOT NULL")
    differing = both_sides.where("NOT (o.shape <=> n.shape)")
    matched, changed = both_sides.count(), differing.count()
    compared = F.col("location").isin(*COMPARED)
    in_reach = (F.size("node_path") <= max_depth) & F.col("trail").rlike("^(p[pi]*)?$" if max_depth > 1 else "^p?$")

    def side(contract: Contract, name: str) -> DataFrame:
        """Nodes, and a row with ``ghost`` for each name that is required but no property."""
        rows = contract.nodes.where(compared & in_reach)
        if 2 * changed < matched:
            rows = rows.join(differing.select(*ENDPOINT), ENDPOINT, "left_semi")
        place = [*_key(), "location"]
        real = rows.select(*place, "node_path", F.struct("type", "required", F.lit(False).alias("ghost")).alias(name))
        ghosts = rows.where((F.size("required_names") > 0) & (F.size("node_path") < max_depth)).select(
            *place, F.explode("required_names").alias("ghost"), "node_path"
        ).select(
            *_KEY, "location", F.concat("node_path", F.array("ghost")).alias("node_path"),
            F.struct(F.lit(None).cast("string").alias("type"), F.lit(True).alias("required"), F.lit(True).alias("ghost")).alias(name),
        )
        return real.unionByName(ghosts)

    both = side(old, "o").join(side(new, "n"), [*_KEY, "location", "node_path"], "full_outer")
    o, n = F.col("o"), F.col("n")
    at_root = F.size("node_path") == 0

    request = F.col("location") != "response"
    field = F.concat_ws(".", F.col("location"), F.array_join("node_path", "."))
    field = F.when(at_root, F.col("location")).otherwise(field)

    def change(kind: str, change_type: str | Column, message: Column) -> Column:
        level = change_type if isinstance(change_type, Column) else F.lit(change_type)
        return F.struct(F.lit(kind).alias("kind"), level.alias("change_type"), message.alias("message"))

    def quoted(template: str, *more: Column) -> Column:
        return _message(template, F.col("field"), *more)

    # On a field both sides have, the type and the required flag may both have changed.
    differs = o["type"] != n["type"]
    if widen_numbers:
        differs = differs & ~(o["type"].isin("integer", "number") & n["type"].isin("integer", "number"))
    by_type = (
        F.when(
            differs & (o["type"] == "unknown"),
            change("type_refined", NON_BREAKING, quoted('Field "%s" type refined from unknown to %s', n["type"])),
        )
        .when(
            differs & (n["type"] == "unknown"),
            change("type_lost", BREAKING, quoted('Field "%s" type changed from %s to unknown', o["type"])),
        )
        .when(
            differs,
            change("type_changed", BREAKING, quoted('Field "%s" type changed from %s to %s', o["type"], n["type"])),
        )
    )
    real_new, real_old = ~n["ghost"], ~o["ghost"]
    by_required = (
        F.when(
            o["required"] & ~n["required"] & real_new,
            change("now_optional", NON_BREAKING, quoted('Field "%s" changed from required to optional')),
        )
        .when(
            ~o["required"] & n["required"] & real_old & request,
            change("now_required", BREAKING, quoted('Field "%s" changed from optional to required in request body')),
        )
        .when(
            ~o["required"] & n["required"] & real_old,
            change("now_required", NON_BREAKING, quoted('Field "%s" is now required in response')),
        )
    )
    removed = change("field_removed", BREAKING, quoted('Field "%s" was removed'))
    added = F.when(
        request & n["required"],
        change("required_field_added", BREAKING, quoted('Required field "%s" was added to request body')),
    ).otherwise(change("field_added", NON_BREAKING, quoted('Field "%s" was added')))
    schema_added = change("schema_added", F.when(request, ADDITIVE).otherwise(NON_BREAKING), _message("%s schema added", F.col("field")))
    schema_removed = change("schema_removed", BREAKING, _message("%s schema removed", F.col("field")))
    gone, fresh = n.isNull() | n["ghost"], o.isNull() | o["ghost"]
    never = F.coalesce(gone, F.lit(False)) & F.coalesce(fresh, F.lit(False))
    one_sided = (
        F.when(never, F.lit(None))
        .when(at_root & gone, schema_removed).when(at_root & fresh, schema_added).when(gone, removed).when(fresh, added)
    )
    by_field = F.array(F.when(~at_root, by_type), F.when(~at_root, by_required), one_sided)
    # Whether any of them holds, told without texts.
    flag_changed = (o["required"] & ~n["required"] & real_new) | (~o["required"] & n["required"] & real_old)
    has_change = F.coalesce(~at_root & (differs | flag_changed), F.lit(False)) | F.coalesce(~never & (gone | fresh), F.lit(False))
    in_both = F.coalesce(real_old & real_new, F.lit(False))
    told = both
    if max_depth > 1:
        told = both.where((in_both & (F.size("node_path") < max_depth)) | has_change)
    elif alternatives:
        told = both.where(has_change)
    if alternatives:
        told = told.withColumn("row", F.monotonically_increasing_id())
    if told is not both:
        told = settle(told, "told")
    # A schema counts on an endpoint both sides have, a top-level field in a schema both sides have; the few
    # columns of the pairs tell.
    known = differing.select(*_key(), *ENDPOINT, F.col("o.schemas").bitwiseAND(F.col("n.schemas")).alias("schemas"))
    depth = F.size("node_path")
    own = told.where(has_change)
    if alternatives:  # what lies at or below an alternative is not told field by field
        choices = _choices(old, new, differing if 2 * changed < matched else None, compared & in_reach, max_depth)
        above = F.explode(F.array_append(prefixes(F.col("node_path")), F.col("node_path"))).alias("prefix")
        switched = choices.select(*_KEY, "location", F.col("node_path").alias("prefix"))
        replaced = own.select("row", *_KEY, "location", above).join(switched, [*_KEY, "location", "prefix"], "left_semi")
        own = own.join(replaced.select("row").distinct(), "row", "left_anti").drop("row")
    kept = own.join(known, _KEY).where((depth == 0) | shapes.has_schema(F.col("schemas"), F.col("location")))
    if max_depth > 1:  # what lies deeper counts below a parent both sides have
        # The hash leads the join key for a cheap sort, as in node_hash().
        place = [*_KEY, "location", "parent"]
        key = F.xxhash64(*place).alias("place")
        parents = told.where(in_both).select(*_KEY, "location", F.col("node_path").alias("parent")).select(key, "*")
        below = (depth > 1) & (gone | fresh)
        deep = kept.where(below).withColumn("parent", parent_path(F.col("node_path")))
        deep = deep.select(key, "*").join(parents, ["place", *place], "left_semi").drop("place", "parent")
        kept = kept.where(~below).unionByName(deep.select(*kept.columns))
    kept = kept.withColumn("field", field).select(*_WHERE, "node_path", "field", F.array_compact(by_field).alias("changes"))
    out = [*ENDPOINT, "field", "c.change_type", "c.kind", "c.message"]
    by_name = kept.select(*ENDPOINT, "field", F.explode("changes").alias("c")).select(*out)
    return by_name if not alternatives else by_name.unionByName(_alternative_changes(choices, differing))


def _hashed(contract: Contract) -> Contract:
    """``contract`` with its structural hashes: made once, they tell both which endpoints and which alternatives differ.
    Trails and types come along, so that nodes need not meet their hashes again."""
    if contract.hashes is not None:
        return contract
    nodes = contract.nodes.where(F.col("location").isin(*COMPARED)).withColumn("kept", F.struct("trail", "type"))
    return Contract(contract.endpoints, contract.nodes, shapes.subtree_hashes(nodes))


def _choices(old: Contract, new: Contract, few: DataFrame | None, reached: Column, max_depth: int) -> DataFrame:
    """The nodes in reach that are a ``oneOf`` on either side and there on both, with the alternatives, by structural hash,
    that only one side has (``o`` or ``n``); a row without either stands for a node where none came or went. A node that is
    no ``oneOf`` has one alternative, itself.

    Nodes and alternatives of both sides are moved once, to the node that offers them, with hashes of their endpoint. The
    alternatives of one node meet in one task, which may spill. ``few`` are the endpoints that differ, where they are worth taking out first.
    """
    place = [*_KEY, "location", "node_path"]

    def side(contract: Contract, name: str) -> DataFrame:
        hashed = contract.hashes.where(F.col("location").isin(*COMPARED) & (F.size("node_path") <= max_depth + 1))
        if "kept" in hashed.columns:
            hashed = hashed.select(*NODE, "kept.*", "subtree_hash")
        else:
            hashed = hashed.select(*NODE, "subtree_hash").join(contract.nodes.select(*NODE, "trail", "type"), NODE)
        if few is not None:
            hashed = hashed.join(few.select(*ENDPOINT), ENDPOINT, "left_semi")
        own = F.when(reached, F.struct(F.col("node_path"), F.lit(False).alias("option")))
        option = F.when(F.col("trail").like("%o"), F.struct(parent_path(F.col("node_path")).alias("node_path"), F.lit(True).alias("option")))
        # Types may be null: they are compared as text.
        rows = hashed.select(
            *_key(), "location", F.coalesce("type", F.lit("untyped")).alias("type"), "subtree_hash",
            F.explode(F.array_compact(F.array(own, option))).alias("at"),
        ).where("key1 IS NOT NULL")
        flags = [(F.lit(name == x) & (F.col("at.option") == y)).alias(f"{x}_{z}") for x in "on" for y, z in ((False, "own"), (True, "option"))]
        return rows.select(*_KEY, "location", "at.node_path", "type", "subtree_hash", *flags)

    flags = [f"{x}_{z}" for x in "on" for z in ("own", "option")]
    moved = side(old, "o").unionByName(side(new, "n")).repartition(*place)
    rows = moved.groupBy(*place, "type", "subtree_hash").agg(*(F.max(x).alias(x) for x in flags))
    at = Window.partitionBy(*place)
    rows = rows.select("*", *(F.max(x).over(at).alias(f"any_{x}") for x in flags), F.min("subtree_hash").over(at).alias("least"))
    offered = [F.when(F.col(f"any_{x}_option"), F.col(f"{x}_option")).otherwise(F.col(f"{x}_own")) for x in "on"]
    o, n = offered[0] & ~offered[1], offered[1] & ~offered[0]
    rows = rows.where("any_o_own AND any_n_own AND (any_o_option OR any_n_option)")
    rows = rows.select(*place, "type", o.alias("o"), n.alias("n"), (F.col("subtree_hash") == F.col("least")).alias("one"))
    return settle(rows.where("o OR n OR one").drop("one"), "choices")


def _alternative_changes(choices: DataFrame, differing: DataFrame) -> DataFrame:
    """Alternatives that came or went. A request that takes more, or a response that gives less, breaks no one."""
    request = F.col("location") != "response"
    field = F.when(F.size("node_path") == 0, F.col("location")).otherwise(F.concat_ws(".", "location", F.array_join("node_path", ".")))
    gone = F.col("o")
    verb = F.when(gone, "removed").otherwise("added")
    known = differing.select(*_key(), *ENDPOINT).dropDuplicates(_KEY)
    return choices.where("o OR n").join(known, _KEY).select(
        *ENDPOINT, field.alias("field"), F.when(request == gone, BREAKING).otherwise(NON_BREAKING).alias("change_type"),
        F.concat(F.lit("alternative_"), verb).alias("kind"), _message('Alternative %s of "%s" was %s', F.col("type"), field, verb).alias("message"),
    )


def diff_contracts(
    old: Contract, new: Contract, max_depth: int = 1, widen_numbers: bool = False, unique: bool = False, alternatives: bool = False
) -> DataFrame:
    """Every change between two contracts. ``unique=True`` skips D0 for inputs known to have no duplicates.

    Endpoints are joined once; what they alone tell, and which of them are compared further, comes from that.
    """
    if not unique:
        old, new = last_wins(old), last_wins(new)
    if alternatives:
        old, new = _hashed(old), _hashed(new)
    pairs = compared_endpoints(old, new, None if alternatives else max_depth)
    none = F.array().cast("array<struct<field:string,change_type:string,kind:string,message:string>>")
    by_endpoint = _listed(pairs, F.concat(_one_sided(), F.coalesce(_codes_and_text(), none)))
    return by_endpoint.unionByName(field_changes(old, new, max_depth, widen_numbers, alternatives, pairs)).select(*CHANGE)


def report(changes: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """Counts per class and the gate; an app fails iff something breaking changed.

    ``apps`` (owner, app) adds a passing row for apps without any change.
    """
    app = ["owner", "app"]

    def total(change_type: str) -> Column:
        return F.count_if(F.col("change_type") == change_type)

    counts = changes.groupBy(*app).agg(
        total(BREAKING).alias("breaking"),
        total(NON_BREAKING).alias("non_breaking"),
        total(ADDITIVE).alias("additive"),
    )
    if apps is not None:
        counts = apps.select(*app).distinct().join(counts, app, "left").fillna(0)
    return counts.withColumn("failed", F.col("breaking") > 0)
