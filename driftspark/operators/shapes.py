"""Structural hashes of schemas: equal trees have equal hashes, however their properties and alternatives are ordered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, LOCATIONS, NODE, parent_path
from driftspark.session import settle

_WHERE = [*ENDPOINT, "location"]
_LOW = 0xFFFFFFFF


def _halves(value: Column) -> list[Column]:
    """Two numbers whose sums cannot leave a long: hashes are added up, so no order and no list is needed."""
    return [F.shiftright(value, 32).alias("high"), value.bitwiseAND(F.lit(_LOW)).alias("low")]


def _own() -> Column:
    names = F.array_sort(F.coalesce("required_names", F.array().cast("array<string>")))
    return F.xxhash64(F.coalesce("type", F.lit("")), F.col("type").isNull(), F.array_distinct(names)).alias("own")


def _label() -> Column:
    kind = F.substring("trail", -1, 1)
    name = F.when((kind == "p") & (F.size("node_path") > 0), F.try_element_at("node_path", F.lit(-1))).otherwise("")
    return F.xxhash64(kind, name, (kind == "p") & F.col("required"))


def _level(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth: the key, the hash of what is their own and that of the label they have in their parent."""
    label = _label() if depth else F.lit(0).cast("long")
    kept = ["kept"] if "kept" in nodes.columns else []
    return nodes.where(F.size("node_path") == depth).select(*NODE, *kept, _own(), label.alias("label"))


def _sums(rows: DataFrame, key: list[str], above: DataFrame | None) -> DataFrame:
    """``rows`` grouped by ``key`` with the sums of what their children add."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    if above is not None:
        rows = rows.select("*", zero.alias("high"), zero.alias("low")).unionByName(
            above.select(*[none.alias(c) for c in ("own", "label")], *key, "high", "low")
        )
        return rows.groupBy(*key).agg(F.max("own").alias("own"), F.max("label").alias("label"), F.sum("high").alias("high"), F.sum("low").alias("low")).where(
            "own IS NOT NULL"
        )
    return rows.select("*", zero.alias("high"), zero.alias("low"))


def _beside(rows: DataFrame, above: DataFrame) -> DataFrame:
    """As :func:`_sums`, but with every one of ``rows``, as they have something to keep; ``first`` tells one row of each node."""
    given = above.groupBy(*NODE).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    same, zero = Window.partitionBy(*NODE), F.lit(0).cast("long")
    return rows.join(given, NODE, "left").select(
        *NODE, "kept", F.max("own").over(same).alias("own"), F.max("label").over(same).alias("label"),
        F.coalesce("high", zero).alias("high"), F.coalesce("low", zero).alias("low"),
        (F.row_number().over(same.orderBy("own")) == 1).alias("first"),
    )


def _levels(nodes: DataFrame, settled: bool, top: int = 0, deepest: int | None = None) -> Iterator[DataFrame]:
    """The nodes of each depth with their ``subtree_hash``, from the deepest up to ``top``.

    A node's hash is that of its type, its required names and the sum over its children, each under its label:
    the name and required flag of a property, the kind alone of items and alternatives. Provenance, notes and
    examples do not count. Each level is one grouping by parent, combined before the shuffle, so an object of
    any width is no single task.
    """
    if deepest is None:
        deepest = nodes.agg(F.max(F.size("node_path"))).first()[0]
    below, carried = None, "kept" in nodes.columns
    for depth in range(-1 if deepest is None else deepest, top - 1, -1):
        rows = _level(nodes, depth)
        if carried and below is not None:
            rows = _beside(rows, _given(below.where("first")))
        else:
            rows = _sums(rows, NODE, None if below is None else _given(below)).withColumn("first", F.lit(True))
        more = ["kept", "first"] if carried else []
        rows = rows.select(*NODE, *more, "label", F.xxhash64("own", "high", "low").alias("subtree_hash"))
        below = settle(rows, "shapes") if settled else rows
        yield below


def _given(below: DataFrame) -> DataFrame:
    """What nodes add to their parents."""
    parent = parent_path(F.col("node_path")).alias("node_path")
    return below.select(*_WHERE, parent, *_halves(F.xxhash64("label", "subtree_hash")))


def subtree_hashes(nodes: DataFrame) -> DataFrame:
    """Node key and ``subtree_hash`` of every node of one or many contracts.

    To be written beside the nodes: whoever keeps them need not read nodes to see that nothing changed. They are read
    from written tables, one for each depth. A column ``kept`` of ``nodes`` comes along, with a row for every node row.
    """
    out = [*NODE, *(["kept"] if "kept" in nodes.columns else []), "subtree_hash"]
    found = nodes.withColumn("subtree_hash", F.lit(0).cast("long")).select(*out).limit(0)
    for level in _levels(nodes, settled=True):
        found = found.unionByName(level.select(*out))
    return found


def endpoint_hash() -> Column:
    """Leading join key of endpoint joins, as :func:`driftspark.model.node_hash` for nodes."""
    return F.xxhash64(*ENDPOINT).alias("endpoint_hash")


def endpoint_shapes(nodes: DataFrame, locations: list[str], hashes: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """``endpoint_hash`` and one row for each endpoint: ``schemas`` (a bit for each of ``locations`` that has one) and
    ``shape``, the hash of all of them.

    The roots of an endpoint are grouped at once, one sum for each location. With ``hashes``
    (:func:`subtree_hashes`), ``nodes`` are not read. ``deepest`` leaves out nodes below that depth; schemas without
    any below the first are read in one scan then.
    """
    key = ["endpoint_hash", *ENDPOINT]

    def at(location: str, value: str) -> Column:
        return F.when(F.col("location") == location, F.col(value))

    if hashes is not None:
        roots = hashes.where((F.size("node_path") == 0) & F.col("location").isin(*locations))
        folded = roots.groupBy(endpoint_hash(), *ENDPOINT).agg(*(F.max(at(x, "subtree_hash")).alias(x) for x in locations))
    else:
        chosen = nodes.where(F.col("location").isin(*locations))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        if deepest is not None and deepest <= 1:
            top = F.size("node_path") == 0
            flat = chosen.where(F.size("node_path") <= deepest).select(*_WHERE, top.alias("top"), _own(), _label().alias("label"))
            added = F.xxhash64("label", F.xxhash64("own", zero, zero))
            rows = flat.select(endpoint_hash(), *_WHERE, F.when(F.col("top"), F.col("own")).alias("own"), *(
                F.when(F.col("top"), zero).otherwise(half).alias(name) for half, name in zip(_halves(added), ("high", "low"))
            ))
        else:
            below = None
            for below in _levels(chosen, settled=False, top=1, deepest=deepest):
                pass
            rows = _level(chosen, 0).select(endpoint_hash(), *_WHERE, "own", zero.alias("high"), zero.alias("low"))
            if below is not None:
                given = _given(below).where(F.size("node_path") == 0)
                rows = rows.unionByName(given.select(endpoint_hash(), *_WHERE, none.alias("own"), "high", "low"))
        sums = rows.groupBy(*key).agg(*(
            f(at(x, c)).alias(f"{x}_{c}") for x in locations for c, f in (("own", F.max), ("high", F.sum), ("low", F.sum))
        ))
        folded = sums.select(*key, *(
            F.when(F.col(f"{x}_own").isNotNull(), F.xxhash64(f"{x}_own", f"{x}_high", f"{x}_low")).alias(x) for x in locations
        ))
    schemas = F.lit(0)
    for x in locations:
        schemas = schemas.bitwiseOR(F.when(F.col(x).isNotNull(), 1 << LOCATIONS.index(x)).otherwise(0))
    there = [F.col(x).isNotNull() for x in locations]
    return folded.select(*key, schemas.alias("schemas"), F.xxhash64(*locations, *there).alias("shape"))


def has_schema(schemas: Column, location: Column) -> Column:
    """Whether the bits ``schemas`` tell of a schema at ``location``."""
    bit = F.lit(0)
    for number, name in enumerate(LOCATIONS):
        bit = F.when(location == name, 1 << number).otherwise(bit)
    return F.coalesce(schemas, F.lit(0)).bitwiseAND(bit) != 0
