"""Type tags of JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_sql(kind: str, value: str) -> str:
    """SQL for the type tag, given the expression (best a column) that holds ``schema_of_variant(value)``.

    A number is an ``integer`` when its double has no fraction, so ``1.0`` and ``1e3`` are integers
    and ``1e400`` (infinite as a double) is not.
    """
    return f"""CASE
        WHEN {kind} IS NULL THEN NULL
        WHEN {kind} = 'STRING' THEN 'string'
        WHEN {kind} = 'BIGINT' THEN 'integer'
        WHEN {kind} = 'BOOLEAN' THEN 'boolean'
        WHEN {kind} = 'VOID' THEN 'null'
        WHEN startswith({kind}, 'OBJECT<') THEN 'object'
        WHEN startswith({kind}, 'ARRAY<') THEN 'array'
        WHEN try_variant_get({value}, '$', 'double') % 1D = 0D THEN 'integer'
        ELSE 'number' END"""


def json_type(body: Column) -> Column:
    """Type tag of JSON text: null, string, integer, number, boolean, array or object; SQL NULL when it is not JSON."""
    value = F.try_parse_json(body)
    return F.transform(
        F.array(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k"))), lambda x: _tag(x.k, x.v)
    )[0]


def _tag(kind: Column, value: Column) -> Column:
    whole = F.try_variant_get(value, "$", "double") % F.lit(1.0) == 0
    return (
        F.when(kind.isNull(), None)
        .when(kind.startswith("OBJECT<"), "object")
        .when(kind.startswith("ARRAY<"), "array")
        .when(kind.isin("STRING", "BOOLEAN"), F.lower(kind))
        .when(kind == "VOID", "null")
        .when(whole, "integer")
        .otherwise("number")
    )
