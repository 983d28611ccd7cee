"""As-of join: each row meets the state that was valid at its own time (S3 at the time of every payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.session import settle


def as_of_join(
    rows: DataFrame, states: DataFrame, by: list[str], time: str, since: str, values: list[str],
    name: str = "valid", partitions: int | None = None,
) -> DataFrame:
    """``rows`` and, in the struct ``name``, the ``values`` of the last state of its keys with ``since`` <= ``time``.

    Both sides are one table, range-partitioned by (keys, time): a key with a third of all rows is many ranges, and
    so is a single instant of it. Inside a range a window carries the last state on; at the front of a range only one key
    can have begun before, so what the ranges hand on to each other is at most one row a range, which is broadcast.

    Every row comes back once, in no order, repeated ones too (equal ones stand in one range). ``name`` is null where no state was valid yet, where a key
    or the time of the row is null, and for all rows if ``states`` is empty. States with a null key or ``since`` are never
    valid. Of states with equal keys and ``since`` the one with the greatest ``values`` counts, which must therefore be
    of types with an order. Columns of ``rows`` may have any name but ``name``, which raises ValueError.

    ``partitions`` is the number of ranges; Spark's number of shuffle partitions if not given.
    """
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"rows already have a column {name}")
    empty = F.lit(None).cast(rows.schema)
    found = states.select(F.struct(*[F.col(v) for v in values]).alias("v")).schema["v"].dataType
    at = rows.schema[time].dataType
    known = F.col(time).isNotNull()
    for column in by:
        known = known & F.col(column).isNotNull()
    asked = rows.select(
        # Rows without a key or a time stand in a key of their own, which has no states.
        F.when(known, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])).alias("key"),
        F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(found).alias("state"), F.struct("*").alias("row"),
    )
    given = states.dropna(subset=[*by, since]).select(
        F.struct(*[F.col(c).cast(rows.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(by)]).alias("key"),
        F.col(since).cast(at).alias("at"), F.lit(0).alias("side"), F.struct(*[F.col(v) for v in values]).alias("state"), empty.alias("row"),
    )
    # Rows of one key and instant are told apart by a hash of what they hold, so that they too can be split. A number of
    # the row would be another one when a lost task reads its input in another order.
    plain = [f.name for f in rows.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    asked = asked.withColumn("spread", F.xxhash64(*[F.col("row").getField(c) for c in plain]))
    both = asked.unionByName(given.withColumn("spread", F.lit(0).cast("long")))
    order = ["key", "at", "side", "state", "spread"]
    ranged = both.repartitionByRange(partitions, *order) if partitions else both.repartitionByRange(*order)
    parts = settle(ranged.drop("spread").withColumn("part", F.spark_partition_id()), "ranges")

    # The last state of every key in every range, and the one key a range begins with.
    last = parts.groupBy("part", "key").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "state"))).alias("last"))
    front = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.where("key is not null")
        .withColumn("before", F.last("last", ignorenulls=True).over(front))
        .where("before is not null")
        .select("part", "key", F.col("before.state").alias("carried"))
    )
    inside = Window.partitionBy("part", "key").orderBy("at", "side", "state").rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.withColumn("seen", F.last("state", ignorenulls=True).over(inside)).where("side = 1")
    return seen.join(F.broadcast(carried), ["part", "key"], "left").select(
        "row.*", F.coalesce("seen", "carried").alias(name)
    )
