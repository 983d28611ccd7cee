"""Operator 6: resharding by minimum-cost flow."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import numbered, table
from driftspark.session import released_shuffles, shared_folder

OLD_SHARDS, NEW_SHARDS = 16, 24
# Bytes of a row besides its text.
ROW_BYTES = 8


def transfers(old: Sequence[int], new: Sequence[int], cost=lambda s, t: int(s != t)) -> dict[tuple[int, int], int]:
    """Bytes to send from each old shard to each new one: a flow of least cost that fills the capacities.

    Old shard s and new shard s are the same place, so by default a byte that stays costs nothing and a byte
    that moves costs one. Successive shortest paths (Bellman-Ford on the residual graph): the graph has one
    node per shard, whatever the data. ``sum(new)`` must be at least ``sum(old)``.
    """
    n, m = len(old), len(new)
    left, room = list(old), list(new)
    flow = {(s, t): 0 for s in range(n) for t in range(m)}
    while any(left):
        reach = [0 if left[s] else float("inf") for s in range(n)] + [float("inf")] * m
        via: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for (s, t), amount in flow.items():
                there = reach[s] + cost(s, t)
                if there < reach[n + t]:
                    reach[n + t], via[n + t], changed = there, s, True
                back = reach[n + t] - cost(s, t)
                if amount and back < reach[s]:
                    reach[s], via[s], changed = back, n + t, True
        end = min((t for t in range(m) if room[t]), key=lambda t: reach[n + t])
        path = [n + end]
        while via[path[-1]] is not None:
            path.append(via[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min([left[path[0]], room[end], *(flow[b, a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def sizes(rows: DataFrame, shard: str, size: str, shards: int) -> list[int]:
    """Bytes of each of ``shards`` shards; one short row for each."""
    found = {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum(size).cast("long")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def reshard(
    rows: DataFrame, old: str, size: str, old_shards: int, capacities: Sequence[int] | int, order: list[Column], name: str = "shards"
) -> DataFrame:
    """``rows`` with ``shard``: blocks of the old shards sent where the flow says, so that the fewest bytes move.

    ``capacities`` are the bytes of the new shards, or their number for equal ones. A block is a range of an
    old shard in ``order``; a row on the edge of two blocks goes to the one that holds its middle, so a shard
    misses its capacity by one row for each of its blocks at most. What stays comes first in ``order``, hence
    with the largest rows first the edges lie among small ones. Sizes that are null count as 0; an empty
    table gives an empty result.
    """
    before = sizes(rows, old, size, old_shards)
    after = even(sum(before), capacities) if isinstance(capacities, int) else list(capacities)
    flow = transfers(before, after)
    slots = numbered(rows, old, order, size, name)
    target: Column = F.lit(None).cast("int")
    for s in range(old_shards):
        blocks = sorted(((t, v) for (o, t), v in flow.items() if o == s), key=lambda b: (b[0] != s, b[0]))
        ends, at = [], 0
        for _, amount in blocks[:-1]:
            at += amount
            ends.append(at)
        if blocks:
            middle = F.col("before") + F.col(size) / 2
            index = F.lit(0) if not ends else F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle))
            place = F.element_at(F.array(*(F.lit(t) for t, _ in blocks)), index + 1)
        else:
            place = F.lit(min(s, len(after) - 1))  # an old shard of rows without bytes
        target = F.when(F.col(old) == s, place).otherwise(target)
    return slots.withColumn("shard", target.cast("int")).drop("slot", "before")


def affected(placed: DataFrame, old: str) -> list[int]:
    """Shards whose files must be written again: those that lose rows or get some. At most one row per shard."""
    moved = placed.filter(~F.col(old).eqNullSafe(F.col("shard")))
    both = moved.select(F.col(old).cast("int").alias("shard")).union(moved.select(F.col("shard").cast("int")))
    return sorted(r[0] for r in both.distinct().collect() if r[0] is not None)


def rewrite(placed: DataFrame, old: str, folder: str, dealt: bool = True) -> list[int]:
    """Write the affected shards of ``placed`` to ``folder/shard=N`` and leave the files of the others alone.

    The folders of affected shards that have no row any more are removed. ``placed`` may be read from
    ``folder``: old files go when all new ones are written, but ``placed`` cannot be read again then. ``dealt`` is
    that of :func:`store`.
    """
    todo = affected(placed, old)
    if todo:
        rows = placed.filter(F.col("shard").isin(todo))
        filled = {r[0] for r in rows.select(F.col("shard").cast("int")).distinct().collect()}
        store(rows, folder, dealt)
        context = placed.sparkSession.sparkContext
        for shard in set(todo) - filled:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return todo


def store(rows: DataFrame, folder: str, dealt: bool = True) -> None:
    """``rows`` as files below ``folder/shard=N``, in place of what the shards among them had.

    With ``dealt``, rows are dealt out by range of the shard and a hash, so each shard is written by several tasks and
    each task writes few of them; the shuffle files are given back. Without it every task writes its own rows, for
    rows that lie by shard already."""
    if dealt:
        rows = rows.withColumn("__at", F.xxhash64(*rows.columns)).repartitionByRange("shard", "__at").drop("__at")
    with released_shuffles(rows.sparkSession):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)


def reshard_files(
    spark: SparkSession, folder: str, schema: str, size: Column, old_shards: int, capacities: Sequence[int] | int, order: list[Column], name: str = "shards"
) -> list[int]:
    """Reshard the rows of ``folder/shard=N`` in place and give the shards that were written.

    ``schema`` (a DDL string) is that of the files with ``shard``; ``old_shard`` in it keeps the shard a row comes
    from. Whole rows are read and written once: places are settled on sizes and ``order`` alone, with the file
    and the row in it as the last keys, and whole rows find theirs by the first row of each block, of which
    there are fewer than old and new shards together.
    """
    files = spark.read.schema(schema).parquet(folder).withColumn("old_shard", F.col("shard"))
    keys = {f"__k{i}": c for i, c in enumerate([*order, F.col("_metadata.file_name"), F.col("_metadata.row_index")])}
    keyed = files.withColumn("__size", size).withColumns(keys)
    slim = keyed.select("old_shard", "__size", *keys)
    placed = reshard(slim, "old_shard", "__size", old_shards, capacities, [F.col(k) for k in keys], name)
    key = F.struct(*(F.col(k) for k in keys))
    firsts = placed.groupBy("old_shard", "shard").agg(F.min(key).alias("first"))
    blocks = firsts.orderBy("old_shard", "first").collect()
    target: Column = F.lit(None).cast("int")
    kinds = dict(slim.dtypes)
    for block in blocks:  # the last block that begins at or before the row
        first = F.struct(*(F.lit(block["first"][k]).cast(kinds[k]).alias(k) for k in keys))
        target = F.when((F.col("old_shard") == block["old_shard"]) & (key >= first), block["shard"]).otherwise(target)
    whole = keyed.withColumn("shard", target.cast("int")).drop("__size", *keys)
    # A task reads a part of an old shard, whose rows go to the few shards of its blocks: no rows need to be dealt out.
    return rewrite(whole, "old_shard", folder, dealt=False)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by hash of the text (equal texts together) to 24 shards of nearly equal bytes.

    The old shards are written to the shared folder with whole texts, the affected ones are written again, and
    the rows are those of the files then."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    schema = "doc_id {}, text string, size long, text_crc32 long, old_shard int, shard int"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = schema.format(docs.schema["doc_id"].dataType.simpleString())
    old = F.pmod(F.xxhash64("text"), F.lit(OLD_SHARDS)).cast("int")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    # Size and checksum are columns of the files: later steps read them, not the texts.
    store(docs.select("doc_id", "text", size.alias("size"), crc.alias("text_crc32"), old.alias("old_shard"), old.alias("shard")), folder)
    reshard_files(spark, folder, schema, F.col("size"), OLD_SHARDS, NEW_SHARDS, [-F.col("size"), F.col("doc_id"), F.col("text_crc32")])
    rows = spark.read.schema(schema).parquet(folder).select("doc_id", "size", "text_crc32", "old_shard", "shard")
    return numbered(rows, "shard", [F.col("doc_id"), F.col("text_crc32")], "size", "slots").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
