"""Distributed radix sort: ranks by stable counting-sort passes over the digits of a composite key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import ready
from driftspark.session import settle

DIGIT_BITS = 12
# Rows of a block, the unit that one call of a counting-sort pass holds.
BLOCK = 1 << 17
_LOWEST = -(1 << 63)


def composite(rows: DataFrame, keys: Sequence[tuple[str, bool]]) -> tuple[list[Column], list[int]]:
    """64-bit words of a composite key, the least significant first, and the bits each of them uses.

    ``keys`` are names of integer columns, the most significant first, each with True for descending order;
    a null comes behind every value of its column. A column takes as many bits as its range needs, so a
    constant one takes none. One row of smallest and largest values comes to the driver.
    """
    bounds = rows.agg(
        *(f(F.col(name).cast("long")).alias(f"{side}{i}") for i, (name, _) in enumerate(keys) for side, f in (("low", F.min), ("high", F.max))),
        *(F.count_if(F.col(name).isNull()).alias(f"nulls{i}") for i, (name, _) in enumerate(keys)),
    ).first()
    parts: list[tuple[Column, int]] = []  # least significant first
    for i, (name, descending) in reversed(list(enumerate(keys))):
        low, high, value = bounds[f"low{i}"], bounds[f"high{i}"], F.col(name).cast("long")
        if low is not None:
            bits = (high - low).bit_length()
            if bits == 64:  # the distance from the least value would not fit a long
                part = value.bitwiseXOR(F.lit(_LOWEST))
                part = F.bitwise_not(part) if descending else part
            else:
                part = F.lit(high) - value if descending else value - F.lit(low)
            parts.append((F.coalesce(part, F.lit(0).cast("long")), bits))
        if bounds[f"nulls{i}"]:
            parts.append((F.col(name).isNull().cast("long"), 1))
    words: list[tuple[Column, int]] = []
    for part, bits in parts:
        if not bits:
            continue
        if words and words[-1][1] + bits <= 64:
            word, used = words[-1]
            words[-1] = (word.bitwiseOR(F.shiftleft(part, used)), used + bits)
        else:
            words.append((part, bits))
    return [w for w, _ in words], [b for _, b in words]


def _block(place: Column, size: int) -> Column:
    return F.lpad(F.floor(place / size).cast("string"), 20, "0")


def _destinations(rows: pa.Table, starts: pa.Table, names: Sequence[str]) -> pa.Table:
    """One block of a pass: its rows with the places they go to."""
    order = np.argsort(rows.column("__place").to_numpy(), kind="stable")
    digits = rows.column("__digit").to_numpy().astype(np.uint16)[order]
    counted = np.argsort(digits, kind="stable")
    groups, first, size = np.unique(digits[counted], return_index=True, return_counts=True)
    start = np.zeros(1 << 16, np.int64)
    start[starts.column("__digit").to_numpy()] = starts.column("__start").to_numpy()
    place = np.empty(len(digits), np.int64)
    place[counted] = np.repeat(start[groups] - first, size) + np.arange(len(digits))
    kept = rows.select(list(names)).take(pa.array(order))
    return kept.append_column("__place", pa.array(place))


def radix_ranks(
    rows: DataFrame, keys: Sequence[tuple[str, bool]], rank: str = "rank", digit_bits: int = DIGIT_BITS, block: int = BLOCK, name: str = "radix"
) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3, ...) in the order of ``keys`` (see :func:`composite`).

    Least significant digit first, every pass is a stable counting sort: rows are counted by (block, digit),
    prefix sums over digits and, inside a digit, over blocks give the place of the first row of each, and each
    block sends its rows to the places from there on. Blocks are ranges of places, so they are of one size
    whatever the keys: rows that all share a key spread like any others. A pass writes its rows once, to files
    in the shared folder from which the next one starts.

    Rows that tie in all keys get different ranks in any order. A caller's column of the name ``rank`` is
    replaced; other columns are kept. Keep ``rows`` slim: every pass moves them. An empty table stays empty.
    """
    ready(rows.sparkSession)
    rows = rows.drop(rank)
    names = rows.columns
    words, bits = composite(rows, keys)
    keyed = settle(rows.withColumns({f"__word{i}": word for i, word in enumerate(words)}), name)
    carried = keyed.columns
    placed = keyed.select(
        "*", F.col("_metadata.row_index").alias("__place"),
        F.concat("_metadata.file_name", F.lit(":"), _block(F.col("_metadata.row_index"), block)).alias("__block"),
    )
    passes = [(i, shift) for i, used in enumerate(bits) for shift in range(0, used, digit_bits)]
    for word, shift in passes or [(None, 0)]:
        value = F.shiftrightunsigned(f"__word{word}", shift) if word is not None else F.lit(0).cast("long")
        placed = placed.withColumn("__digit", value.bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int"))
        starts = _starts(placed, name)
        schema = placed.select(*carried, F.col("__place").cast("long")).schema
        moved = placed.groupBy("__block").cogroup(starts.groupBy("__block")).applyInArrow(
            lambda left, right: _destinations(left, right, carried), schema
        )
        placed = settle(moved, name)
        placed = placed.withColumn("__block", _block(F.col("__place"), block))
    return placed.select(*names, (F.col("__place") + 1).alias(rank))


def _starts(placed: DataFrame, name: str) -> DataFrame:
    """The place of the first row of every (block, digit): all smaller digits, then the same one in earlier blocks."""
    counts = settle(placed.groupBy("__block", "__digit").agg(F.count(F.lit(1)).alias("__rows")), f"{name}_counts")
    # One row for each value of a digit: 2 ** digit_bits at most.
    below = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    smaller = counts.groupBy(F.col("__digit").alias("__of")).agg(F.sum("__rows").alias("__rows")).select(
        "__of", F.coalesce(F.sum("__rows").over(below), F.lit(0)).alias("__smaller")
    )
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__earlier", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).join(
        F.broadcast(smaller), F.col("__digit") == F.col("__of")
    ).select("__block", "__digit", (F.col("__smaller") + F.col("__earlier")).alias("__start"))
