"""Operator 5: optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import bpe
from driftspark.llm.common import WORD, numbered, table
from driftspark.session import settle

BUCKETS, BUDGET = 16, 16_384


def word_tokens(text: Column) -> Column:
    """Tokens of a text as its white-space separated words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def histogram(lengths: DataFrame, length: str) -> np.ndarray:
    """Each distinct length over all rows, in order, with its number of rows.

    Two numbers a length come to the driver, and n distinct lengths need n * n / 2 tokens at least: a corpus of
    10^13 tokens has under 5 million, 72 MB, however its lengths fall.
    """
    bars = lengths.groupBy(F.col(length).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("rows")).toArrow()
    pairs = np.column_stack([bars.column(c).to_numpy() for c in ("length", "rows")])
    return pairs[pairs[:, 0].argsort()]


def boundaries(bars: np.ndarray | list[tuple], buckets: int = BUCKETS) -> list[int]:
    """The ``buckets`` upper lengths (fewer if there are fewer bars) that give the least padding in total.

    Dynamic programming: the least padding of the first bars in k buckets is that of fewer bars in k - 1
    buckets plus the padding of the last bucket, whose rows are all filled up to its longest one. As the rows
    in front only grow, the best start of the last bucket never moves back when bars are added: a layer is
    solved by halves, all middles of one depth at once, in n log n steps. ``bars`` are (length, rows, ...) in
    order of length; costs are exact up to 2^64.
    """
    if not len(bars):
        return []
    longest, rows = np.asarray(bars, np.int64)[:, :2].T.astype(np.longdouble)
    before = np.concatenate([[0], np.cumsum(rows)])
    n = len(bars)
    # The total of the lengths themselves does not depend on the boundaries: what is filled up to is compared.
    best = longest * before[1:]  # of the first 1, 2, ... n bars in one bucket
    cuts = [np.zeros(n, np.int64)]
    for layer in range(1, min(buckets, n)):
        cut = _layer(best, longest, before, layer)
        cost = np.full(n, np.inf, np.longdouble)
        at = np.arange(layer, n)
        cost[at] = best[cut[at] - 1] + longest[at] * (before[at + 1] - before[cut[at]])
        cuts.append(cut)
        best = cost
    edges, last = [], n - 1
    for cut in reversed(cuts):
        edges.append(int(longest[last]))
        last = int(cut[last]) - 1
    return edges[::-1]


def _layer(best: np.ndarray, longest: np.ndarray, before: np.ndarray, layer: int) -> np.ndarray:
    """For each last bar, the first bar of the last bucket; ``best`` is of one bucket less. By halves: the
    choices of a middle bound those of the bars on either side of it."""
    n = len(longest)
    cut = np.zeros(n, np.int64)
    low, high = np.array([layer]), np.array([n - 1])
    first, final = np.array([layer]), np.array([n - 1])
    while len(low):
        middle = (low + high) // 2
        top = np.minimum(final, middle)
        sizes = top - first + 1
        starts = np.cumsum(sizes) - sizes
        choice = np.arange(int(sizes.sum())) - np.repeat(starts - first, sizes)
        last = np.repeat(middle, sizes)
        cost = best[choice - 1] + longest[last] * (before[last + 1] - before[choice])
        least = np.minimum.reduceat(cost, starts)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        owner = np.searchsorted(starts, hit, "right") - 1
        picked = choice[hit[np.searchsorted(owner, np.arange(len(starts)))]]
        cut[middle] = picked
        low, high, first, final = (
            np.concatenate(x) for x in ((low, middle + 1), (middle - 1, high), (first, picked), (picked, final))
        )
        there = low <= high
        low, high, first, final = low[there], high[there], first[there], final[there]
    return cut


def pack(
    docs: DataFrame, length: str, order: list[Column], buckets: int = BUCKETS, budget: int = BUDGET, name: str = "packing"
) -> DataFrame:
    """``docs`` with ``bucket``, ``boundary`` (length its rows are filled up to), ``batch`` (number within the
    bucket), ``position`` within the batch and ``padding``; columns of these names are replaced.

    A batch holds as many rows as fit ``budget`` tokens at the length of its bucket, one at least, so only a
    text longer than the budget goes over it, alone. Null lengths count as 0; repeated rows are rows of
    their own; ties in ``order``, which settles the places within a bucket, are placed in any order; an empty
    table gives an empty result. All other columns of ``docs``, whatever their names, are carried along.
    """
    added = ("bucket", "boundary", "batch", "position", "padding")
    rows = docs.drop(*(c for c in added if c != length)).withColumn(length, F.coalesce(F.col(length), F.lit(0)).cast("long"))
    edges = boundaries(histogram(rows, length), buckets) or [0]
    edge = F.array(*(F.lit(e).cast("long") for e in edges))
    places = [f"__order{i}" for i in range(len(order))]
    held = rows.select(
        F.struct("*").alias("__row"), F.col(length).alias("__length"), *(c.alias(p) for c, p in zip(order, places))
    ).withColumn("__bucket", F.size(F.filter(edge, lambda e: e < F.col("__length"))))
    slots = numbered(held, "__bucket", [F.col(p) for p in places], "__length", name)
    slots = slots.withColumn("__edge", F.element_at(edge, F.col("__bucket") + 1))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("__edge"), F.lit(1))))
    return slots.select(
        "__row.*", F.col("__bucket").alias("bucket"), F.col("__edge").alias("boundary"),
        F.floor(F.col("slot") / fit).cast("long").alias("batch"),
        (F.col("slot") % fit).cast("long").alias("position"),
        (F.col("__edge") - F.col("__length")).alias("padding"),
    )


def spread(key: str) -> list[Column]:
    """An order that mixes neighbours: by a hash of the key, then the key."""
    return [F.xxhash64(key), F.col(key)]


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return pack(settle(docs, "counted"), "n_tokens", spread("doc_id"))
