"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.session import settle


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``id`` and ``component`` (smallest id that can be reached) of every id that stands in a link.

    Alternating stars: each round hangs the larger neighbours of every node, then the smaller ones, on the
    smallest neighbour, until every edge leads to the root of its component; the number of rounds grows with
    the logarithm of the longest path. A hub is no single task: minima are combined before the shuffle and
    the joins may be split. Each round is written to the shared folder. Null ids and links of a node with
    itself are left out.
    """
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a) != F.col(b)).distinct(), name
    )
    state = _state(edges)
    while state[0]:
        edges = settle(_small_star(_large_star(edges)), name)
        fresh = _state(edges)
        if fresh == state:
            break
        state = fresh
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    hung = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    hung = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u != v").union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
