"""Stored observations: what payloads showed, day by day, so that a schema over a year reads no payload again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT
from driftspark.operators.infer import observed_types

NODE = ["node_path", "trail", "depth", "type"]
_SEEN = "node_path array<string>, trail string, depth int, type string, samples bigint, first_seen timestamp, last_seen timestamp"


def merged_types(parts: DataFrame, keys: Sequence[str] = ENDPOINT) -> DataFrame:
    """One row per (node, type) out of any number of partial results of ``observed_types``.

    Counts add up, first and last times are least and greatest: parts may come in any order and grouping, and the
    result is what one pass over all their payloads gives. Parts must not overlap in payloads.
    """
    return parts.groupBy(*keys, *NODE).agg(
        F.sum("samples").alias("samples"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


class Observations:
    """Summaries below ``root``, a folder per batch of payloads and in it one per day (UTC) of the payloads' own times.

    ``keys`` are text columns of the payloads, none of them named ``batch`` or ``day``. A summary has a row per
    (day, keys, node, type): its size follows the shapes seen, not the calls. Unreadable bodies teach nothing, as in
    :func:`driftspark.operators.infer.observed_types`; null keys are keys like others.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ENDPOINT) -> None:
        if {"batch", "day"} & {k.lower() for k in keys}:
            raise ValueError("batch and day are columns of the store")
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)

    def add(self, payloads: DataFrame, batch: int | str, body: str = "body", ts: str = "ts") -> None:
        """Summarise one batch of payloads. Each payload belongs to one batch, late ones to the batch that brings them.

        The folder of the batch is overwritten, so a batch that is run again after a failure counts once. Payloads
        without a time are kept under a day of their own, which no window contains.
        """
        if {"day"} & {c.lower() for c in payloads.columns}:
            payloads = payloads.select(*self.keys, body, ts)
        days = payloads.withColumn("day", F.to_date(ts))
        types = observed_types(days, [*self.keys, "day"], body, ts)
        # Days are dealt over tasks with their nodes, so that a day is neither one task nor a file from each task.
        types.repartitionByRange("day", *self.keys, "node_path").write.mode("overwrite").partitionBy("day").parquet(
            f"{self.root}/batch={batch}"
        )

    def parts(self, since: date | str | None = None, until: date | str | None = None) -> DataFrame:
        """Stored rows of the days from ``since`` to ``until``, both included; folders of other days are not opened."""
        keys = ", ".join(f"`{k}` string" for k in self.keys)
        found = self.spark.read.schema(f"{keys}, {_SEEN}, batch string, day date").option("basePath", self.root).parquet(self.root)
        if since is not None:
            found = found.where(F.col("day") >= F.lit(since).cast("date"))
        if until is not None:
            found = found.where(F.col("day") <= F.lit(until).cast("date"))
        return found

    def types(self, since: date | str | None = None, until: date | str | None = None) -> DataFrame:
        """The rows of ``observed_types`` over all payloads of these days, without reading one."""
        return merged_types(self.parts(since, until), self.keys)

    def fold(self, batches: Sequence[int | str], into: int | str) -> None:
        """Write the summaries of ``batches`` as one batch ``into``, which must be none of them.

        Whoever calls this removes the folders of ``batches`` afterwards, before anything is read: until then their
        payloads count twice.
        """
        if str(into) in {str(b) for b in batches}:
            raise ValueError("a batch cannot be folded into itself")
        parts = self.parts().where(F.col("batch").isin(*[str(b) for b in batches]))
        merged_types(parts, [*self.keys, "day"]).repartitionByRange("day", *self.keys, "node_path").write.mode("overwrite").partitionBy(
            "day"
        ).parquet(f"{self.root}/batch={into}")
