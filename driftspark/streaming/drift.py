"""Continuous drift check over a payload stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftspark.model import CHANGES_DDL, ENDPOINT, NODES_DDL, Contract
from driftspark.operators import diff, impact, infer, merge
from driftspark.sources import payloads as log

_WHERE = [*ENDPOINT, "location"]


class DriftCheck:
    """Keeps a baseline under ``folder`` and compares every micro-batch of payloads with it.

    Tables, one sub-folder per batch, each written by overwriting that sub-folder, so a batch that
    runs again after a failure leaves the same rows:

    * ``baseline/batch=n`` — nodes of the (endpoint, location) pairs whose schema batch n replaced;
    * ``changes/batch=n`` — the classified changes of batch n;
    * ``report/batch=n`` — counts per class and the gate, for every app with a sample in the batch;
    * ``broken/batch=n`` — where the code uses the fields that batch n broke (with ``files``);
    * ``seen/batch=n`` and ``observed/batch=n`` — what its payloads showed, as types and as nodes
      (read back, so payloads are parsed once);
    * ``compact/batch=n`` — every ``compact_every`` batches, the whole baseline after batch n.

    Batch n compares with the newest nodes of batches before n: the last compacted baseline and the at most
    ``compact_every`` deltas since, so what a batch reads does not grow with the number of batches. Samples of one batch are combined
    first (``union``) or reduced to the newest one (``latest``), then merged once, so where batches
    are cut influences which fields count as gone.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        endpoints: DataFrame,
        mode: str = "union",
        apply: str = "changed",
        include_writes: bool = False,
        files: DataFrame | None = None,
        compact_every: int = 8,
    ):
        self.spark, self.folder, self.endpoints = spark, folder.rstrip("/"), endpoints
        self.mode, self.apply, self.include_writes = mode, apply, include_writes
        self.files, self.compact_every = files, compact_every

    def start_from(self, baseline: DataFrame) -> DriftCheck:
        baseline.write.mode("overwrite").parquet(f"{self.folder}/compact/batch=-1")
        return self

    def _read(self, table: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(f"{ddl}, batch bigint").option("basePath", f"{self.folder}/{table}").parquet(
            f"{self.folder}/{table}"
        )

    def baseline(self, before: int) -> DataFrame:
        """Nodes as of the last batch before ``before``."""
        compacted = before - 1 - before % self.compact_every
        paths = [f"{self.folder}/compact/batch={compacted}"]
        paths += [f"{self.folder}/baseline/batch={n}" for n in range(compacted + 1, before)]
        rows = self.spark.read.schema(NODES_DDL).parquet(*paths).withColumn("file", F.input_file_name())
        batch = F.regexp_extract("file", r"/batch=(-?[0-9]+)/[^/]*$", 1).cast("bigint")
        rows = rows.withColumn("batch", batch).drop("file")
        newest = rows.where("size(node_path) = 0").groupBy(*_WHERE).agg(F.max("batch").alias("batch"))
        return rows.join(newest, [*_WHERE, "batch"], "left_semi").drop("batch")

    def changes(self) -> DataFrame:
        return self._read("changes", CHANGES_DDL)

    def reports(self) -> DataFrame:
        return self._read("report", "owner string, app string, breaking bigint, non_breaking bigint, additive bigint, failed boolean")

    def broken(self) -> DataFrame:
        return self._read("broken", "repo string, field string, references bigint, listing string")

    def _seen(self, batch: DataFrame) -> DataFrame:
        samples = log.targeted(log.sampled(batch, include_writes=self.include_writes), log.sampling_targets(self.endpoints, None))
        return infer.latest_schema(samples) if self.mode == "latest" else infer.observed_types(samples)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        def keep(df: DataFrame, table: str) -> DataFrame:
            path = f"{self.folder}/{table}/batch={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        seen = keep(self._seen(batch), "seen")
        observed = infer.sample_nodes(seen) if self.mode == "latest" else infer.observed_nodes(seen)
        observed = keep(observed, "observed")
        touched = observed.where("size(node_path) = 0").select(*_WHERE)
        whole = self.baseline(batch_id)
        before = whole.join(touched, _WHERE, "left_semi")
        plan = merge.plan_merge(before, observed)
        if self.apply == "changed":
            renewed = merge.field_summary(plan).select(*_WHERE).distinct()
            plan = plan.join(renewed, _WHERE, "left_semi")
        after = keep(merge.merged_nodes(plan), "baseline")
        renewed = after.where("size(node_path) = 0").select(*_WHERE)
        old = Contract(self.endpoints, before.join(renewed, _WHERE, "left_semi"))
        # Only the endpoints of replaced schemas are compared.
        shown = self.endpoints.join(renewed.select(*ENDPOINT).distinct(), ENDPOINT, "left_semi")
        changes = keep(diff.field_changes(Contract(shown, old.nodes), Contract(shown, after)), "changes")
        keep(diff.report(changes, touched.select("owner", "app")), "report")
        if self.files is not None:
            fields = impact.broken_fields(changes).select(F.concat_ws("/", "owner", "app").alias("repo"), F.col("field_name").alias("field"))
            keep(impact.impact_table(fields, impact.consumer_refs(self.files, fields)), "broken")
        if (batch_id + 1) % self.compact_every == 0:
            untouched = whole.join(renewed, _WHERE, "left_anti")
            keep(untouched.unionByName(after.select(*untouched.columns)), "compact")

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
