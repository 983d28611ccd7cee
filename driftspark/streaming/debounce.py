"""Bursts of events become one check each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: quiet time after which a burst is over.
QUIET = "150 milliseconds"
_LATE = "rows bigint, late bigint, watermark bigint, newest bigint"
# Default of ``chunk_buckets``: buckets of one quiet time each that one task orders at a time. It bounds the work
# of a task; results do not depend on it.
CHUNK_BUCKETS = 100_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def debounce(
    df: DataFrame, keys: Sequence[str], ts: str, quiet_micros: int, chunk_buckets: int = CHUNK_BUCKETS
) -> DataFrame:
    """Sessions of a table: (keys, first, last, events), times in microseconds.

    Rows are first folded into buckets as wide as the quiet time, which cannot span two sessions, so
    a hot key is reduced before the shuffle. Buckets are then joined up inside chunks of time, and
    only the outermost sessions of each chunk are compared across chunks: no task ever orders all
    rows of one key.
    """
    keys = list(keys)
    buckets = (
        df.select(*keys, micros(F.col(ts)).alias("at"))
        .groupBy(*keys, F.floor(F.col("at") / F.lit(quiet_micros)).alias("bucket"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("events"))
        .withColumn("chunk", F.floor(F.col("bucket") / F.lit(chunk_buckets)))
    )

    def islands(rows: DataFrame, within: list[str]) -> DataFrame:
        order = Window.partitionBy(*within).orderBy("first")
        starts = F.coalesce(F.col("first") - F.lag("last").over(order) >= quiet_micros, F.lit(True))
        return rows.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(order))

    def fold(rows: DataFrame, within: list[str]) -> DataFrame:
        return rows.groupBy(*within, "island").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")
        )

    in_chunk = fold(islands(buckets, [*keys, "chunk"]), [*keys, "chunk"])
    last_island = F.max("island").over(Window.partitionBy(*keys, "chunk"))
    in_chunk = in_chunk.withColumn("edge", (F.col("island") == 1) | (F.col("island") == last_island))
    out = [*keys, "first", "last", "events"]
    edges = fold(islands(in_chunk.where("edge").drop("island"), keys), keys)
    return in_chunk.where("not edge").select(*out).unionByName(edges.select(*out))


def debounce_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, quiet: str = QUIET, delay: str = "10 minutes"
) -> DataFrame:
    """Sessions of a stream, each emitted once, when the watermark has passed its end.

    Rows later than ``delay`` behind the newest one are dropped; :class:`LateRows` counts them. The open session
    of one key is one state row, which every row of it goes to; :func:`debounce_hot_stream` spreads a hot key.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(*keys, F.session_window(ts, quiet).alias("burst"))
        .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last"))
        .select(*keys, F.col("burst.start").alias("first"), "last", F.col("burst.end").alias("due"), "events")
    )


def debounce_hot_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, quiet_micros: int, delay: str = "10 minutes"
) -> DataFrame:
    """As :func:`debounce_stream`, for streams with hot keys: two stateful operators, one behind the other.

    The first folds a key's rows into buckets as wide as the quiet time, which cannot span two bursts; each is a state
    row of its own, so the rows of one key lie on all partitions. When the watermark has passed a bucket, its one row
    goes on to the second operator, session windows with a gap of their own length and the quiet time: the
    open burst of a key is one state row there and takes one row for each bucket, whatever the traffic.

    The second operator must not find rows late that the first one has kept back until their bucket was over,
    so its clock is one quiet time ahead: it takes a burst from ``first`` plus the quiet time on, and a burst comes
    out when the watermark has passed its last row by twice the quiet time. Rows are those of :func:`debounce`.
    """
    keys, quiet = list(keys), F.lit(quiet_micros).cast("bigint")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    buckets = timed.groupBy(*keys, F.window(ts, f"{quiet_micros} microseconds").alias("bucket")).agg(
        F.min(micros(F.col(ts))).alias("first"), F.max(micros(F.col(ts))).alias("last"), F.count(F.lit(1)).alias("events")
    )
    # The shifted time is an event time as that of the buckets is: it carries the same watermark on.
    event_time = buckets.select(F.window_time("bucket").alias("time")).schema["time"].metadata
    ahead = buckets.select(*keys, "first", "last", "events", F.timestamp_micros(F.col("first") + quiet).alias("due", metadata=event_time))
    # Sessions that touch are merged; a gap of exactly the quiet time parts two bursts.
    length = F.concat((F.col("last") - F.col("first") + quiet - 1).cast("string"), F.lit(" microseconds"))
    bursts = ahead.groupBy(*keys, F.session_window("due", length).alias("burst")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")
    )
    return bursts.select(*keys, "first", "last", "events")


class LateRows:
    """Late rows of a stream as a table below ``folder``, one row per batch, so that no count is lost.

    A row is late if it is older than the watermark of its batch: the newest time of all earlier batches less
    ``delay``, as the engine's own watermark. Each batch overwrites its own sub-folders, so one that runs again
    leaves the same rows, and reads one row of the batch before it.
    """

    def __init__(self, spark: SparkSession, folder: str, ts: str, delay_micros: int):
        self.spark, self.folder, self.ts, self.delay = spark, folder.rstrip("/"), ts, delay_micros

    def process(self, batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id:
            newest = self.spark.read.schema(_LATE).parquet(f"{self.folder}/late/batch={batch_id - 1}").first()["newest"]
        at = micros(F.col(self.ts))
        watermark = F.lit(None if newest is None else newest - self.delay).cast("bigint")
        batch.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.coalesce(at < watermark, F.lit(False))).alias("late"),
            F.greatest(F.max(at), F.lit(newest).cast("bigint")).alias("newest"),
        ).select("rows", "late", watermark.alias("watermark"), "newest").write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"{_LATE}, batch bigint").option("basePath", f"{self.folder}/late").parquet(f"{self.folder}/late")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
