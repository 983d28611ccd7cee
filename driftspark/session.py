"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEAL = "driftspark.input.partitions"
# Rows of a task of a table that is dealt out.
LEAST_ROWS, MOST_ROWS = 2_000, 100_000
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Runtime settings the operators expect.
REQUIRED = {
    # JSON objects with a repeated key keep the last value instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    # Hot keys of joins are split at run time, also where what follows was to stay in place and moves once more then.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Bursts are merged inside each task before they are shuffled, which takes the load off hot keys,
    # and streaming state lives on disk instead of the heap.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`REQUIRED` to a session.

    This changes the session for everything else that runs in it: times are read and shown in UTC, repeated
    JSON keys no longer fail, skewed joins are split, and streaming queries started later keep their state in
    RocksDB. Give the operators a session of their own (``spark.newSession()``) where that is not wanted.
    """
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, deal: int | None = None, warehouse: str | None = None
) -> SparkSession:
    """A session for tests and benches; on a cluster, pass the existing one to :func:`configure`.

    ``deal`` is the setting of :func:`dealt`; ``warehouse`` also takes intermediate tables where
    ``spark.checkpoint.dir`` is unset.
    """
    builder = (
        SparkSession.builder.appName("driftspark")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    if deal:
        builder = builder.config(DEAL, str(deal))
    return configure(builder.getOrCreate())


def dealt(table: DataFrame, counted: bool = True) -> DataFrame:
    """``table`` dealt out, so that what is made of its rows is made by all cores and no task makes it of very many.

    A Parquet file of one row group is one busy task whatever the number of cores. Tables whose largest task holds
    more than twice its share are dealt out, over two tasks a core of :data:`LEAST_ROWS` or more, and as many as
    keep a task at :data:`MOST_ROWS`; others are not moved. The rows of each task are counted without reading a column.
    The setting ``driftspark.input.partitions`` deals every table out over so many tasks instead; with ``counted=False``,
    for rows that are costly to move, nothing else does.
    """
    spark = table.sparkSession
    partitions = spark.conf.get(DEAL, None)
    if partitions:
        return table.repartition(int(partitions))
    if not counted:
        return table
    held = table.groupBy(F.spark_partition_id().alias("task")).count()
    rows, most = held.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    tasks = max(min(2 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // MOST_ROWS), 1)
    return table.repartition(tasks) if most > 2 * -(-rows // tasks) else table


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, which every executor can reach.

    It lies below the cluster's ``spark.checkpoint.dir`` or, where that is unset, below the warehouse, which is
    shared storage as well; never in a folder of one machine. :func:`clean_up` removes it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/driftspark-{spark.conf.get('spark.app.id')}"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in this block give their shuffle files back as soon as they are done."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of results that several later steps read: they start from files that outlive
    any executor, their plans stay small, and joins see the true size of the table. The shuffle files of
    the write are not needed any more and are given back at once. Files are packed more tightly than by default, as
    they are read a few times only and count in full on the shared disks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Remove the application's intermediate tables. For the owner of a job, once no result that was built
    on them is read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
