"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

import driftspark
from driftspark.session import settle

# White space of all operators on words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
# A batch of rows between Spark and a Python worker: both hold it whole, and several copies of its texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it is not installed but its folder can be reached, and bounds the
    batches of rows that they get (:data:`BATCH`).

    It adds to the path of the workers only; a cluster without such a folder gets the package as usual, by
    installation or ``--py-files``. The bound holds for the session, as those of ``session.configure``.
    """
    for setting, most in BATCH.items():
        spark.conf.set(setting, most)
    root = os.path.dirname(os.path.dirname(os.path.abspath(driftspark.__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    rows: DataFrame, keys: Sequence[str], text: str, make: Callable[[], Callable[[str | None], tuple]], result: str
) -> DataFrame:
    """``keys`` and the columns of ``result`` (a DDL string) that ``make()`` gives for each whole text.

    Runs where the rows are (no shuffle). ``make`` is called once per task, for models and dictionaries.
    Other columns of ``rows`` are not carried, so none can clash with those of ``result``.
    """
    ready(rows.sparkSession)
    added = StructType.fromDDL(result)
    source = rows.select(*keys, F.col(text).alias("__text"))
    schema = StructType([*(source.schema[k] for k in keys), *added.fields])
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # Small slices: one Arrow batch may hold 10,000 long texts.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [work(t) for t in part.column(len(names) - len(types)).to_pylist()]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names)

    return source.mapInArrow(run, schema)


def numbered(rows: DataFrame, group: str, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """``rows`` with ``slot`` (gapless from 0 within ``group``, in ``order``) and ``before`` (sum of
    ``weight`` over the earlier rows of the group). ``group`` must have few values (buckets, shards).

    No task holds a whole group: rows are range-partitioned by group and order, so a group of any size is
    spread over tasks, each task counts its own rows in a stream, and the counts of the earlier tasks are
    added. The numbering is written once before it is read twice, so a lost executor cannot change the
    partitions under it.
    """
    ready(rows.sparkSession)
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    names = rows.columns
    added = StructType.fromDDL("__task long, slot long, before long, __weight long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        carry = None  # group, rows and weight so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(group)).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            weights = batch.column(names.index(weight)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            run_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(codes)]))
            slot = np.arange(len(codes)) - first[run_of]
            before = np.cumsum(weights) - weights
            before = before - before[first][run_of]
            values = keys.dictionary.to_pylist()
            if carry is not None and values[codes[0]] == carry[0]:
                slot[run_of == 0] += carry[1]
                before[run_of == 0] += carry[2]
            carry = (values[codes[-1]], int(slot[-1]) + 1, int(before[-1] + weights[-1]))
            task = np.full(len(codes), TaskContext.get().partitionId(), np.int64)
            extra = [pa.array(x, pa.int64()) for x in (task, slot, before, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, *added.names])

    counted = settle(dealt.mapInArrow(run, StructType([*rows.schema.fields, *added.fields])), name)
    ends = counted.groupBy("__task", F.col(group).alias("__group")).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__weight").alias("__sum")
    )
    earlier = Window.partitionBy("__group").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(
        F.col("__task").alias("__of"), "__group",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__slot"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
    )
    # At most one row for each task and one more for each group, whatever the number of rows.
    same = (F.col("__task") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group"))
    return counted.join(F.broadcast(starts), same, "left").select(
        *names, (F.col("slot") + F.col("__slot")).alias("slot"), (F.col("before") + F.col("__before")).alias("before")
    )
