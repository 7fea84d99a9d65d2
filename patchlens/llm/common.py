"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a task, about, where the number of rows is known.
TASK_ROWS = 200_000


#: Rows of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of a session's Arrow batches, if they are not bounded more tightly yet.

    Plans read this setting when they run, after the call that made them, so it stays. Operators leave the session as it
    is; queries and stages of the pipeline, which stand for an application, call this.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """checkpoint() goes to the folder that spark.checkpoint.dir names; a local one only where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "patchlens-checkpoints"))


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder: a lost executor costs no recomputation.

    most: a bound on its rows, where one is known; the last stage then has a task for each TASK_ROWS of these, and no
    more files than tasks, however many partitions shuffles have.

    A checkpoint hands the planner's guess of its size and its constraints on to the next plan. A join guesses the
    product of its sides, so from one round of joins to the next these numbers have several times the digits, until
    planning takes minutes and the driver's memory; the rows are therefore taken over without either.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if most is not None:
        df = df.coalesce(max(1, -(-most // TASK_ROWS)))
    stored = df._jdf.checkpoint()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored.queryExecution().toRdd(), stored.schema(), False), spark)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def lengths(text: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value, 0 for null."""
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    sizes = np.diff(offsets).astype(np.int64)
    if text.null_count:
        sizes[~np.asarray(text.is_valid())] = 0
    return sizes


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most `most` bytes of text and `rows` rows, or is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, upto - at)
            at = upto


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
