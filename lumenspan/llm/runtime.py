"""Shared plumbing: input tables, tables in the shared folder, small Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once. It bounds a worker's memory and is no limit on texts: a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch, of which a worker holds a few at once.
BATCH_BYTES = 8 << 20
_made: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_BYTES (a row at least); a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast; other columns, whatever they are called, stay out of the operator's way."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, which release() removes: below spark.checkpoint.dir as the cluster names it.
    Where it is unset, in local mode only, one below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/lumenspan-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Rows of a slim table for each file, and files that it may have in any case. On a local file system every file costs a task the
#: start of three processes, so an operator that writes many tables asks for FEW.
FILE_ROWS, FILES, FEW = 1 << 17, 16, 4


#: Spark's switch: an execution that has ended removes its shuffles.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, rows: int | None = None, cleanup: bool = False, least: int = FILES) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it survives the loss of any executor and is read by all. rows: about how
    many it has, if few files should hold them, `least` in any case. cleanup: the shuffles on the way are removed at once, not when the driver collects
    garbage; only the table is read again.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(least, -(-rows // FILE_ROWS)))
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if cleanup:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if cleanup:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_written", None)) in _made:
            _made.remove(path)
            _removed(df.sparkSession, path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; all that was written on the way is removed."""
    before = len(_made)
    out = materialize(make())
    for path in _made[before:]:
        if path != out._written:
            _made.remove(path)
            _removed(spark, path)
    return out


def _removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: Column, rows: int | None = None) -> DataFrame:
    """df with `_n`, the number of each row (from 0) in that order, written as a table. Rows are sorted in ranges; only each
    range's count reaches the driver. rows: as of materialize().
    """
    spark = df.sparkSession
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    own = materialize(own, rows)
    counts = sorted(map(tuple, own.groupBy("_part").agg(F.count("*")).collect()))
    if not counts:
        return own.drop("_part")
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "_part int, _from long")  # a row per partition
    return own.join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_n") + F.col("_from")).drop("_part", "_from")


#: What a broadcast table may hold, by the bytes of its values.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df as a table to be broadcast, if its values are counted to have `most` bytes at most; else as it is."""
    width = sum(
        (F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind == "string" else F.lit(0) for c, kind in df.dtypes),
        F.lit(16 * len(df.columns))
    )
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about `most` bytes of `column`, a row at least."""
    if not batch.num_rows:
        return
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def release(spark: SparkSession) -> int:
    """Remove the tables and folders that this process has made, once no result reads them any more. Returns how many."""
    n = len(_made)
    while _made:
        _removed(spark, _made.pop())
    return n
