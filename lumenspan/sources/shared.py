"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which release() removes. Where that is unset, in local mode only, one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/lumenspan-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: neither recomputed nor lost with executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a broadcast table may hold, by the bytes of its values.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df as a table to be broadcast, if its values are counted to have `most` bytes at most; else as it is."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if kind == "string" else F.lit(0) for c, kind in df.dtypes),
        F.lit(16 * len(df.columns))
    )
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files make fewer partitions than that; the usual many files stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def release(spark: SparkSession) -> int:
    """Remove the tables that this process has made, once no result reads them any more. Returns how many."""
    jvm, n = spark.sparkContext._jvm, len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
