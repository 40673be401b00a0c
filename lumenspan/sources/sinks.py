"""Writers. A table or file is written beside its place and moved there, so a reader never sees a part of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _moved(spark: SparkSession, made: str, path: str) -> None:
    fs, to = _at(spark, path)
    fs.delete(to, True)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if not fs.rename(_at(spark, made)[1], to):
        raise OSError(f"{made} can't be moved to {path}")


def _beside(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name}.{uuid.uuid4().hex}" if folder else f"_{name}.{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, kind: str = "parquet", rows_per_file: int = 0) -> None:
    """As parquet or CSV with a header. What is at path stays until the new table is whole; an empty table has its columns."""
    w = df.write
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    made = _beside(path)
    if kind == "parquet":
        w.parquet(made)
    elif kind == "csv":
        w.option("header", True).csv(made)
    else:
        raise ValueError(f"tables are written as parquet or csv, not {kind}")
    _moved(df.sparkSession, made, path)


def save_vectors(docs: DataFrame, path: str, megabytes: int = 500) -> None:
    """`docno`, `full_embedding` of documents (`docno`, `v`), in files of so many megabytes of components at most."""
    width = docs.selectExpr("max(size(v))").first()[0] or 1
    save(docs.selectExpr("docno", "v AS full_embedding"), path, rows_per_file=max(1, (megabytes << 20) // (4 * max(width, 1))))


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    made = _beside(path)
    fs, at = _at(spark, made)
    out = fs.create(at)
    out.write(bytearray(text.encode()))
    out.close()
    _moved(spark, made, path)


def save_json(spark: SparkSession, value: object, path: str) -> None:
    save_text(spark, json.dumps(value, indent=2, sort_keys=True, default=str), path)


def save_config(spark: SparkSession, config: object, path: str) -> None:
    """A snapshot of a configuration as YAML, which config.load reads again."""
    import yaml

    from lumenspan.sources.config import snapshot

    save_text(spark, yaml.safe_dump(snapshot(config), sort_keys=False, allow_unicode=True), path)


def save_benchmark(long: DataFrame, ids: list[str], metrics: list[str], folder: str, metadata: dict) -> None:
    """metrics_long, metrics_wide, ranking_summary, run_metadata."""
    from lumenspan.operators import reporting as R

    save(long, f"{folder}/metrics_long.csv", "csv")
    save(R.to_wide(long, ids, metrics), f"{folder}/metrics_wide.csv", "csv")
    save(R.ranking_summary(long), f"{folder}/ranking_summary.csv", "csv")
    save_json(long.sparkSession, metadata, f"{folder}/run_metadata.json")
