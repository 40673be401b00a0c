"""Reports over results: long and wide metrics, rankings, summaries, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def to_wide(long: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """A column per metric, the mean of what is repeated."""
    return long.groupBy(*ids).pivot("metric", metrics).agg(F.avg("value"))


def ranking_summary(long: DataFrame, ids: tuple[str, ...] = ("model_id", "dimension")) -> DataFrame:
    """The best row of each metric; ties by the ids."""
    w = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"), *ids)
    return long.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def memory_summary(assignments: DataFrame, full_cost: int) -> DataFrame:
    """One row: bytes in all and a document, the bytes at full width, and the share that is saved."""
    a = assignments.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("cost_bytes"), F.lit(0)).alias("total_bytes"),
        F.avg("cost_bytes").alias("mean_bytes")
    )
    return a.withColumn("full_bytes", F.col("n_docs") * F.lit(full_cost)).withColumn(
        "saved_fraction", 1 - F.col("total_bytes") / F.greatest(F.col("full_bytes"), F.lit(1))
    )


def profile_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("profile").agg(
        F.count("*").alias("n_docs"), F.sum("cost_bytes").alias("cost_bytes"), F.sum("utility").alias("utility")
    )


def describe(df: DataFrame, column: str, by: list[str], points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Count, mean, spread, extremes and exact percentiles."""
    p = F.percentile(column, F.array(*map(F.lit, points)))
    stats = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"), p.alias("_p")
    )
    return stats.select(*by, "n", "mean", "std", "min", "max", *(F.col("_p")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(points)))


def canonical_union(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Frames of different columns as one of the given columns; what a frame lacks is null."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*(F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in columns))
