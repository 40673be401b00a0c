"""The catalogue of profiles: prefix lengths of a vector with their cost in bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.scores import DTYPE_BYTES


@dataclass(frozen=True)
class Profile:
    name: str
    dimension: int
    cost_bytes: int | None = None
    layer: int | None = None
    normalize: bool = True

    def cost(self, dtype: str = "float16") -> int:
        return int(self.cost_bytes) if self.cost_bytes is not None else self.dimension * DTYPE_BYTES.get(dtype, 4)


def check(profiles: list[Profile], width: int | None = None, full: str = "full") -> None:
    names = [p.name for p in profiles]
    if not names or len(set(names)) != len(names):
        raise ValueError("profiles need unique names")
    if any(p.dimension <= 0 or p.cost() <= 0 for p in profiles):
        raise ValueError("dimensions and costs are positive")
    if full not in names:
        raise ValueError(f"no profile is called {full}")
    own = next(p.dimension for p in profiles if p.name == full)
    if max(p.dimension for p in profiles) > own or width is not None and own != width:
        raise ValueError(f"{full} has the width of the vectors, and no profile more")


def frame(spark: SparkSession, profiles: list[Profile], dtype: str = "float16") -> DataFrame:
    """`idx` (from 0), `profile`, `dimension`, `cost_bytes`."""
    return spark.createDataFrame(
        [(i, p.name, p.dimension, p.cost(dtype)) for i, p in enumerate(profiles)],
        "idx int, profile string, dimension int, cost_bytes long"
    )


def exploded(profiles: list[Profile], dtype: str = "float16") -> Column:
    """A row for each profile, as a struct; no join is needed."""
    return F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("idx"), F.lit(p.name).alias("profile"), F.lit(p.dimension).alias("dimension"),
                    F.lit(p.cost(dtype)).cast("long").alias("cost_bytes")
                ) for i,
                p in enumerate(profiles)
            )
        )
    )


def with_profiles(df: DataFrame, profiles: list[Profile], dtype: str = "float16") -> DataFrame:
    return df.withColumn("_p", exploded(profiles, dtype)).select(
        *(c for c in df.columns), "_p.idx", "_p.profile", "_p.dimension", "_p.cost_bytes"
    )
