"""Online choice of profiles on a stream: at the multiplier of a finished optimisation, a document's profile needs nothing but its
own vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenspan.functions import vectors as V
from lumenspan.operators import knapsack
from lumenspan.operators.profiles import Profile


def utilities(docs: DataFrame, profiles: list[Profile], p: int = 2) -> DataFrame:
    """`docno`, `u`: residual utilities in the order of the profiles."""
    return docs.select("docno", F.array(*(V.residual_utility("v", x.dimension, p) for x in profiles)).alias("u"))


def choose(docs: DataFrame, profiles: list[Profile], lam: float, p: int = 2, dtype: str = "float16") -> DataFrame:
    """`docno`, `profile`, `utility`, `cost_bytes` of a batch or a stream of `docno`, `v`."""
    costs = [x.cost(dtype) for x in profiles]
    k = knapsack.online(utilities(docs, profiles, p), costs, [x.name for x in profiles], lam)
    return k.select(
        "docno", "profile", F.element_at("u", F.col("k") + 1).alias("utility"),
        F.element_at(F.array(*(F.lit(c).cast("long") for c in costs)), F.col("k") + 1).alias("cost_bytes")
    )


def start(spark: SparkSession, source: str, schema: str, profiles: list[Profile], lam: float, sink: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of parquet files of `docno`, `v`; each file's documents are written once."""
    docs = spark.readStream.schema(schema).parquet(source)
    return choose(docs, profiles, lam).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
