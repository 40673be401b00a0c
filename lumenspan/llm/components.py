"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.runtime import FEW, discard, materialize


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: `a`, `b` longs, about `rows` if that is known. Returns `node`, `root` for each node but the roots, root the smallest node that it reaches.

    Nothing but a yes or no reaches the driver. Each round hangs every node on the smallest in sight, which about squares the
    distance covered; hubs are split by adaptive joins, and their minima are pre-aggregated. Loops, repeated edges and edges
    with a null end are left out; a table without edges gives no rows.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), rows, least=FEW)
    n = e.count()  # no round adds edges
    while True:
        both = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = materialize(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct(), n, least=FEW)
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        last, e = e, materialize(small.union(lowest.select("x", F.col("m").alias("y"))).distinct(), n, least=FEW)
        discard(last, large)
        two = e.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x")
        deep = e.join(e.select(F.col("x").alias("p")), F.col("y") == F.col("p"), "left_semi").select("x")
        if not two.union(deep).take(1):
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
