"""Ranking measures, comparison of runs, and significance.

Runs are ordered by score, ties to the smaller docno; ranks that they carry aren't used. Every query with a judgement counts,
one that a run lacks with 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: map and recip_rank count labels of 1 or more as relevant and have no cutoff.
MEASURES = ("ndcg10", "ap_rel2", "rr_rel2", "rr10", "recall100", "map", "recip_rank")


def per_query(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """`run`, `qid` and all measures. runs: `run`, `qid`, `docno`, `score`; qrels: `qid`, `docno`, `label`."""
    judged = qrels.where("label IS NOT NULL").groupBy("qid", "docno").agg(F.max("label").alias("label"))
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("label"), "docno"))
    ideal = judged.withColumn("_n", ideal_rank).groupBy("qid").agg(
        F.sum(F.when((F.col("_n") <= 10) & (F.col("label") > 0), F.col("label") / F.log2(F.col("_n") + 1)).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(F.col("label") >= 1, 1).otherwise(0)).alias("rel1"),
        F.sum(F.when(F.col("label") >= 2, 1).otherwise(0)).alias("rel2")
    )
    w = Window.partitionBy("run", "qid").orderBy(F.desc("score"), "docno")
    ranked = runs.join(
        ideal.select("qid"), "qid", "left_semi"
    ).withColumn("n", F.row_number().over(w)).join(judged, ["qid", "docno"], "left")
    hits = lambda label: F.sum(
        F.when(F.col("label") >= label, 1).otherwise(0)
    ).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumns({"hits1": hits(1), "hits2": hits(2)})
    precision = lambda label: F.sum(F.when(F.col("label") >= label, F.col(f"hits{label}") / F.col("n")).otherwise(0.0))
    got = ranked.groupBy("run", "qid").agg(
        F.sum(F.when((F.col("n") <= 10) & (F.col("label") > 0), F.col("label") / F.log2(F.col("n") + 1)).otherwise(0.0)).alias("dcg"),
        precision(2).alias("ap"),
        precision(1).alias("ap1"),
        F.min(F.when(F.col("label") >= 2, F.col("n"))).alias("first2"),
        F.min(F.when(F.col("label") >= 1, F.col("n"))).alias("first1"),
        F.sum(F.when((F.col("label") >= 1) & (F.col("n") <= 100), 1).otherwise(0)).alias("top"),
    )
    every = ideal.join(F.broadcast(runs.select("run").distinct()))  # the runs of an experiment are a few names
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0.0)) / F.col(b)).otherwise(0.0)
    return every.join(got, ["run", "qid"], "left").select(
        "run", "qid", share("dcg", "idcg").alias("ndcg10"), share("ap", "rel2").alias("ap_rel2"),
        F.coalesce(1 / F.col("first2"), F.lit(0.0)).alias("rr_rel2"),
        F.coalesce(F.when(F.col("first1") <= 10, 1 / F.col("first1")), F.lit(0.0)).alias("rr10"),
        share("top", "rel1").alias("recall100"), share("ap1", "rel1").alias("map"),
        F.coalesce(1 / F.col("first1"), F.lit(0.0)).alias("recip_rank")
    )


def means(scores: DataFrame, digits: int = 4) -> DataFrame:
    return scores.groupBy("run").agg(*(F.round(F.avg(m), digits).alias(m) for m in MEASURES))


def long(scores: DataFrame) -> DataFrame:
    return scores.unpivot(["run", "qid"], list(MEASURES), "metric", "value")


def compare(scores: DataFrame, baseline: str) -> DataFrame:
    """`run`, `metric`, `mean`, queries better (`wins`) and worse (`losses`) than the baseline, `t` of the paired differences (null
    without spread) and their number `n`.
    """
    s = long(scores)
    b = s.where(F.col("run") == baseline).select("qid", "metric", F.col("value").alias("base"))
    d = s.join(b, ["qid", "metric"]).withColumn("d", F.col("value") - F.col("base"))
    sd = F.stddev_samp("d")
    return d.groupBy("run", "metric").agg(
        F.avg("value").alias("mean"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("losses"),
        F.when(sd > 1e-12, F.avg("d") / (sd / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("n")
    )


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def p_value(t: float | None, n: int) -> float | None:
    """Two-sided, of a t statistic with n - 1 degrees of freedom."""
    if t is None or n < 2:
        return None
    return incomplete_beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def significance(compared: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """compare()'s rows with `p_value`, `p_corrected` (Bonferroni over the runs that aren't the baseline) and `reject`. A row per
    run and measure reaches the driver.
    """
    rows = compared.collect()
    tests = len({r["run"] for r in rows} - {baseline})
    out = []
    for r in rows:
        p = p_value(r["t"], r["n"]) if r["run"] != baseline else None
        q = None if p is None else min(1.0, p * tests)
        out.append((*r, p, q, q is not None and q < alpha))
    from pyspark.sql.types import BooleanType, DoubleType

    return compared.sparkSession.createDataFrame(
        out, compared.schema.add("p_value", DoubleType()).add("p_corrected", DoubleType()).add("reject", BooleanType())
    )


def by_run(scores: DataFrame) -> dict[str, dict[str, float]]:
    return {r["run"]: {m: r[m] for m in MEASURES} for r in means(scores).collect()}
