"""Utility of each (document, profile): from vectors alone, from a query log, or for documents that no query reached."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions import scores as S
from lumenspan.functions import vectors as V
from lumenspan.operators import dense, sampled
from lumenspan.operators.knapsack import running
from lumenspan.operators.profiles import Profile, check, with_profiles


def residual(docs: DataFrame, profiles: list[Profile], p: int = 2, epsilon: float = 1e-12) -> DataFrame:
    """`docno`, `profile`, `utility` of documents (`docno`, `v`), one narrow pass."""
    check(profiles)
    return with_profiles(docs.select("docno", "v"), profiles).select(
        "docno", "profile", V.residual_utility("v", F.col("dimension"), p, epsilon).alias("utility")
    )


def report(table: DataFrame) -> DataFrame:
    """`profile`, `n`, `min_utility`, `mean_utility`, `max_utility`."""
    return table.groupBy("profile").agg(
        F.count("*").alias("n"), F.min("utility").alias("min_utility"), F.avg("utility").alias("mean_utility"),
        F.max("utility").alias("max_utility")
    )


def hard_negatives(scored: DataFrame, score: str, k: int, keys: tuple[str, ...] = ("qid", "profile")) -> DataFrame:
    """scored with `<score>_negative` and `n`: the mean of the k best scores of a row's group without its own.

    One window pass: if a row is among the k best, leaving it out lets the next one in.
    """
    every = Window.partitionBy(*keys)
    rank = F.row_number().over(every.orderBy(F.desc(score), "docno"))
    s = scored.withColumns({"n": F.count("*").over(every), "_r": rank}).withColumn("_k", F.least(F.lit(k), F.col("n") - 1))
    s = s.withColumns(
        {
            "_more": F.sum(F.when(F.col("_r") <= F.col("_k") + 1, F.col(score))).over(every),
            "_best": F.sum(F.when(F.col("_r") <= F.col("_k"), F.col(score))).over(every)
        }
    )
    mean = F.when(F.col("_k") > 0, F.when(F.col("_r") <= F.col("_k"), F.col("_more") - F.col(score)).otherwise(F.col("_best")) / F.col("_k"))
    return s.withColumn(f"{score}_negative", mean).drop("_r", "_k", "_more", "_best")


def preserved(
    pairs: DataFrame, queries: DataFrame, docs: DataFrame, profiles: list[Profile], metric: str = S.METRICS[0],
    similarity: str = "dot", epsilon: float = 1e-6, alpha: float = 0.7, negatives: int = 4
) -> DataFrame:
    """Pairs by profile with `full_score`, `reduced_score`, `score_preservation`."""
    s = dense.pair_scores(pairs, queries, docs, profiles, similarity)
    full, reduced = F.col("full_score"), F.col("reduced_score")
    if metric in S.MARGIN_METRICS:
        s = hard_negatives(hard_negatives(s, "full_score", negatives), "reduced_score", negatives)
        return s.withColumn(
            "score_preservation",
            S.preservation(metric, full, reduced, F.col("full_score_negative"), F.col("reduced_score_negative"), F.col("n"), epsilon, alpha)
        ).drop("full_score_negative", "reduced_score_negative", "n")
    return s.withColumn("score_preservation", S.preservation(metric, full, reduced, epsilon=epsilon))


def observed(pairs: DataFrame, *args, **options) -> DataFrame:
    """Score pairs with `utility`, relevance times preservation."""
    return preserved(pairs, *args, **options).withColumn("utility", F.col("relevance_final") * F.col("score_preservation"))


def mean_utility(score_pairs: DataFrame) -> DataFrame:
    return score_pairs.groupBy("docno", "profile").agg(F.avg("utility").alias("utility"))


def default(docs: DataFrame, profiles: list[Profile], name: str = "full") -> DataFrame:
    """1 for the default profile, 0 for others."""
    if name not in [p.name for p in profiles]:
        raise ValueError(f"no profile is called {name}")
    return with_profiles(docs.select("docno"), profiles).select(
        "docno", "profile", F.when(F.col("profile") == name, 1.0).otherwise(0.0).alias("utility")
    )


@dataclass(frozen=True)
class Tail:
    """How unranked documents share the relevance that ranked ones leave."""

    mode: str = "static_default"
    target_residual: float = 0.01
    beta: float | None = 0.5
    expected_fraction: float = 0.5
    cap: float = 0.01
    quality: str = "cosine_padding"
    sampled_queries: int = 32
    low: float = 0.0


def sampled_quality(
    docs: DataFrame, queries: DataFrame, profiles: list[Profile], metric: str = S.METRICS[0], similarity: str = "dot",
    n: int = 32, seed: int = 13, epsilon: float = 1e-6, alpha: float = 0.7, negatives: int = 4, chunk: int = 512
) -> DataFrame:
    """`docno`, `profile`, `profile_quality`: the mean preservation over at most n queries drawn by a seed, within 0 and 1. A stated number of queries meets all documents.

    Margin metrics take a document's negatives from its chunk, `chunk` documents in order of docno.
    """
    if metric not in S.METRICS:
        raise ValueError(f"unknown metric {metric}")
    drawn = queries if queries.count() <= n else queries.orderBy(F.xxhash64(F.lit(seed), "qid"), "qid").limit(n)
    own = docs.select("docno", "v")
    if metric in S.MARGIN_METRICS:
        at = running(docs.select("docno", F.lit(1).alias("one")), ((F.asc, "docno"),), "one")
        own = own.join(at.select("docno", F.floor(F.col("_pos") / chunk).alias("chunk")), "docno")
    found = sampled.sums(own, drawn, [p.dimension for p in profiles], metric, similarity, epsilon, alpha, negatives)
    mean = lambda i: S.clip(F.when(F.col("n") > 0, F.col(f"t{i}") / F.col("n")))
    return found.groupBy("docno").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(len(profiles)))).select(
        "docno", F.inline(F.array(*(F.struct(F.lit(p.name).alias("profile"), mean(i).alias("profile_quality")) for i, p in enumerate(profiles))))
    )


def padding_quality(docs: DataFrame, profiles: list[Profile]) -> DataFrame:
    return with_profiles(docs.select("docno", "v"), profiles).select(
        "docno", "profile", V.padding_quality("v", F.col("dimension")).alias("profile_quality")
    )


def tail_utility(unranked: DataFrame, docs: DataFrame, quality: DataFrame, tail: Tail) -> DataFrame:
    """`docno`, `profile`, `utility`, `profile_quality` of unranked documents. Their number counts before those without a vector
    are left out.
    """
    n = unranked.count()
    e, u = S.rbp_masses(tail.target_residual, tail.expected_fraction, tail.cap, n)
    q = F.col("profile_quality")
    utility = F.greatest(F.lit(0.0), e * q - tail.beta * u * q) if tail.beta is not None else F.lit(float(tail.low))
    return quality.join(
        unranked.select("docno").intersect(docs.select("docno")), "docno", "left_semi"
    ).select("docno", "profile", utility.alias("utility"), "profile_quality")


def tail_report(tail: Tail, scored: DataFrame | None, unranked: int) -> dict:
    """What a tail amounts to: its settings, masses for a document, mean quality of each profile, least, mean and largest utility.
    scored: tail_utility()'s rows; None or no documents give zeros.
    """
    e, u = S.rbp_masses(tail.target_residual, tail.expected_fraction, tail.cap, unranked) if unranked and scored is not None else (0.0, 0.0)
    rows = scored.groupBy("profile").agg(
        F.avg("profile_quality").alias("q"), F.min("utility").alias("a"), F.sum("utility").alias("s"),
        F.max("utility").alias("b"), F.count("*").alias("n")
    ).collect() if unranked and scored is not None else []
    n = sum(r["n"] for r in rows)
    return {
        "tail_mode": tail.mode, "tail_unranked_docs": unranked, "tail_target_residual": tail.target_residual, "tail_expected_relevance_per_doc": e, "tail_uncertainty_per_doc": u, "tail_profile_quality": tail.quality,
        "tail_profile_quality_mean_by_profile": {r["profile"]: r["q"] for r in rows}, "tail_beta": tail.beta, "tail_utility_min": min((r["a"] for r in rows), default=0.0), "tail_utility_mean": sum(r["s"] for r in rows) / n if n else 0.0, "tail_utility_max": max((r["b"] for r in rows), default=0.0),
    }


def table(
    docs: DataFrame, profiles: list[Profile], means: DataFrame | None, tail: DataFrame | None = None,
    default_name: str = "full"
) -> DataFrame:
    """Exactly one `utility` for each document and profile: observed, else the tail's, else the default."""
    t = default(docs, profiles, default_name).withColumnRenamed("utility", "_d")
    known = [x.select("docno", "profile", F.col("utility").alias(f"_{i}")) for i, x in enumerate((means, tail)) if x is not None]
    t = reduce(lambda a, b: a.join(b, ["docno", "profile"], "left"), known, t)
    return t.select("docno", "profile", F.coalesce(*(F.col(c) for c in t.columns if c in ("_0", "_1")), F.col("_d")).alias("utility"))


def coverage(docs: DataFrame, pairs: DataFrame, means: DataFrame) -> DataFrame:
    """One row: pairs, documents and queries in them, overrides, documents without observed utility and their share."""
    a = pairs.agg(
        F.count("*").alias("n_pairs"), F.countDistinct("docno").alias("pair_docs"),
        F.countDistinct("qid").alias("pair_queries"),
        F.coalesce(F.sum(F.col("is_qrel_overridden").cast("long")), F.lit(0)).alias("overrides")
    )
    n = docs.join(means.select("docno").distinct().withColumn("_o", F.lit(1)), "docno", "left").agg(
        F.count("*").alias("n_docs"), F.sum(F.when(F.col("_o").isNull(), 1).otherwise(0)).alias("default_docs")
    )
    return a.join(F.broadcast(n)).withColumn("default_fraction", F.col("default_docs") / F.greatest(F.col("n_docs"), F.lit(1)))


#: Estimators by name: what configurations call them.
ESTIMATORS = {"residual_norm": residual, "query_log": observed}


def estimator(name: str):
    if name not in ESTIMATORS:
        raise ValueError(f"utility.estimator is one of {sorted(ESTIMATORS)}, not {name}")
    return ESTIMATORS[name]
