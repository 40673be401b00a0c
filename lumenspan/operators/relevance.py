"""Relevance of (query, document) pairs: calibration, fusion, refinement, overrides by judgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions import scores as S
from lumenspan.functions.text import tokens

#: Names that configurations use.
CALIBRATIONS = ("minmax_score", "rank_log_discount", "constant_one")
ADJUSTMENTS = ("hard_override", "relevant_only_to_one")
MODES = ("weak", "model", "hybrid")
SOURCES = ("bm25", "dense", "hybrid_rerank")
PAIR = ("qid", "docno", "relevance_estimated", "relevance_final", "confidence", "uncertainty", "source_mode", "is_qrel_overridden")


def head(run: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ranks stay as they are, gaps included."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docno")
    return run.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def calibrate(run: DataFrame, how: str = "minmax_score", source_mode: str = "weak") -> DataFrame:
    """Pairs of a candidate run (`qid`, `docno`, `score`, `rank` from 0). Confidence is the distance to the query's second best."""
    if how not in CALIBRATIONS:
        raise ValueError(f"unknown calibration {how}")
    if how == "constant_one":
        out = run.withColumns({"relevance_estimated": F.lit(1.0), "confidence": F.lit(1.0)})
    else:
        if how == "minmax_score":
            w = Window.partitionBy("qid")
            low, high = F.min("score").over(w), F.max("score").over(w)
            out = run.withColumn("relevance_estimated", (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9)))
        else:
            out = run.withColumn("relevance_estimated", S.rank_discount(F.col("rank")))
        w2 = Window.partitionBy("qid").orderBy(F.desc("relevance_estimated"), "docno")
        out = out.withColumn("_n", F.row_number().over(w2))
        every = Window.partitionBy("qid")
        pivot = F.coalesce(
            F.max(F.when(F.col("_n") == 2, F.col("relevance_estimated"))).over(every),
            F.max(F.when(F.col("_n") == 1, F.col("relevance_estimated"))).over(every)
        )
        out = out.withColumn("confidence", S.clip(F.abs(F.col("relevance_estimated") - pivot))).drop("_n")
    return out.withColumns(
        {
            "relevance_final": F.col("relevance_estimated"), "uncertainty": 1 - F.col("confidence"),
            "source_mode": F.lit(source_mode), "is_qrel_overridden": F.lit(False)
        }
    ).select(*PAIR)


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two candidate runs as one: of a pair in both the higher raw score stays (the first run's, if equal), the k best of each
    query, ranked from 0 anew.
    """
    both = first.select("qid", "docno", "score", F.lit(0).alias("_s")).unionByName(
        second.select("qid", "docno", "score", F.lit(1).alias("_s"))
    )
    one = both.groupBy("qid", "docno").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docno")
    return one.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def uncertain_high_impact(pairs: DataFrame, fraction: float) -> DataFrame:
    """The keys of the max(1, n * fraction) pairs of all queries together that are most uncertain, then of most impact."""
    n = pairs.count()
    if not n:
        return pairs.select("qid", "docno")
    return pairs.orderBy(
        F.desc("uncertainty"), F.desc(S.impact(F.col("relevance_final"), F.col("uncertainty"))), "qid", "docno"
    ).limit(max(1, int(n * fraction))).select("qid", "docno")


def merge_refined(base: DataFrame, refined: DataFrame, source_mode: str = "hybrid") -> DataFrame:
    """base with the values of refined where it has the pair."""
    names = ("relevance_estimated", "relevance_final", "confidence", "uncertainty")
    r = refined.select("qid", "docno", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit"))
    j = base.join(r, ["qid", "docno"], "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in names}
    return j.withColumns({**new, "source_mode": F.when(F.col("_hit"), F.lit(source_mode)).otherwise(F.col("source_mode"))}).select(*PAIR)


def judged(
    pairs: DataFrame, qrels: DataFrame, how: str = "hard_override", scale: str = "minmax", low: float = 0.0,
    high: float = 3.0, mapping: dict[str, float] | None = None, threshold: float = 1.0, label: str = "label"
) -> DataFrame:
    """Pairs whose judgement overrides the estimate. A pair that is judged twice becomes two rows.

    hard_override: the label, scaled between low and high or by the mapping; a label that the mapping lacks keeps the estimate
    but counts as an override. relevant_only_to_one: 1 from the threshold on. Labels that aren't numbers judge nothing.
    """
    if how not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {how}")
    if label not in qrels.columns:
        raise ValueError(f"judgements have no column {label}")
    q = qrels.select("qid", "docno", S.number(F.col(label).cast("string")).alias("_label")).where("_label IS NOT NULL")
    j = pairs.join(q, ["qid", "docno"], "left")
    if how == "hard_override":
        hit = F.col("_label").isNotNull()
        value = S.unit_scale(F.col("_label"), low, high) if scale == "minmax" else S.label_lookup(
            F.col("_label"), mapping or {}, F.col("relevance_final")
        )
    else:
        hit, value = F.coalesce(F.col("_label") >= threshold, F.lit(False)), F.lit(1.0)
    return j.withColumns({"relevance_final": F.when(hit, value).otherwise(F.col("relevance_final")), "is_qrel_overridden": F.col("is_qrel_overridden") | hit}).select(*PAIR)


Scorer = Callable[[Column, Column], Column]


def overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: Jaccard similarity of the sets of terms."""
    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def rescore(candidates: DataFrame, topics: DataFrame, corpus: DataFrame, scorer: Scorer = overlap) -> DataFrame:
    """Candidates by a scorer of query and text, ranked from 0; pairs without either are left out."""
    j = candidates.select("qid", "docno").join(topics.select("qid", "query"), "qid").join(
        corpus.select("docno", "text"), "docno"
    ).dropna(subset=["query", "text"])
    s = j.select("qid", "docno", F.round(scorer(F.col("query"), F.col("text")), 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docno")) - 1)


def estimate(
    mode: str, candidates: DataFrame, topics: DataFrame, corpus: DataFrame, calibration: str = "minmax_score",
    fraction: float = 0.2, scorer: Scorer = overlap
) -> DataFrame:
    """weak: candidates calibrated; model: rescored, then calibrated; hybrid: weak, with the uncertain pairs of high impact rescored."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "model":
        return calibrate(rescore(candidates, topics, corpus, scorer), calibration, "model")
    weak = calibrate(candidates, calibration, "weak")
    if mode == "weak":
        return weak
    keys = uncertain_high_impact(weak, fraction)
    return merge_refined(weak, calibrate(rescore(candidates.join(keys, ["qid", "docno"], "left_semi"), topics, corpus, scorer), calibration, "model"))
