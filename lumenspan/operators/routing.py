"""Which queries utilities are learned from and which runs are evaluated on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("shared", "split_by_qrels", "dual_source")


@dataclass
class Routed:
    opt_topics: DataFrame
    opt_qrels: DataFrame
    eval_topics: DataFrame
    eval_qrels: DataFrame
    mode: str


def shared(topics: DataFrame, qrels: DataFrame) -> Routed:
    return Routed(topics, qrels, topics, qrels, "shared")


def split_by_qrels(topics: DataFrame, qrels: DataFrame, allow_empty: bool = False) -> Routed:
    """Judged queries evaluate, the others optimise; an error if there are none of either, unless a side may be empty."""
    judged = qrels.select("qid").distinct()
    ev, opt = topics.join(judged, "qid", "left_semi"), topics.join(judged, "qid", "left_anti")
    for what, own in (("judged", ev), ("unjudged", opt)):
        if not allow_empty and not own.take(1):
            raise ValueError(f"there are no {what} queries to split off")
    return Routed(opt, qrels.join(opt.select("qid"), "qid", "left_semi"), ev, qrels.join(ev.select("qid"), "qid", "left_semi"), "split_by_qrels")


def dual_source(opt_topics: DataFrame, opt_qrels: DataFrame, eval_topics: DataFrame, eval_qrels: DataFrame) -> Routed:
    return Routed(opt_topics, opt_qrels, eval_topics, eval_qrels, "dual_source")


def overlap(a: DataFrame, b: DataFrame) -> int:
    return a.select("qid").intersect(b.select("qid")).count()


def metadata(r: Routed) -> DataFrame:
    """One row: the numbers of queries and judgements on both sides, and of queries on both."""
    ids = lambda d: d.select("qid").distinct()
    one = lambda d, name, c: d.agg(c.alias(name))
    parts = [
        one(r.opt_topics, "opt_queries", F.countDistinct("qid")),
        one(r.eval_topics, "eval_queries", F.countDistinct("qid")), one(r.opt_qrels, "opt_qrels", F.count("*")),
        one(r.eval_qrels, "eval_qrels", F.count("*")),
        one(ids(r.opt_topics).intersect(ids(r.eval_topics)), "overlap", F.count("*"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out.withColumn("mode", F.lit(r.mode))


def utility_qrels(r: Routed) -> DataFrame:
    """Judgements that may override estimates: none if a query is on both sides, or they would leak into the evaluation."""
    return r.opt_qrels if overlap(r.opt_topics, r.eval_topics) == 0 else r.opt_qrels.limit(0)
