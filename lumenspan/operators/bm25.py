"""An inverted index as tables, and BM25 or TF-IDF runs over it.

Terms are lower-cased runs of letters and digits. BM25 is idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term that a query repeats counts as often.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.text import sanitize_query, tokens
from lumenspan.sources.shared import kept, small, spread

K1, B = 1.2, 0.75
MODELS = ("BM25", "TF_IDF")


@dataclass
class Index:
    """postings: `term`, `docno`, `tf`, `dl`; lengths: `docno`, `dl`; terms: `term`, `df`."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame

    def stats(self) -> DataFrame:
        """One row: `n_docs`, `n_terms`, `n_postings`, `n_tokens`, `avgdl`. Documents without terms count."""
        d = self.lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.avg("dl").alias("avgdl"))
        t = self.terms.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
        return d.join(F.broadcast(t)).select("n_docs", "n_terms", "n_postings", "n_tokens", "avgdl")

    def save(self, path: str) -> None:
        for name in ("postings", "lengths", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "terms")))


def query_terms(topics: DataFrame) -> DataFrame:
    """`qid`, `term`, `qtf`."""
    return topics.select(
        "qid", F.explode(tokens(sanitize_query(F.col("query")))).alias("term")
    ).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def build(corpus: DataFrame, only: DataFrame | None = None) -> Index:
    """Of `docno`, `text`; null texts are empty. A whole index splits texts once, into a kept table of their terms.

    only: a table of `term`; no others are indexed, which is enough for runs of topics of these terms, but not for stats(). Then
    postings are found in one pass, and lengths in another.
    """
    split = spread(corpus.select("docno", "text")).select(
        "docno", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t")
    )
    t = kept(split) if only is None else split
    words = t.select("docno", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    if only is not None:
        words = words.join(small(only.select("term").distinct()), "term", "left_semi")
    postings = words.groupBy("docno", "dl", "term").agg(F.count("*").alias("tf"))
    postings = kept(postings) if only is not None else postings
    return Index(postings, t.select("docno", F.size("t").cast("long").alias("dl")), postings.groupBy("term").agg(F.count("*").alias("df")))


def resolve(spark: SparkSession, path: str | None, corpus: DataFrame | None, build_if_missing: bool = True) -> Index:
    """A saved index if there is one with terms, else one built from corpus and saved; an error if that isn't allowed."""
    if path:
        try:
            index = Index.load(spark, path)
            if index.terms.take(1):
                return index
        except Exception as e:  # noqa: BLE001  the reader's kinds of absence differ by file system
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    if not build_if_missing or corpus is None:
        raise FileNotFoundError(f"no index at {path}, and none may be built")
    index = build(corpus)
    if path:
        index.save(path)
        index = Index.load(spark, path)
    return index


def run(index: Index, topics: DataFrame, k: int, model: str = "BM25", first_rank: int = 0) -> DataFrame:
    """`qid`, `docno`, `score`, `rank`: each query's k best documents, ties to the smaller docno; ranks from 0.

    Postings are dealt out by document once; there they meet the queries' terms, and only sums and then each query's best move on.
    """
    if model not in MODELS:
        raise ValueError(f"the model is one of {MODELS}, not {model}")
    q = query_terms(topics)
    n = index.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = small(kept(q.join(index.terms, "term").join(F.broadcast(n))))  # broadcast, scores add up where a document's postings are
    hits = index.postings.repartition("docno").join(asked, "term")
    if model == "BM25":
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    else:
        weight = (1 + F.log("tf")) * F.log(1 + F.col("n") / F.col("df"))
    s = hits.groupBy("qid", "docno").agg(F.round(F.sum(F.col("qtf") * weight), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docno")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1 + first_rank)
