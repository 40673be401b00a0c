"""Readers with fixed schemas. Ids are strings from here on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.functions.text import compose_text

QRELS = "qid string, docno string, label int"


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def topics(spark: SparkSession, path: str, query_column: str = "query", max_queries: int | None = None) -> DataFrame:
    """`qid`, `query` of a tab-separated file with a header; the first max_queries by qid if that is given."""
    t = _tsv(spark, path)
    if "qid" not in t.columns or query_column not in t.columns:
        raise ValueError(f"topics need qid and {query_column}, not {t.columns}")
    t = t.select("qid", F.col(query_column).alias("query"))
    return t.orderBy("qid").limit(max_queries) if max_queries else t


def qrels(spark: SparkSession, path: str | None, label_column: str = "label", of: DataFrame | None = None) -> DataFrame:
    """`qid`, `docno`, `label`; labels that aren't numbers are left out. No path: no judgements. `of`: only of these topics."""
    if not path:
        return spark.createDataFrame([], QRELS)
    q = _tsv(spark, path)
    missing = {"qid", "docno", label_column} - set(q.columns)
    if missing:
        raise ValueError(f"judgements lack {sorted(missing)}")
    q = q.select("qid", "docno", F.col(label_column).try_cast("double").cast("int").alias("label")).where("label IS NOT NULL")
    return q.join(of.select("qid"), "qid", "left_semi") if of is not None else q


def corpus(
    spark: SparkSession, path: str, fields: tuple[str, ...] = ("text",), docno_column: str = "docno",
    max_docs: int | None = None
) -> DataFrame:
    """`docno`, `text` of a parquet table: its fields, a line each."""
    c = spark.read.parquet(path).select(F.col(docno_column).cast("string").alias("docno"), compose_text(*fields).alias("text"))
    return c.orderBy("docno").limit(max_docs) if max_docs else c


def duplicate_docnos(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("docno").agg(F.count("*").alias("n")).where("n > 1")


def missing_docnos(expected: DataFrame, vectors: DataFrame) -> DataFrame:
    return expected.select("docno").join(vectors.select("docno"), "docno", "left_anti")


def vectors(
    spark: SparkSession, path: str, docno_column: str = "docno", vector_column: str = "full_embedding",
    width: int | None = None, expected: DataFrame | None = None
) -> DataFrame:
    """`docno`, `v`, checked: known columns, one row a document, one width, and no document of `expected` missing."""
    d = spark.read.parquet(path)
    if {docno_column, vector_column} - set(d.columns):
        raise ValueError(f"vectors need {docno_column} and {vector_column}, not {d.columns}")
    v = d.select(F.col(docno_column).cast("string").alias("docno"), F.col(vector_column).cast("array<float>").alias("v"))
    return checked_vectors(v, width, expected)


def checked_vectors(v: DataFrame, width: int | None = None, expected: DataFrame | None = None) -> DataFrame:
    r = v.agg(F.min(F.coalesce(F.size("v"), F.lit(-1))).alias("a"), F.max(F.size("v")).alias("b")).first()
    if r["a"] is not None and (r["a"] != r["b"] or width is not None and r["a"] != width):
        raise ValueError(f"vectors have {r['a']} to {r['b']} components, not {width or 'one width'}")
    twice = duplicate_docnos(v).limit(5).collect()
    if twice:
        raise ValueError(f"more than one vector for {[x['docno'] for x in twice]}")
    if expected is not None:
        lost = missing_docnos(expected, v).limit(5).collect()
        if lost:
            raise ValueError(f"no vector for {[x['docno'] for x in lost]}")
        v = v.join(expected.select("docno"), "docno", "left_semi")
    return v


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or parquet."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)


LOG = T.StructType([T.StructField("log_history", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def trainer_log(spark: SparkSession, path: str, columns: tuple[str, ...] = ("step", "epoch", "loss", "learning_rate", "grad_norm")) -> DataFrame:
    """The history of a training run's state file, a number (or null) in each column."""
    h = spark.read.schema(LOG).json(path, multiLine=True).select(F.explode("log_history").alias("h"))
    return h.select(*(F.try_element_at("h", F.lit(c)).try_cast("double").alias(c) for c in columns))


def result_files(spark: SparkSession, path: str, name: str = "pt_experiment.csv") -> tuple[DataFrame, list[tuple[str, str]]]:
    """All result files below a folder as strings with their `file`, columns united; and the files that can't be read, with the reason."""
    from functools import reduce

    found = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path").collect()]
    frames, errors = [], []
    for f in sorted(found):
        try:
            d = spark.read.csv(f, header=True)
            if not d.columns:
                raise ValueError("no columns")
            frames.append(d.withColumn("file", F.lit(f)))
        except Exception as e:  # noqa: BLE001  whatever a file's trouble is, it is reported
            errors.append((f, str(e).splitlines()[0]))
    if not frames:
        return spark.createDataFrame([], "file string"), errors
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), errors


Loader = Callable[[SparkSession], DataFrame]


class Catalog:
    """Named sources: a name gives topics, judgements and corpus, each by its loader."""

    def __init__(self) -> None:
        self._of: dict[tuple[str, str], Loader] = {}

    def register(self, name: str, kind: str, loader: Loader) -> None:
        if kind not in ("topics", "qrels", "corpus"):
            raise ValueError(f"a source is of topics, qrels or corpus, not {kind}")
        self._of[name, kind] = loader

    def load(self, spark: SparkSession, name: str, kind: str) -> DataFrame:
        if (name, kind) not in self._of:
            if kind == "qrels":
                return spark.createDataFrame([], QRELS)
            raise KeyError(f"no {kind} of {name}")
        return self._of[name, kind](spark)

    def views(self, spark: SparkSession, name: str) -> None:
        for n, kind in self._of:
            if n == name:
                self.load(spark, name, kind).createOrReplaceTempView(kind)
