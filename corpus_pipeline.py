"""A corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets, written and read again, as its docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import langid, minhash, mixing, packing, secret_scan
from lumenspan.llm.runtime import discard, finished, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (`und`: no text or no letter) go; a missing lang is filled in."""
    small_batches(spark)
    known = langid.held_out(docs).where("NOT held_out AND doc_id IS NOT NULL")
    told = langid.predict(docs.select(*COLUMNS), langid.fit(known))
    return told.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of those with the smallest doc_id the one of the smallest hash; rows without words or doc_id
    aren't in groups, but of repeated rows with an id one stays.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*COLUMNS))
    found = minhash.near_duplicates(docs, tag="_row").where("kept AND doc_id IS NOT NULL")
    own = F.when(F.col("group_id").isNull(), F.col("_row"))
    kept = found.groupBy("doc_id", "group_id", own).agg(F.min("_row").alias("_row")).select("doc_id", "_row")
    named = docs.join(kept, ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; documents stay."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row for each time that the mix takes a document."""
    return mixing.sample(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; tests compare stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written; a stage's table and what it wrote on the way are removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, finished(spark, partial(stage, spark, docs, sf_dir))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
