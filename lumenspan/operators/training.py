"""Training data: triplets from flat or nested sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import strip


def normalize(df: DataFrame, query: str = "query", positive: str = "positive", negative: str | None = "negative") -> DataFrame:
    """`anchor`, `positive` and, if there is one, `negative`."""
    out = [F.col(query).alias("anchor"), F.col(positive).alias("positive")]
    if negative and negative in df.columns:
        out.append(F.col(negative).alias("negative"))
    return df.select(*out)


def nested(
    df: DataFrame, query: str = "query", positives: str = "positive_passages",
    negatives: str | None = "negative_passages", text: str = "text"
) -> DataFrame:
    """Every positive of a query with every negative of it; without a column of negatives, every positive. Rows with an empty list
    have none.
    """
    d = df.select(F.col(query).alias("anchor"), F.explode(positives).alias("_p"), *([F.col(negatives).alias("_n")] if negatives else []))
    d = d.select("anchor", F.col("_p")[text].alias("positive"), *(["_n"] if negatives else []))
    return d.select("anchor", "positive", F.explode("_n").alias("_m")).select(
        "anchor", "positive", F.col("_m")[text].alias("negative")
    ) if negatives else d


def blanks(df: DataFrame) -> DataFrame:
    """How many values of each column are null or blank: `column`, `n_blank`."""
    row = df.agg(*(F.count_if(F.col(c).isNull() | (strip(F.col(c)) == "")).alias(c) for c in df.columns))
    return row.unpivot([], df.columns, "column", "n_blank")


def first_blank(df: DataFrame, order: str) -> DataFrame:
    """The first row, by `order`, that has a null or blank text: `<order>`, `column` (the first such one); no row if there is none."""
    columns = [c for c in df.columns if c != order]
    blank = F.coalesce(*(F.when(F.col(c).isNull() | (strip(F.col(c)) == ""), F.lit(c)) for c in columns))
    return df.select(order, blank.alias("column")).where("column IS NOT NULL").orderBy(order, "column").limit(1)


def validated(df: DataFrame, order: str | None = None) -> DataFrame:
    """df, or an error that names its columns with blank texts and, given a column to order by, the first such row."""
    bad = blanks(df.drop(order) if order else df).where("n_blank > 0").collect()
    if bad:
        first = first_blank(df, order).first() if order else None
        raise ValueError(
            "blank texts: " + ", ".join(f"{r['n_blank']} in {r['column']}" for r in bad) + (
                f"; the first in {first['column']} of {order} {first[order]}" if first else ""
            )
        )
    return df
