"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def strip(x: Column) -> Column:
    """Without white space at both ends, all kinds of it."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def compose_text(*fields: str) -> Column:
    """The fields that aren't null or blank, a line each, stripped as a whole."""
    return strip(F.concat_ws("\n", *(F.when(strip(F.col(f).cast("string")) != "", F.col(f).cast("string")) for f in fields)))


def index_text(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit(""))


def prompted(prompt: str, text: Column) -> Column:
    return F.concat(F.lit(prompt), text) if prompt else text


def sanitize_query(query: Column) -> Column:
    """Colons name fields in a query language; here they are blanks."""
    return F.replace(query, F.lit(":"), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
