"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / quality, u from a hash of its own row, so that reruns agree. A source whose target is e
times its size and a bit takes e complete epochs, then the documents of the smallest keys, prefix-summed up to what is left.

The prefix sum of a source, which may hold a third of all rows, is taken in two steps: sums over ranges of keys, `BINS` for each
doubling, and then single rows of the one range that the budget ends in. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.runtime import materialize, numbered, small

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of keys for each doubling. The logarithm of a key is spread by the same law for any quality, which puts at most
#: 0.37 ln 2 / BINS of a source's documents into one range: 1 in 4000.
BINS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters other than ASCII digits and symbols that running text seldom has."""
    n = F.char_length(text)
    odd = F.char_length(F.translate(text, "#$%&*=+<>{}[]|\\^~_@/0123456789", ""))
    return F.coalesce(F.when(n > 0, F.greatest(odd / n, F.lit(0.05))), F.lit(0.05))


def keyed(df: DataFrame, quality: Column, seed: int) -> DataFrame:
    """df (`doc_id`, `text`, `source`, more) with `_size`, `_key`, `_tie`: equal for equal rows only. _tie orders rows of equal keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return df.withColumns({"_size": n_words(F.col("text")), "_key": -F.log(u) / quality, "_tie": F.xxhash64(F.lit(seed + 1), F.col("text"), F.col("doc_id"))})


def targets(sizes: DataFrame, fraction: float, weights: tuple[float, ...], cap: float, rows: int | None = None) -> DataFrame:
    """sizes: a row per `source` with its `source_size`, about `rows`. Adds `target`: sources by code point, null last, share `fraction` of all sizes by the repeating weights; none gets more than `cap` times its size, and the excess is shared again.

    That is the level of a water filling: sources that are full at the level of the round before leave, until none does. A round
    is a sum over the sources, of which the driver sees nothing else.
    """
    s = numbered(sizes, F.col("source").asc_nulls_last(), rows=rows)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_n") % len(weights) + 1).cast("int")))
    total, level, known = None, 0.0, -1
    while True:
        full = (F.col("source_size") * F.lit(float(cap)) < F.lit(level) * F.col("w")) if total is not None else F.lit(False)
        every, used, w, n = s.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("w"))),
            F.count(F.when(full, 1))
        ).first()
        total = fraction * (every or 0)
        if n == known or not w:
            break
        known, level = n, (total - cap * (used or 0)) / w
    return s.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.lit(level) * F.col("w")).alias("target"))


def plan(slim: DataFrame, fraction: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """slim: `source`, `_size`, `_key`, `_tie`. A row per source: `source_size`, `target`, `epochs`, and the last document
    (`cut_key`, `cut_tie`) of the fractional epoch with the words that it gives (`cut_words`).
    """
    n = slim.agg(F.approx_count_distinct("source")).first()[0]
    goal = targets(slim.groupBy("source").agg(F.sum("_size").alias("source_size")), fraction, weights, cap, n)
    goal = materialize(
        goal.withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
        ).withColumn("budget", F.greatest(F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0))),
        n
    )
    bin_ = F.coalesce(F.floor(F.log2(F.col("_key")) * BINS), F.lit(-1 << 40))  # a key may be 0
    slim = slim.where("_size > 0").withColumn("bin", bin_)
    sums = slim.groupBy("source", "bin").agg(F.sum("_size").alias("words")).withColumnRenamed("source", "s")
    w = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    ends = sums.join(
        small(goal.where("budget > 0")), F.col("s").eqNullSafe(F.col("source"))
    ).where("before < budget AND before + words >= budget")
    ends = materialize(ends.select("s", F.col("bin").alias("b"), "before", "budget"), n)
    last = slim.join(small(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    rows = last.groupBy("s", "before", "budget", "_key", "_tie").agg(F.sum("_size").alias("words"), F.count("*").alias("copies"))
    at = Window.partitionBy("s").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.col("before") + F.coalesce(F.sum("words").over(at), F.lit(0)))
    cut = rows.where("prior < budget AND prior + words >= budget").select(
        "s", F.col("_key").alias("cut_key"), F.col("_tie").alias("cut_tie"),
        F.floor((F.col("budget") - F.col("prior")) / F.col("copies")).alias("cut_words")
    )
    return materialize(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), n)


def apply(rows: DataFrame, planned: DataFrame, source: str = "source") -> DataFrame:
    """Adds `source_size`, `target`, `epochs`, `taken` (words that the mix takes of the row) to rows with `_size`, `_key`, `_tie`."""
    p = small(planned.withColumnRenamed("source", "_s"))
    before = (F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.col("_tie") < F.col("cut_tie")))
    at = (F.col("_key") == F.col("cut_key")) & (F.col("_tie") == F.col("cut_tie"))
    more = F.when(F.col("cut_key").isNull(), F.lit(0)).when(before, F.col("_size")).when(at, F.col("cut_words")).otherwise(0)
    out = rows.join(p, F.col(source).eqNullSafe(F.col("_s")), "left")
    return out.withColumn("taken", F.col("epochs") * F.col("_size") + more).drop("_s", "budget", "cut_key", "cut_tie", "cut_words")


def _told(df: DataFrame, seed: int, *more: Column) -> DataFrame:
    d = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), *more)
    return keyed(d, text_quality(F.col("text")), seed)


def mix(df: DataFrame, fraction: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, seed: int = 6) -> DataFrame:
    """A row per row of `doc_id`, `text`, `source`: `doc_id`, `source`, `size`, `source_size`, `target`, `epochs`, `taken`.

    Null texts have size 0 and weigh nothing; a null source is a source of its own, the last. Equal rows draw equal keys; where
    the budget ends among them, they share it evenly. An empty table gives no rows; other columns are left aside.
    """
    slim = materialize(_told(df, seed).drop("text"))
    return apply(slim, plan(slim, fraction, weights, cap)).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "epochs", F.col("taken").cast("long")
    )


def sample(df: DataFrame, fraction: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, seed: int = 6) -> DataFrame:
    """The mix itself: rows of df with all their columns, whatever they are called, once for each epoch and once more if the
    fractional epoch takes at least half of them. Whole documents only.
    """
    rows = _told(df, seed, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")).drop("doc_id", "text")
    slim = materialize(rows.drop("_row"))
    got = apply(rows, plan(slim, fraction, weights, cap))
    times = F.col("epochs") + F.when(
        (F.col("_size") > 0) & (2 * (F.col("taken") - F.col("epochs") * F.col("_size")) >= F.col("_size")), 1
    ).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(0)).cast("int")))
    return got.select("_row", copies).select(*(F.col("_row").getField(c).alias(c) for c in df.columns))
