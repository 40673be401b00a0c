"""Dense retrieval: exact search over one or mixed widths, and reranking of candidates.

Search multiplies a block of queries with some documents at a time and passes on what may be among a query's `k` best in its
task, so that little more than `k` rows a query and task are shuffled. One block of queries is broadcast, `BLOCK_BYTES` at most;
more queries and the documents are dealt out to tasks of a block and a shard. A matrix of scores has `SCORE_BYTES` at most.
Several widths are searched in one pass, by adding up products. Scores are compared after rounding to 9 places, ties go to the
smaller docno.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions import vectors as V
from lumenspan.operators.profiles import Profile

BLOCK_BYTES = 1 << 24
SCORE_BYTES = 1 << 26
SHARD_BYTES = 1 << 25


def uniform(docs: DataFrame, profile: Profile, dtype: str = "float16") -> DataFrame:
    """Every document in one profile: `docno`, `profile`, `dimension`, `cost_bytes`."""
    return docs.select(
        "docno", F.lit(profile.name).alias("profile"), F.lit(profile.dimension).alias("dimension"),
        F.lit(profile.cost(dtype)).cast("long").alias("cost_bytes")
    )


def materialize(docs: DataFrame, assignments: DataFrame) -> DataFrame:
    """The mixed-width corpus: `docno`, `profile`, `vec` cut to the assigned dimension. Raises if an assigned document has no vector."""
    missing = assignments.join(docs, "docno", "left_anti").select("docno").limit(5).collect()
    if missing:
        raise KeyError(f"no vectors for {[r['docno'] for r in missing]}")
    return docs.join(assignments, "docno").select("docno", "profile", V.prefix("v", F.col("dimension")).alias("vec"))


def cut(docs: DataFrame, dimension: int) -> DataFrame:
    """Every document at one width: `docno`, `vec`."""
    return docs.select("docno", V.prefix("v", dimension).alias("vec"))


_FOUND = "w int, qid string, docno string, score double"


class _Search:
    """A block of queries against documents that come in pieces."""

    def __init__(self, qids: list[str], q: np.ndarray, k: int, cosine: bool, skip_self: bool, widths: list[int] | None):
        self.qids, self.q, self.k, self.cosine, self.skip = pa.array(qids, pa.string()), q, k, cosine, skip_self
        self.where = {x: i for i, x in enumerate(qids)} if skip_self else {}
        self.widths = widths
        self.best: dict[int, np.ndarray] = {}  # of each width: each query's k best scores so far
        self.step = max(1, SCORE_BYTES // (8 * max(len(qids), 1)))

    def scores(self, v: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        s, at = np.zeros((len(self.q), len(v))), 0
        for w in widths:
            s = s + self.q[:, at:w] @ v[:, at:w].T
            at = w
            if self.cosine:
                a, b = (np.maximum(np.sqrt((x[:, :w] * x[:, :w]).sum(axis=1)), V.NORM_FLOOR) for x in (self.q, v))
                yield w, s / (a[:, None] * b[None])
            else:
                yield w, s

    def kept(self, w: int, s: np.ndarray, docno: np.ndarray, key: int) -> pa.RecordBatch:
        """What may be among the k best of the task; docno ascends."""
        s = np.round(s, 9) + 0.0
        for j, x in enumerate(docno.tolist() if self.skip else ()):
            if x in self.where:
                s[self.where[x], j] = -np.inf
        best = self.best.get(key)
        every = s if best is None else np.concatenate((best, s), axis=1)
        if every.shape[1] > self.k:
            every = np.partition(every, every.shape[1] - self.k, axis=1)[:, -self.k :]
        self.best[key] = every
        least = every.min(axis=1, keepdims=True) if every.shape[1] == self.k else np.full((len(s), 1), -np.inf)
        equal = s == least
        take = (s > least) | equal & (np.cumsum(equal, axis=1) <= self.k)
        row, col = np.nonzero(take & (s > -np.inf))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), w, np.int32)), self.qids.take(pa.array(row)),
                pa.array(docno[col], pa.string()), pa.array(s[row, col])
            ],
            names=["w", "qid", "docno", "score"]
        )

    def add(self, docno: pa.Array, vec: pa.Array) -> Iterator[pa.RecordBatch]:
        names = np.array(docno.to_pylist(), object)
        width = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, begin = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(width)))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            rows = rows[np.argsort(names[rows].astype("U"), kind="stable")]
            for at in range(0, len(rows), self.step):
                own = rows[at : at + self.step]
                v = flat[begin[own][:, None] + np.arange(w)]
                for m, s in self.scores(v, [w] if self.widths is None else [min(m, w) for m in self.widths]):
                    yield self.kept(m, s, names[own], 0 if self.widths is None else m)


def _matrix(vec: pa.Array) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)


def _tasked(asked: pa.Table, docs: pa.Table, search: Callable[[list[str], np.ndarray], _Search]) -> pa.Table:
    schema = pa.schema([("w", pa.int32()), ("qid", pa.string()), ("docno", pa.string()), ("score", pa.float64())])
    if not asked.num_rows or not docs.num_rows:
        return schema.empty_table()
    asked, docs = asked.combine_chunks(), docs.combine_chunks()
    one = lambda t, c: t.column(c).chunk(0)
    return pa.Table.from_batches(
        list(search(one(asked, "qid").to_pylist(), _matrix(one(asked, "qvec"))).add(one(docs, "docno"), one(docs, "vec"))),
        schema
    )


def _found(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool, skip_self: bool, widths: list[int] | None) -> DataFrame:
    """What may be among the k best of each query, from all tasks: `w` (the width), `qid`, `docno`, `score`."""
    queries, corpus = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")), corpus.select("docno", "vec")
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    n, d = shape["n"], shape["d"] or 1
    kinds = len(widths) if widths else 1
    blocks = max(1, -(-n * d * 8 // BLOCK_BYTES), -(-n * k * kinds * 8 // SCORE_BYTES))
    search = lambda ids, q: _Search(ids, q, k, cosine, skip_self, widths)
    if blocks == 1:
        own = queries.toArrow().combine_chunks()
        column = lambda c: own.column(c).chunk(0) if own.num_rows else pa.array([], own.column(c).type)
        shared = corpus.sparkSession.sparkContext.broadcast(
            (column("qid").to_pylist(), _matrix(column("qvec")) if own.num_rows else np.zeros((0, d)))
        )

        def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = search(*shared.value)
            for batch in batches:
                if batch.num_rows:
                    yield from s.add(batch.column("docno"), batch.column("vec"))

        return corpus.mapInArrow(kernel, _FOUND)
    shards = max(1, -(-corpus.count() * d * 8 // SHARD_BYTES))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = queries.select(
        "qid", "qvec", deal("qid", blocks).alias("i"), every(shards, "j")
    ).select((F.col("j") * blocks + F.col("i")).alias("task"), "qid", "qvec")
    right = corpus.select(
        "docno", "vec", deal("docno", shards).alias("j"), every(blocks, "i")
    ).select((F.col("j") * blocks + F.col("i")).alias("task"), "docno", "vec")

    def together(asked: pa.Table, docs: pa.Table) -> pa.Table:
        return _tasked(asked, docs, search)

    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(together, _FOUND)


def _kind(similarity: str) -> bool:
    if similarity not in ("dot", "cosine"):
        raise ValueError(f"similarity is dot or cosine, not {similarity}")
    return similarity == "cosine"


def _ranked(found: DataFrame, k: int, first_rank: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by, "qid").orderBy(F.desc("score"), "docno")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        *by, "qid", "docno", "score", (F.col("rank") - 1 + first_rank).alias("rank")
    )


def search(queries: DataFrame, corpus: DataFrame, k: int, similarity: str = "dot", skip_self: bool = False, first_rank: int = 1) -> DataFrame:
    """`qid`, `docno`, `score`, `rank`: the k best of corpus (`docno`, `vec`) for each of queries (`qid`, `qvec`), each document
    scored with the query's prefix of its own width.
    """
    return _ranked(_found(queries, corpus, k, _kind(similarity), skip_self, None), k, first_rank)


def search_widths(
    queries: DataFrame, docs: DataFrame, widths: list[int], k: int, similarity: str = "dot", skip_self: bool = False,
    first_rank: int = 1
) -> DataFrame:
    """The same for several widths at once, in one pass over docs (`docno`, `v`, all of one width): with a column `w`, the width."""
    return _ranked(_found(queries, docs.select("docno", F.col("v").alias("vec")), k, _kind(similarity), skip_self, sorted(set(widths))), k, first_rank, "w")


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, similarity: str = "dot", k: int | None = None) -> DataFrame:
    """Candidates (`qid`, `docno`) by dense score, ranks from 1; those without a vector are left out, see `dropped`. All stay
    unless k is given.
    """
    s = candidates.select("qid", "docno").join(queries.select("qid", "qvec"), "qid").join(corpus.select("docno", "vec"), "docno")
    s = s.select("qid", "docno", F.round(V.similarity(V.prefix("qvec", F.size("vec")), F.col("vec"), similarity), 9).alias("score"))
    out = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docno")))
    return out if k is None else out.where(F.col("rank") <= k)


def dropped(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many candidates of each query have no vector."""
    return candidates.join(corpus.select("docno"), "docno", "left_anti").groupBy("qid").agg(F.count("*").alias("n_dropped"))


def pair_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame, profiles: list[Profile], similarity: str = "dot") -> DataFrame:
    """A row per pair and profile, with its score at full width and at the profile's (`full_score`, `reduced_score`)."""
    from lumenspan.operators.profiles import with_profiles

    s = pairs.join(queries.select("qid", "qvec"), "qid").join(docs.select("docno", "v"), "docno").withColumn(
        "full_score", V.similarity("qvec", "v", similarity)
    )
    s = with_profiles(s, profiles).withColumn(
        "reduced_score",
        V.similarity(V.prefix("qvec", F.col("dimension")), V.prefix("v", F.col("dimension")), similarity)
    )
    return s.drop("qvec", "v")


def runs(
    queries: DataFrame, docs: DataFrame, profiles: list[Profile], optimized: DataFrame | None, k: int,
    similarity: str = "dot", full: str = "full", skip_self: bool = False, bm25: DataFrame | None = None
) -> DataFrame:
    """All runs of an experiment with a `run` column and their order in `run_order`: BM25 first if given, the full width, each
    smaller profile from the widest, the optimised assignment. All profiles are searched in one pass.
    """
    order = sorted(profiles, key=lambda p: (p.name == full, p.dimension, p.name), reverse=True)
    first = int(bm25 is not None)
    names = [(p.dimension, "full_run" if p.name == full else f"profile_{p.name}_run", first + i) for i, p in enumerate(order)]
    plan = queries.sparkSession.createDataFrame(names, "w int, run string, run_order int")
    out = search_widths(
        queries, docs, [p.dimension for p in profiles], k, similarity, skip_self
    ).join(F.broadcast(plan), "w").select("run", "run_order", "qid", "docno", "score", "rank")
    more = [] if bm25 is None else [(0, "bm25_run", bm25)]
    if optimized is not None:
        more.append((first + len(order), "optimized_run", search(queries, materialize(docs, optimized), k, similarity, skip_self)))
    return reduce(
        DataFrame.unionByName,
        (r.select(F.lit(name).alias("run"), F.lit(i).alias("run_order"), "qid", "docno", "score", "rank") for i, name, r in more),
        out
    )


def _within(asked: DataFrame, docs: DataFrame, k: int, similarity: str, skip_self: bool) -> DataFrame:
    """asked: `task`, `qid`, `qvec`; docs: `task`, `docno`, `vec`. Each task's products by blocks, no pair is listed; then each
    query's k best. A document that meets a query in several tasks counts once.
    """
    cosine = _kind(similarity)

    def together(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tasked(a, b, lambda ids, q: _Search(ids, q, k, cosine, skip_self, None))

    found = asked.select(
        "task", "qid", F.col("qvec").cast("array<double>").alias("qvec")
    ).groupBy("task").cogroup(docs.select("task", "docno", "vec").groupBy("task")).applyInArrow(together, _FOUND)
    return _ranked(found.select("qid", "docno", "score").distinct(), k, 1)


def _shards(corpus: DataFrame, queries: DataFrame) -> int:
    d = queries.agg(F.max(F.size("qvec"))).first()[0] or 1
    return max(1, -(-corpus.count() * d * 8 // SHARD_BYTES))


def _dealt(asked: DataFrame, docs: DataFrame, shards: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """Both with a `task` of the columns by and a shard of the documents, so that no bucket is one task."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    return asked.select("*", every).withColumn("task", F.xxhash64(*by, "shard")), docs.withColumn(
        "shard", F.pmod(F.xxhash64("docno"), F.lit(shards)).cast("int")
    ).withColumn("task", F.xxhash64(*by, "shard"))


def lsh_search(queries: DataFrame, corpus: DataFrame, k: int, bucket_length: float = 0.5, tables: int = 8, skip_self: bool = False) -> DataFrame:
    """Approximate search: candidates share a bucket of random projections, products rank them. Queries without any candidate have
    no rows.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    d = corpus.select("docno", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    q = queries.select("qid", "qvec", array_to_vector(F.col("qvec").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=13
    ).fit(d)
    buckets = lambda f, *c: model.transform(f).select(*c, F.posexplode("h").alias("t", "b")).withColumn("b", F.col("b").cast("string"))
    return _within(*_dealt(buckets(q, "qid", "qvec"), buckets(d, "docno", "vec"), _shards(corpus, queries), "t", "b"), k, "dot", skip_self)


def ivf_search(
    queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, probes: int | None = None,
    sample: int = 100_000, skip_self: bool = False
) -> DataFrame:
    """Approximate search: k-means cells fitted on at most `sample` vectors, every vector indexed, each query against the vectors of its nearest `probes` cells.

    By default there are as many cells as the root of a third of the documents, and 62 of 100 are looked at: the provided
    vectors lie near no centre (see the README for recall by probes); clustered ones need far fewer.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = corpus.count()
    cells = cells or max(8, min(1024, round((n / 3) ** 0.5)))
    probes = probes or max(1, -(-cells * 62 // 100))
    d = corpus.select("docno", "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=13, maxIter=10).fit(d.orderBy(F.xxhash64("docno")).limit(sample))
    centers = np.array(model.clusterCenters())

    def probed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column("qvec"))
                far = (centers * centers).sum(axis=1)[None] - 2 * q @ centers.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("qid").take(row), b.column("qvec").take(row), pa.array(near.ravel().astype(np.int32))],
                    names=["qid", "qvec", "cell"]
                )

    asked = queries.select(
        "qid", F.col("qvec").cast("array<double>").alias("qvec")
    ).mapInArrow(probed, "qid string, qvec array<double>, cell int")
    return _within(*_dealt(asked, model.transform(d).select("docno", "vec", F.col("prediction").alias("cell")), _shards(corpus, queries), "cell"), k, "dot", skip_self)


#: Kinds of search by name. Others fall back to exact search.
APPROXIMATE = {"lsh": lsh_search, "ivf": ivf_search}


def search_by(kind: str, queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """`exact` (or `flat`), or one of `APPROXIMATE`; what isn't built (graph indexes such as hnsw) is searched exactly, with a warning."""
    if kind in APPROXIMATE:
        return APPROXIMATE[kind](queries, corpus, k, skip_self=skip_self).select("qid", "docno", "score", "rank")
    if kind not in ("exact", "flat"):
        warnings.warn(f"no {kind} index is built here; the search is exact", stacklevel=2)
    return search(queries, corpus, k, skip_self=skip_self)


def fits(assignments: DataFrame, budget: int) -> DataFrame:
    """One row: whether the vectors of an assignment (`cost_bytes`) fit a budget of bytes: `total_bytes`, `budget_bytes`, `fits`,
    `missing_bytes`.
    """
    total = F.coalesce(F.sum("cost_bytes"), F.lit(0)).cast("long")
    return assignments.agg(total.alias("total_bytes")).select(
        "total_bytes", F.lit(budget).cast("long").alias("budget_bytes"), (F.col("total_bytes") <= budget).alias("fits"),
        F.greatest(F.col("total_bytes") - budget, F.lit(0)).cast("long").alias("missing_bytes")
    )


def check_fits(assignments: DataFrame, budget: int) -> DataFrame:
    """assignments, or an error that says by how much they are too large."""
    r = fits(assignments, budget).first()
    if not r["fits"]:
        raise MemoryError(f"the vectors take {r['total_bytes']} bytes, {r['missing_bytes']} more than the budget of {budget}; choose a smaller profile or a larger budget")
    return assignments
