"""Exact top-k inner products by norm-bucketed retrieval.

A task holds a shard of the rows, `SHARD_BYTES` of components, and a block of the queries, `BLOCK_BYTES`. The shard's vectors, by descending length, form buckets of similar
length. A query with the k-th best score s so far needs, in a bucket whose longest vector has length L, a cosine of at least
s / (|q| L): beyond 1 the bucket and all after it are pruned; from `COORDINATE` on, vectors are pruned whose leading coordinates
can't belong to such a cosine; below it, only by their lengths. What remains is verified by exact products. Each query starts
with a valid lower bound of its k-th score, from a fixed number of rows that all tasks know.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 256
SHRINK = 0.9
COORDINATE = 0.3
FOCUS = 4
SEEDS = 1024
SHARD_BYTES = 1 << 25
SHARDS = 32
BLOCK_BYTES = 1 << 22
LOW = np.iinfo(np.int64).min
LARGEST = float(1 << 52)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    rows = [np.frombuffer(x, "<i8") for x in column.to_pylist()]
    out = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave their exact range."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(v.shape[-1], 1) < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _quantised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.floor(1024 * np.array(x, np.float64)).astype("<i8").tobytes() for x in batch.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "v"])


class Best:
    """The k best (score, id) of each query, ids ascending within a score."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), LOW), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores and ids: a row for each of `rows`; LOW where there is none."""
        if scores.shape[1] > self.k:  # what is below a row's k-th score can't enter, but its equals can
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, [scores.shape[1] - self.k]]
            order = np.argsort(ids[0])
            s, i = scores[:, order], ids[0][order]
            above, equal = s > kth, s == kth
            take = above | (equal & (np.cumsum(equal, axis=1) <= self.k - above.sum(axis=1, keepdims=True)))
            cols = np.nonzero(take)[1].reshape(len(rows), self.k)
            scores, ids = np.take_along_axis(s, cols, axis=1), i[cols]
        s = np.concatenate((self.score[rows], scores), axis=1)
        i = np.concatenate((self.id[rows], np.where(scores == LOW, np.iinfo(np.int64).max, ids)), axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s: descending, and safe for LOW
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def search(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The k best rows of (ids, v) for each query, its own id left out, of scores not below its floor."""
    length, qlength = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    ids, v, length = ids[order], v[order], length[order]
    unit = v / np.maximum(length, 1e-300)[:, None]
    qunit = q / np.maximum(qlength, 1e-300)[:, None]
    focus = np.argsort(-np.abs(qunit), axis=1)[:, :FOCUS]
    best = Best(len(q), k)
    live = np.arange(len(q))
    a = 0
    while a < len(ids) and len(live):
        b = min(len(ids), a + BUCKET, a + int(np.searchsorted(-length[a:], -SHRINK * length[a], "right")) or a + 1)
        b = max(b, a + 1)
        need = np.maximum(best.score[live, -1], floor[live]).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(qlength[live] * length[a] > 0, need / (qlength[live] * length[a]), np.where(need > 0, np.inf, -1.0)) - 1e-9
        live, cosine = live[cosine <= 1], cosine[cosine <= 1]
        by_length = live[cosine < COORDINATE]
        if len(by_length):
            s = _products(q[by_length], v[a:b])
            s[(s < floor[by_length, None]) | (ids[None, a:b] == qids[by_length, None])] = LOW
            best.add(by_length, s, np.broadcast_to(ids[a:b], s.shape))
        for i, t in zip(live[cosine >= COORDINATE].tolist(), cosine[cosine >= COORDINATE].tolist(), strict=True):
            keep = ids[a:b] != qids[i]
            for f in focus[i]:
                x = qunit[i, f]
                slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                # a unit vector of cosine c >= t to q has a coordinate within the band of c; over all c the band's ends are at
                # t, or at 1 and -1 if x is beyond them
                low = x * t - slack if x > -t else -1.0
                high = x * t + slack if x < t else 1.0
                keep &= (unit[a:b, f] >= low - 1e-9) & (unit[a:b, f] <= high + 1e-9)
            rows = np.flatnonzero(keep) + a
            if len(rows):
                s = _products(q[i : i + 1], v[rows])
                s[s < max(floor[i], best.score[i, -1])] = LOW
                best.add(np.array([i]), s, ids[rows][None])
        a = b
    return best


def top_k(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: each query's k best rows of df by the integer product of floor(1024 x), ties to the smaller vec_id.

    Both have `vec_id`, `embedding`. A row is no candidate of a query of its own vec_id. Vectors that are null or hold a null or
    a component that isn't finite, and rows without vec_id, take no part; a shorter vector counts as filled up with zeros. Nor do
    vectors with a component of `LARGEST` or more, whose floor is no 64-bit integer; scores must fit 64 bits, too.
    Repeated rows are candidates each; equal query rows are one query. Without candidates there are no rows.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)
    ) & F.col("vec_id").isNotNull()
    ready = lambda d: d.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    ).where(whole).mapInArrow(_quantised, "vec_id long, v binary")
    rows, asked = ready(df), ready(queries).distinct()
    bytes_ = lambda d: d.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0]
    shards, blocks = max(SHARDS, -(-bytes_(rows) // SHARD_BYTES)), max(1, -(-bytes_(asked) // BLOCK_BYTES))
    seeds = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEEDS).collect()
    seed = df.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in seeds], np.int64), [bytes(r["v"]) for r in seeds]))

    def floored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = seed.value
        v = _matrix(pa.array(raw, pa.binary()))
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            q = _matrix(batch.column("v"), v.shape[1])
            s = _products(q, v if v.shape[1] == q.shape[1] else np.pad(v, ((0, 0), (0, q.shape[1] - v.shape[1]))))
            s[ids[None] == own[:, None]] = LOW
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(own), LOW)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(floor)], names=["vec_id", "v", "floor"])

    numbers = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = rows.select(
        "*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), numbers("block", blocks)
    ).select((F.col("shard") * blocks + F.col("block")).alias("task"), "vec_id", "v")
    right = asked.mapInArrow(floored, "vec_id long, v binary, floor long").select(
        "*", F.pmod(F.xxhash64("v", "vec_id"), F.lit(blocks)).cast("int").alias("block"), numbers("shard", shards)
    ).select((F.col("shard") * blocks + F.col("block")).alias("task"), "vec_id", "v", "floor")

    def together(rows: pa.Table, asked: pa.Table) -> pa.Table:
        v, q = _matrix(rows.column("v")), _matrix(asked.column("v"))
        width = max(v.shape[1], q.shape[1])
        v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
        best = search(rows.column("vec_id").to_numpy(), v, asked.column("vec_id").to_numpy(), q, asked.column("floor").to_numpy(), k)
        at, col = np.nonzero(best.score > LOW)
        return pa.table(
            [
                asked.column("vec_id").take(pa.array(at)), asked.column("v").take(pa.array(at)),
                pa.array(best.id[at, col]), pa.array(best.score[at, col])
            ],
            names=["query_id", "q", "vec_id", "score"]
        )

    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(together, "query_id long, q binary, vec_id long, score long")
    found = found.withColumn("q", F.xxhash64("q"))
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
