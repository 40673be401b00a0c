"""Score preservation of every document over a set of queries, summed where the scores are made: no pair is listed.

A block of queries meets some documents at a time. One block is broadcast, `dense.BLOCK_BYTES` at most; more queries and the
documents are dealt out to tasks of a block and a shard. A row per document and block leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions import scores as S
from lumenspan.functions import vectors as V
from lumenspan.operators import dense
from lumenspan.sources.shared import spread

#: Scores in a matrix at most, so that steps on it stay in a core's cache.
TILE = 1 << 18


def by_width(vec: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, rows and matrix of the vectors of each width; those that are null or hold a null are left out."""
    width = vec.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(np.maximum(width, 0))
    begin, flat = end - np.maximum(width, 0), vec.flatten()
    if flat.null_count:
        width[np.searchsorted(end, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")] = -1
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    for w in np.unique(width[width >= 0]).tolist():
        rows = np.flatnonzero(width == w)
        yield w, rows, values[begin[rows][:, None] + np.arange(w)]


def negatives(x: np.ndarray, k: int) -> np.ndarray:
    """Of each score, the mean of its row's k best without its own. Rows have more than k scores."""
    top = np.sort(np.partition(x, x.shape[1] - k - 1, axis=1)[:, -k - 1 :], axis=1)[:, ::-1]
    out = np.repeat(top[:, :k].mean(axis=1)[:, None], x.shape[1], axis=1)
    row, col = np.nonzero(x >= top[:, k - 1 : k])
    best, own = top[row], x[row, col]
    best[np.arange(len(row)), (~(best <= own[:, None])).sum(axis=1)] = 0
    out[row, col] = best.sum(axis=1) / k
    return out


class _Asked:
    """A block of queries, and how well each profile's scores preserve theirs."""

    def __init__(self, qvec: pa.Array, dims: list[int], metric: str, cosine: bool, epsilon: float, alpha: float, k: int):
        self.n, self.queries = len(qvec), {w: q for w, _, q in by_width(qvec)}
        self.dims, self.metric, self.cosine, self.epsilon, self.alpha, self.k = dims, metric, cosine, epsilon, alpha, k

    def scores(self, q: np.ndarray, v: np.ndarray) -> dict[int, np.ndarray]:
        """By width, the full one among them."""
        s, at, out = np.zeros((len(q), len(v))), 0, {}
        for w in sorted({min(m, v.shape[1]) for m in self.dims} | {v.shape[1]}):
            s = s + q[:, at:w] @ v[:, at:w].T
            at = w
            if self.cosine:
                a, b = (np.maximum(np.sqrt((x[:, :w] * x[:, :w]).sum(axis=1)), V.NORM_FLOOR) for x in (q, v))
                out[w] = s / (a[:, None] * b[None])
            else:
                out[w] = s
        return out

    def relative(self, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        return 1 - np.abs(s - r) / np.maximum(np.abs(s), self.epsilon)

    def preserved(self, s: np.ndarray, r: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        """As scores.preservation(). above: s less its negatives, for margin metrics."""
        if above is not None:
            m = self.relative(above, r - negatives(r, min(self.k, r.shape[1] - 1)))
            return m if self.metric == S.METRICS[3] else self.alpha * self.relative(s, r) + (1 - self.alpha) * m
        if self.metric == S.METRICS[0]:
            return self.relative(s, r)
        d = np.abs(s - r)
        return 1 / (1 + (d if self.metric == S.METRICS[1] else d * d))

    def sums(self, docno: pa.Array, vec: pa.Array) -> pa.RecordBatch:
        """Of each document how many queries score it, and for each profile the sum of what is preserved. Margin metrics take
        the documents as one chunk.
        """
        n, total = np.zeros(len(vec), np.int64), np.zeros((len(self.dims), len(vec)))
        margin = self.metric in S.MARGIN_METRICS
        if margin and len(vec) == 1:
            n[:], total[:] = self.n, self.n
        else:
            with np.errstate(all="ignore"):
                for w, rows, v in by_width(vec):
                    q = self.queries.get(w)
                    if q is None or margin and min(self.k, len(rows) - 1) < 1:
                        continue
                    n[rows] = len(q)
                    wide = len(rows) if margin else 512
                    tall = max(1, TILE // wide)
                    for a in range(0, len(rows), wide):
                        for b in range(0, len(q), tall):
                            got = self.scores(q[b : b + tall], v[a : a + wide])
                            s = got[w]
                            above = s - negatives(s, min(self.k, len(rows) - 1)) if margin else None
                            own = {m: self.preserved(s, got[m], above).sum(axis=0) for m in {min(m, w) for m in self.dims}}
                            for i, m in enumerate(self.dims):
                                total[i, rows[a : a + wide]] += own[min(m, w)]
        return pa.RecordBatch.from_arrays(
            [docno.cast(pa.string()), pa.array(n), *(pa.array(t) for t in total)], names=["docno", "n", *(f"t{i}" for i in range(len(total)))]
        )


def _one(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0)


def sums(
    docs: DataFrame, queries: DataFrame, dims: list[int], metric: str, similarity: str, epsilon: float, alpha: float, k: int
) -> DataFrame:
    """`docno`, `n`, `t0`, `t1`, ...: of each of docs (`docno`, `v`) and block of queries (`qid`, `qvec`) how many of these score it, and
    the sum of what each of the dims preserves. Margin metrics take negatives from documents of the same `chunk`. No queries, no
    rows.
    """
    settings = (dims, metric, dense._kind(similarity), epsilon, alpha, k)
    chunked = metric in S.MARGIN_METRICS
    schema = ", ".join(["docno string", "n long", *(f"t{i} double" for i in range(len(dims)))])
    queries = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    docs = docs.select("docno", F.col("v").alias("vec"), *(["chunk"] if chunked else []))
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    if not shape["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    d = max(shape["d"] or 1, 1)
    blocks = max(1, -(-shape["n"] * d * 8 // dense.BLOCK_BYTES))
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_one(queries.select("qvec").toArrow(), "qvec"))
        if chunked:

            def chunk(table: pa.Table) -> pa.Table:
                return pa.Table.from_batches([_Asked(shared.value, *settings).sums(_one(table, "docno"), _one(table, "vec"))])

            return docs.groupBy("chunk").applyInArrow(chunk, schema)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _Asked(shared.value, *settings)
            for b in batches:
                if b.num_rows:
                    yield asked.sums(b.column("docno"), b.column("vec"))

        return spread(docs).mapInArrow(kernel, schema)
    shards = max(1, -(-docs.count() * d * 8 // dense.SHARD_BYTES))
    every = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    task = (F.col("j") * blocks + F.col("i")).alias("task")
    left = queries.select("qvec", deal("qid", blocks).alias("i"), every(shards, "j")).select(task, "qvec")
    right = docs.select("*", deal("chunk" if chunked else "docno", shards).alias("j"), every(blocks, "i")).select(task, *docs.columns)

    def together(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and own.num_rows:
            a, of = _Asked(_one(asked, "qvec"), *settings), _one(own, "chunk").to_numpy(zero_copy_only=False) if chunked else np.zeros(own.num_rows)
            order = np.argsort(of, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                part = own.take(pa.array(rows))
                out.append(a.sums(_one(part, "docno"), _one(part, "vec")))
        names = ["docno", "n", *(f"t{i}" for i in range(len(dims)))]
        kinds = [pa.string(), pa.int64(), *(pa.float64() for _ in dims)]
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds, strict=True))))

    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(together, schema)
