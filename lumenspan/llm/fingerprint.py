"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below `SCALE` of the hash range, whatever the document's length, so sketches of very unequal
documents are samples of the same part of all shingles: unions merge, and intersections estimate containment. A fixed part alone
leaves 3 % of the provided documents without any hash and is off by 0.10 on average (see the README), so the threshold of a
document whose part holds fewer than `FLOOR` hashes is raised to keep that many: every hash below it is kept, it is written in
front of the sketch, and two sketches are compared below the smaller of theirs. Short documents are thus kept whole.

As a string: the threshold in 12 hexadecimal digits, a colon, then the hashes in ascending order, 12 digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.kernel import SHINGLE, U, shingle_hashes
from lumenspan.llm.runtime import materialize, only, slices

SCALE = 1 / 16
FLOOR = 48
BITS = 48
ALL = (1 << BITS) - 1


Sketch = tuple[int, np.ndarray]


def sketches(texts: list[str | None], k: int = SHINGLE) -> list[Sketch]:
    h, at = shingle_hashes(pa.array(texts, pa.large_string()), k)
    h >>= U(64 - BITS)
    limit = int(SCALE * (1 << BITS))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.unique(h[a:b])
        n = max(int(np.searchsorted(own, U(limit))), min(FLOOR, len(own)))
        out.append((ALL if n == len(own) else max(limit, int(own[n])), own[:n]))
    return out


def packed(s: Sketch) -> bytes:
    """The threshold and the hashes, six bytes each."""
    return np.append(U(s[0]), s[1]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def written(s: Sketch) -> str:
    raw = packed(s).hex()
    return f"{raw[:12]}:{raw[12:]}"


def as_written(raw: str) -> Column:
    """The string of a packed sketch."""
    digits = F.lower(F.hex(raw))
    return F.concat(F.substring(digits, 1, 12), F.lit(":"), F.substring(digits, 13, 1 << 30))


def read(text: str) -> Sketch:
    raw = np.frombuffer(bytes.fromhex(text[13:]), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return int(text[:12], 16), wide.view(">u8").ravel().astype(U)


def _common(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    limit = U(min(a[0], b[0]))
    full = int(limit) == ALL
    x, y = (s[1] if full else s[1][: np.searchsorted(s[1], limit)] for s in (a, b))
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; two empty documents are alike."""
    x, y, both = _common(a, b)
    return both / (x + y - both) if x + y else float(a[0] == b[0])


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has."""
    x, _, both = _common(a, b)
    return both / x if x else float(a[0] == ALL)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both documents' shingles together."""
    limit = min(a[0], b[0])
    own = np.union1d(a[1], b[1])
    return limit, own if limit == ALL else own[: np.searchsorted(own, U(limit))]


def fingerprints(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """`doc_id`, `fingerprint` of each row's whole text; null as empty. An empty table gives no rows."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([written(s) for s in sketches(part.column("text").to_pylist(), k)])],
                    names=["doc_id", "fingerprint"]
                )

    return only(df, doc_id="long", text="string").mapInArrow(kernel, "doc_id long, fingerprint string")


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _against(rows: list[tuple[int | None, str, str, Sketch]]) -> list[list]:
    """rows: document, text, the next text, the next text's sketch. Columns of the result."""
    edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for _, t, nxt, _ in rows]
    own, new = sketches([r[1] for r in rows]), sketches(edited)
    made = [
        (r[0], len(r[1]), hashlib.sha256(e.encode()).digest(), packed(s), packed(n), likeness(s, n), likeness(s, r[3])) for r,
        e, s, n in zip(rows, edited, own, new, strict=True)
    ]
    return [list(c) for c in zip(*made, strict=True)] if made else [[] for _ in COLUMNS]


_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending doc_id: each but the last against the one after it. The last row gives its text and the text of the
    partition's first row instead.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    number = context.partitionId() if context else 0
    codec = pa.Codec("zstd")
    last: tuple[int | None, str] | None = None
    head: tuple[int | None, str] | None = None
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            texts = (
                codec.decompress(t.as_buffer(), n, asbytes=True).decode() if n else "" for t,
                n in zip(part.column("text"), part.column("n_bytes").to_pylist(), strict=True)
            )
            rows = list(zip(part.column("doc_id").to_pylist(), texts, strict=True))
            head = head or rows[0]
            rows = [last, *rows] if last else rows
            nexts = sketches([t for _, t in rows[1:]])
            columns = _against([(d, t, nxt, s) for (d, t), (_, nxt), s in zip(rows, rows[1:], nexts, strict=False)])
            last = rows[-1]
            n = len(columns[0])
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)), *empty],
                names=[*COLUMNS, "part", "head_id", "head", "tail"]
            )
    if last:
        values = [last[0], *[None] * 6, number, head[0], head[1], last[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, (*_TYPES, pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            names=[*COLUMNS, "part", "head_id", "head", "tail"]
        )


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            texts = [t.as_buffer() if t.is_valid else b"" for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([codec.compress(t, asbytes=True) if len(t) else b"" for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64())
                ],
                names=["doc_id", "text", "n_bytes"]
            )


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "tail"):
            nxt = part.column("next").to_pylist()
            rows = zip(part.column("doc_id").to_pylist(), part.column("tail").to_pylist(), nxt, sketches(nxt), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(_against(list(rows)), _TYPES, strict=True)], names=list(COLUMNS)
            )


def edited_by_next(df: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of its text with the last third replaced from the next row, and against the next row's.

    The order is descending doc_id, rows of equal ids by their compressed text, null ids last; after the last row comes the first. Null texts are
    empty. One row is its own next; an empty table gives no rows. Texts are shuffled once, compressed, into ranges of doc_id;
    a range's last row is finished afterwards from a table with a row per range.
    """
    packed_ = only(df, doc_id="long", text="string").mapInArrow(_compressed, "doc_id long, text binary, n_bytes long")
    ordered = packed_.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    made = materialize(ordered.mapInArrow(_edges, f"{_OUT}, part long, head_id long, head string, tail string"))
    ends = made.where("part IS NOT NULL").select("doc_id", "part", "head_id", "head", "tail")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("head_id").desc_nulls_last())
    order = ends.select("part", "head_id").withColumn(
        "to", F.coalesce(F.lead("part").over(w), F.first("part").over(w))
    ).select("part", "to")
    whole = ends.join(order, "part").join(
        ends.select(F.col("part").alias("to"), F.col("head").alias("next")), "to"
    ).select("doc_id", "tail", "next")
    out = made.where("part IS NULL").select(*COLUMNS).unionByName(whole.mapInArrow(_ends, _OUT))
    return out.withColumns(
        {
            "edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": as_written("fingerprint"),
            "edited_fingerprint": as_written("edited_fingerprint")
        }
    )
