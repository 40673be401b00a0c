"""WARC archives: writing, reading back, and a global capture index by external merge.

Writing uses the text sink, so archives land wherever Spark can write: a record is a row, and the record separator of the format
is the sink's line separator. Of equal payloads of `REVISIT_BYTES` or more, the capture of the largest page_id is stored, the
others are revisit records that refer to it.

Reading uses the text source: an archive comes as a stream of lines, is put together again and parsed by the lengths in its
headers, a record at a time, whatever the archive's size. It gives a run of captures, sorted locally by URL key and timestamp; runs are written as files. The merge deals the key range out
to tasks of about `RANGE_ROWS` captures; each merges its part of all runs with a loser tree.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.runtime import materialize

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 8192
RANGE_ROWS = 1 << 17
#: Fixed values of the format.
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "run string, url_key string, stamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"


def records(pages: DataFrame) -> DataFrame:
    """A WARC record (`value`) per row of `page_id`, `url`, `html`.

    Null pages have an empty payload. A null url leaves its header out. Rows without page_id never are what others refer to;
    rows that repeat the largest page_id of a payload are responses all. An empty table gives no records.
    """
    p = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    p = p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    groups = p.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    p = p.join(groups, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    identity = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(SEPARATOR)
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", r"[\r\n]", "")
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", identity(F.col("page_id"))), none),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.pmod("page_id", F.lit(100_000_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", identity(F.col("first"))))).otherwise(none),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return p.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives below path, a folder that doesn't exist yet; an empty table makes one without archives or with empty ones."""
    records(pages).write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """A sortable key: the host's labels from the right, then path and query; scheme, `www` and fragment don't count."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + (
        f":{port}" if port and port not in (80, 443) else ""
    ) + ")" + (u.path.lower() or "/") + (f"?{query}" if query else "")


def parsed(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record, by the lengths that headers give; one record is held at a time."""
    at = 0
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, headers = len(first), {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            size += len(line)
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k.lower()] = v
        n = int(headers["content-length"])
        block, end = archive.read(n), archive.read(4)
        if len(block) < n or end != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block, at, size + 2 + n
        at += size + 2 + n + 4


class Stream(io.RawIOBase):
    """The bytes of an archive from parts of it."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.now, self.at = parts, b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, out: memoryview) -> int:
        while self.at == len(self.now):
            part = next(self.parts, None)
            if part is None:
                return 0
            self.now, self.at = part, 0
        n = min(len(out), len(self.now) - self.at)
        out[:n] = self.now[self.at : self.at + n]
        self.at += n
        return n


def _number(identity: str | None) -> int | None:
    return int(identity[len("<urn:x-page:") : -1]) if identity else None


_TYPES = {x.split()[0]: pa.int64() if x.endswith("long") else pa.string() for x in CAPTURES.split(", ")}


def _run(path: str, archive: io.BufferedIOBase) -> pa.RecordBatch:
    rows = []
    for h, block, at, n in parsed(archive):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        kind = h["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{path}: the record at byte {at} is damaged")
        url = h.get("warc-target-uri")
        rows.append(
            (
                path, url_key(url), h["warc-date"], _number(h.get("warc-record-id")), url, kind, size, digest,
                _number(h.get("warc-refers-to")), at, n
            )
        )
    rows.sort(key=lambda r: _order(r[1:4]))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES.values())], names=list(_TYPES))


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of archives, each archive's in order and one archive after another: a sorted run of each."""

    def parts() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            runs, at = pc.run_end_encode(batch.column("path")), 0
            for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                yield path, b"\n".join([*batch.column("value").slice(at, end - at).to_pylist(), b""])
                at = end

    for path, own in groupby(parts(), key=lambda x: x[0]):
        yield _run(path, io.BufferedReader(Stream(part for _, part in own), 1 << 16))


def _order(key: tuple) -> tuple:
    """By URL key, timestamp, page_id, null first; strings in order of their bytes, as Spark has them."""
    return key[0].encode(), key[1], key[2] is not None, key[2] or 0


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all gzip archives in a folder, each archive's a sorted run, written as run files. A compressed file isn't
    split, so its lines come in order.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return materialize(
        lines.select(
            F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")
        ).mapInArrow(_captures, CAPTURES)
    )


class LoserTree:
    """Merges k sorted iterators of (key, value) with one comparison a level for each value taken; ties go to the lower run."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.k = len(sources)
        self.head = [next(s, None) for s in sources]
        self.loser = [-1] * max(self.k, 1)
        winner = [0] * (2 * self.k)
        for i in range(2 * self.k - 1, 0, -1):
            if i >= self.k:
                winner[i] = i - self.k
            else:
                a, b = winner[2 * i], winner[2 * i + 1]
                winner[i], self.loser[i] = (a, b) if self.before(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def __iter__(self) -> Iterator:
        while self.k and (best := self.head[self.top]) is not None:
            yield best[1]
            run = self.top
            self.head[run] = next(self.sources[run], None)
            node = (run + self.k) // 2
            while node:
                if not self.before(run, self.loser[node]):
                    run, self.loser[node] = self.loser[node], run
                node //= 2
            self.top = run


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range of all runs, run after run: in global order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    run = table.column("run").to_pylist()
    keys = list(map(_order, zip(*(table.column(c).to_pylist() for c in ("url_key", "stamp", "page_id")), strict=True)))
    cuts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
    order = list(LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
    yield from table.take(pa.array(order)).to_batches()


def merge(captures: DataFrame) -> DataFrame:
    """All runs (a written table) in one order by URL key and timestamp: partitions follow each other, and rows within them. Equal
    captures are in order of their archives, so a key may have any number.
    """
    keys = (F.col("url_key"), F.col("stamp"), F.col("page_id").asc_nulls_first())
    spark = captures.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    return captures.repartitionByRange(parts, *keys, "run", "offset").sortWithinPartitions("run", *keys, "offset").mapInArrow(_merged, CAPTURES)


def history(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as archives below path, read them back, and give all captures in global order. Repeated rows are captures each;
    an empty table gives no rows.
    """
    write(pages, path)
    return merge(runs(pages.sparkSession, path))
