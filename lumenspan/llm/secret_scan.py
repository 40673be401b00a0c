"""Secret scan with a recursive decoding worklist.

A text's own layer is searched for every kind of secret. Then nested layers are unwrapped: URL escapes and Unicode escapes by
line, base64 by run and by wrapped lines, compressed data (gzip, zlib, bzip2, xz) behind base64. Each decoded layer is searched again and put on the
worklist, until nothing new turns up; a layer seen before at the same place of the document is not opened twice.

A layer's characters are mapped to the layer around it by where its escapes stand, or by its place in base64, and through all
layers to the original text, so findings carry spans of the original, in code points. The maps take memory for escapes only, and
the worklist goes into depth first, so it holds a layer of each depth at most.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.kernel import flat
from lumenspan.llm.runtime import only, slices

KINDS = ("assign", "access", "hex")
FINDINGS = "array<struct<kind:string,start:long,end:long,depth:int,via:string>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("passw", "secret", "token", "api")

_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
#: Lines of base64 in a row: the first may follow something else, the others hold nothing else.
_WRAPPED = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=={0,2}(?:[\x20\t]*+\r?(?:\n|\Z)|["'<,;)])))++={0,2}""")
_PART = re.compile(r"[A-Za-z0-9+/_-]+")
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
#: From so many escaped layers in a row on, a percent sign that is escaped again and again is opened at once: same fixpoint, in linear time.
ROWS = 64
_AGAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})|" + _ESCAPE.pattern)
#: Decompressed data is searched in pieces of this size; each repeats so much of the end of the one before it.
PIECE = 1 << 23
OVERLAP = 1 << 20
#: A decompression bomb isn't followed beyond so many bytes; what came before is searched.
LARGEST_LAYER = 1 << 33
#: A compressed layer inside another is held up to this size to be opened; a larger one is searched as it is.
LARGEST_INNER = 1 << 26


def search(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that don't overlap."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a greedy run of 16 or more is a match of [0-9a-f]+ that doesn't fail
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _format(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if data[:3] == b"BZh" else "xz" if data[:6] == b"\xfd7zXZ\x00" else None


def _inflated(data: bytes, name: str) -> Iterator[bytes]:
    """What is compressed in data, all members, by parts of `OVERLAP` at most; up to the first fault, if it has one."""
    while data:
        d = zlib.decompressobj(31) if name == "gzip" else zlib.decompressobj() if name == "zlib" else bz2.BZ2Decompressor() if name == "bzip2" else lzma.LZMADecompressor()
        try:
            while not d.eof:
                out = d.decompress(data, OVERLAP)
                data = d.unconsumed_tail if name in ("gzip", "zlib") else b""
                if out:
                    yield out
                elif not data and not d.eof:
                    return
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            return
        data = d.unused_data
        if _format(data) != name:
            if data:
                yield data
            return


def opened(data: bytes) -> Iterator[tuple[bytes, str]]:
    """Layers of what is compressed in data, in overlapping pieces, with the formats' names."""
    work, seen = [(data, "")], set()
    while work:
        data, via = work.pop()
        name = _format(data)
        mark = hashlib.sha256(data).digest()
        if name is None or mark in seen:  # the latter: data that expand to themselves
            continue
        seen.add(mark)
        via = f"{via}+{name}" if via else name
        held, new, total, closed = bytearray(), 0, 0, False
        for part in _inflated(data, name):
            held += part
            new += len(part)
            total += len(part)
            if new >= PIECE:
                closed = closed or total == len(held) <= LARGEST_INNER and _format(held) is not None and next(
                    _inflated(bytes(held), _format(held)), b""
                ) != b""
                if not closed or len(held) > LARGEST_INNER:
                    yield bytes(held), via
                    del held[:-OVERLAP]
                    closed = False
                    new = 0
            if total > LARGEST_LAYER:
                break
        if new:
            whole = bytes(held)
            del held
            for at in range(0, len(whole), PIECE):  # also if it is compressed again: what looks like a format's beginning may be none
                yield whole[max(0, at - OVERLAP) : at + PIECE], via
            if total == len(whole):
                work.append((whole, via))


def readable(data: bytes) -> tuple[str, bool]:
    """Data as text, bytes that aren't UTF-8 replaced by one character each; whether all is text."""
    text = data.decode(errors="surrogateescape")
    clean = text if text.isascii() else re.sub("[\udc80-\udcff]", "\ufffd", text)
    return clean, (clean is text or clean == text) and re.sub("[\t\n\r\f\v]", "", text).isprintable()


def starts(data: bytes) -> np.ndarray | None:
    """The byte at which each character begins, and the end; None if each is at its own number."""
    if data.isascii():
        return None
    width = _widths(data.decode(errors="surrogateescape"))
    out = np.zeros(len(width) + 1, np.uint32 if len(data) < 1 << 32 else np.int64)
    np.cumsum(width, out=out[1:])
    return out


def _widths(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8, one for what stands for a byte that isn't."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.ones(len(code), np.uint8)
    for least in (0x80, 0x800, 0x10000):
        out += code >= least
    out[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return out


class Whole:
    """All characters of a layer stand for one span."""

    def __init__(self, begin: int, end: int):
        self.a, self.b = begin, end

    def begin(self, i):
        return i * 0 + self.a

    def end(self, i):
        return i * 0 + self.b


class Escaped:
    """Characters at `at` stand for spans `a` to `b`, the others for themselves; `shift` is the line's place in its layer."""

    def __init__(self, at: list[int], a: list[int], b: list[int], shift: int):
        self.at, self.a, self.b, self.shift = np.array(at, np.int64), np.array(a, np.int64), np.array(b, np.int64), shift
        self.less = np.concatenate(([0], self.b - self.at - 1))  # what a character after so many escapes is moved by

    def begin(self, i):
        j = np.searchsorted(self.at, i)
        hit = self.at[np.minimum(j, len(self.at) - 1)] == i
        return self.shift + np.where(hit, self.a[np.minimum(j, len(self.at) - 1)], i + self.less[j])

    def end(self, i):
        j = np.searchsorted(self.at, i)
        hit = self.at[np.minimum(j, len(self.at) - 1)] == i
        return self.shift + np.where(hit, self.b[np.minimum(j, len(self.at) - 1)], i + self.less[j] + 1)


class Coded:
    """Characters at bytes `at` (None: at their own number) of what base64 says in pieces that begin at `cut` of its n signs and
    stand at `place`.
    """

    def __init__(self, at: np.ndarray | None, n: int, cut: np.ndarray, place: np.ndarray):
        self.at, self.n, self.cut, self.place = at, n, cut, place

    def sign(self, k):
        j = np.searchsorted(self.cut, k, "right") - 1
        return self.place[j] + k - self.cut[j]

    def byte(self, i):
        return i if self.at is None else self.at[i].astype(np.int64)

    def begin(self, i):
        return self.sign(self.byte(i) * 4 // 3)

    def end(self, i):
        return self.sign(np.minimum(self.n, -(-self.byte(i + 1) * 4 // 3)) - 1) + 1


class Dense:
    def __init__(self, begin: np.ndarray, end: np.ndarray):
        self.a, self.b = begin, end

    def begin(self, i):
        return self.a[i]

    def end(self, i):
        return self.b[i]


#: Maps that are looked through one by one; a longer chain is made one map.
CHAIN = 16


class Chain:
    """Maps of nested layers, from the inner one to the original text."""

    def __init__(self, inner, n: int, outer: Chain | None):
        self.maps = [inner, *(outer.maps if outer else [])]
        if isinstance(inner, Whole):
            self.maps = [Whole(self.begin(0), self.end(0))]
        elif len(self.maps) > CHAIN:
            every = np.arange(n)
            self.maps = [Dense(self.begin(every), self.end(every))]

    def begin(self, i):
        for m in self.maps:
            i = m.begin(i)
        return i

    def end(self, i):
        for m in self.maps:
            i = m.end(i) - 1
        return i + 1


def unescaped(line: str, shift: int = 0, pattern: re.Pattern = _ESCAPE) -> tuple[str, Escaped] | None:
    """A line without its URL, Unicode and character escapes, and where its characters stood."""
    out: list[str] = []
    where: tuple[list[int], list[int], list[int]] = [], [], []
    at = made = 0
    for m in pattern.finditer(line):
        if m.start() < at:
            continue
        out.append(line[at : m.start()])
        made += m.start() - at
        at = m.start()
        x = m.group()
        if x[0] == "%" and pattern is _AGAIN and x.startswith("%25"):
            out.append("%")
            stops = [at, m.end()]
            at = m.end()
        elif x[0] == "%":
            raw = bytearray()
            while e := _PERCENT.match(line, at + 3 * len(raw)):
                raw.append(int(e[1], 16))
            text = raw.decode(errors="surrogateescape")
            stops = (at + 3 * np.concatenate(([0], np.cumsum(_widths(text), dtype=np.int64)))).tolist()
            out.append(re.sub("[\udc80-\udcff]", "\ufffd", text))
            at += 3 * len(raw)
        else:
            digits = x[3:-1] if x[:3] in ("\\u{", "&#x", "&#X") else x[2:-1] if x[:2] == "&#" else x[2:]
            code = int(digits, 10 if x[:2] == "&#" and x[2] not in "xX" else 16)
            out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
            stops = [at, m.end()]
            at = m.end()
        for own, new in zip(where, (range(made, made + len(stops) - 1), stops[:-1], stops[1:]), strict=True):
            own.extend(new)
        made += len(stops) - 1
    return ("".join([*out, line[at:]]), Escaped(*where, shift)) if out else None


Layer = tuple[str, str, Whole | Escaped | Coded]


def unwrapped(text: str, escapes: bool = True, runs: bool = True, rows: int = 0) -> Iterator[Layer]:
    """Layers inside text: how, its text, and where in `text` its characters stand. rows: of how many escaped layers in a row text
    is the last.
    """
    pattern = _ESCAPE if rows < ROWS else _AGAIN
    if escapes and ("%" in text or "\\" in text or "&#" in text):
        at = 0
        for line in text.splitlines(keepends=True):
            if got := unescaped(line, at, pattern):
                yield "escape", *got
            at += len(line)
    if runs:
        for m in _WRAPPED.finditer(text):
            lines = [(p.start(), p.end()) for p in _PART.finditer(text, m.start(), m.end())]
            width = lines[1][1] - lines[1][0]
            same = next((i for i in range(2, len(lines)) if lines[i][1] - lines[i][0] != width), len(lines))
            # lines of one length, with a shorter last one or without
            for own in ([lines[: same + 1]] if same < len(lines) and lines[same][1] - lines[same][0] < width else []) + [lines[:same]]:
                place = np.array([x for x, _ in own])
                cut = np.cumsum([0, *(y - x for x, y in own[:-1])])
                if (yield from _decoded("".join(text[x:y] for x, y in own), cut, place, own[-1][1])):
                    break
        for m in _RUN.finditer(text):
            body = m.group().rstrip("=")
            for part in (body, re.split(r"[/_-]", body)[-1]):  # a run may have swallowed a path's slash or the like
                a = m.start() + len(body) - len(part)
                if part is not body and (part == body or len(part) < 16) or (
                    yield from _decoded(part, np.zeros(1, np.int64), np.array([a]), m.end())
                ):
                    break


def _decoded(part: str, cut: np.ndarray, place: np.ndarray, stop: int):
    """Layers of a base64 run whose pieces begin at `cut` and stand at `place`, like `unwrapped`; returns whether it was text or
    compressed.
    """
    if len(part) % 4 == 1:
        return False
    try:
        data = base64.b64decode(part.replace("-", "+").replace("_", "/") + "=" * (-len(part) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    packed = False
    for piece, how in opened(data):
        packed = True
        yield f"base64+{how}", piece.decode(errors="replace"), Whole(int(place[0]), stop)
    inner, clean = readable(data)  # also of what was opened: what looks like a format's beginning may be none
    if inner and (clean or search(inner) or _RUN.search(inner) or _ESCAPE.search(inner)):
        yield "base64", inner, Coded(starts(data), len(part), cut, place)
    return packed or clean and bool(inner)


def _path(steps: tuple[tuple[str, int], ...]) -> str:
    return ">".join(how if n == 1 else f"{how}*{n}" for how, n in steps)


def scan_text(text: str, escapes: bool = True, runs: bool = True) -> list[tuple[str, int, int, int, str]]:
    """Findings of all layers: kind, start, end (code points of text, end exclusive), depth (0: the text itself), how it was reached."""
    found = {(k, a, b): (0, "") for k, a, b in search(text)}
    seen = {(hashlib.sha256(text.encode(errors="surrogatepass")).digest(), 0, len(text))}
    layers = unwrapped(text, escapes, runs)
    work = [(layers, first, None, 0, ())] if (first := next(layers, None)) else []  # layers still to come, the next of them
    while work:
        layers, (how, inner, where), outer, depth, steps = work.pop()
        if (more := next(layers, None)) is not None:
            work.append((layers, more, outer, depth, steps))
        del layers, more
        if not inner:
            continue
        chain = Chain(where, len(inner), outer)
        mark = hashlib.sha256(inner.encode(errors="surrogatepass")).digest(), int(chain.begin(0)), int(chain.end(len(inner) - 1))
        if mark in seen:
            continue
        seen.add(mark)
        steps = (*steps[:-1], (how, steps[-1][1] + 1)) if steps and steps[-1][0] == how else (*steps, (how, 1))
        for k, s, e in search(inner):
            found.setdefault((k, int(chain.begin(s)), int(chain.end(e - 1))), (depth + 1, _path(steps)))
        inside = unwrapped(inner, rows=steps[-1][1] if how == "escape" else 0)
        if (first := next(inside, None)) is not None:
            work.append((inside, first, chain, depth + 1, steps))
    return [(k, a, b, *how) for (k, a, b), how in sorted(found.items(), key=lambda x: (x[0][1], KINDS.index(x[0][0]), x[0][2]))]


def _long_runs(buf: np.ndarray, at: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Whether each text has a run of `least` such bytes."""
    x = np.insert(inside[buf], at[1:-1], False)  # a gap between texts, so that no run goes on over their border
    edge = np.flatnonzero(np.diff(np.concatenate(([0], x.view(np.int8), [0]))))
    start = edge[::2][edge[1::2] - edge[::2] >= least]
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at + np.arange(len(at)), start, "right") - 1] = True
    return out


def batch_findings(texts: pa.Array) -> list[list[tuple]]:
    buf, at = flat(texts)
    run, hexed = _long_runs(buf, at, _RUN_BYTES, 16), _long_runs(buf, at, _HEX_BYTES, 16)
    out = []
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            out.append([])
            continue
        escapes = ("%" in text or "\\" in text or "&#" in text) and bool(_ESCAPE.search(text))
        if not (run[i] or hexed[i] or escapes):
            low = text.lower()
            if "AKIA" not in text and not any(k in low for k in _KEYWORDS):
                out.append([])
                continue
        out.append(scan_text(text, escapes, bool(run[i])))
    return out


def scan(df: DataFrame) -> DataFrame:
    """`doc_id` and `findings` (kind, start, end, depth, via; by start, then kind) of each row's whole text.

    Null and empty texts have none. Repeated rows and null ids are scanned as they are; an empty table gives no rows.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("via", pa.string())]))
        names = ("kind", "start", "end", "depth", "via")
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[dict(zip(names, x, strict=True)) for x in own] for own in batch_findings(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "findings"])

    return only(df, doc_id="long", text="string").mapInArrow(kernel, f"doc_id long, findings {FINDINGS}")


def redacted(text: str, findings: list[tuple], mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, a, b, *_ in findings:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows of df, all columns kept, with every found span of `column` replaced by a mark; spans that overlap give one.

    Null texts stay null, empty ones empty; repeated rows stay; an empty table gives no rows.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            for part in slices(batch, column):
                texts = part.column(i)
                new = [t if not f else redacted(t, f) for t, f in zip(texts.to_pylist(), batch_findings(texts), strict=True)]
                arrays = list(part.columns)
                arrays[i] = pa.array(new, texts.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(kernel, df.schema)


def digest(found: DataFrame) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda x: x["depth"] == 0)
    counts = [F.expr(f"cast(size(filter(findings, x -> x.depth = 0 AND x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"), F.size("findings").cast("long").alias("n_spans")
    )
