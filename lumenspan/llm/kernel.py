"""Word and shingle hashing over whole Arrow batches.

Words are the runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z in lower case; those bytes never occur inside a
UTF-8 sequence, so bytes give the same words as code points. A word's hash is a polynomial over a table of random 64-bit
values, taken from prefix sums, so that a batch costs a few passes over its bytes and no Python per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SHINGLE = 5
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_A = U(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, _CHUNK), _powers(_P_INV, _CHUNK)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x ^ U(seed)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins; null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and each text's first word (one entry more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
        n = int(end[j - 1] - base)
        up, down = (_UP, _DOWN) if n <= _CHUNK else (_powers(_P, n), _powers(_P_INV, n))
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[buf[base : base + n]] * up[:n], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (end - start).astype(U) * _A)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and each text's first one. A text of 1 to k-1 words gives its whole sequence
    as one if `whole`, else none.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, ((n > 0) & whole).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(counts)))
    if not at[-1]:
        return np.zeros(0, U), at
    wide = np.zeros(max(len(h) - k + 1, 0), U)
    for i in range(k):
        wide = wide * _A + h[i : i + len(wide)]
    wide = mix(wide)
    text = np.repeat(np.arange(len(n)), counts)
    pos = first[text] + (np.arange(at[-1]) - at[text])
    long = n[text] >= k
    out = np.empty(at[-1], U)
    out[long] = wide[pos[long]]
    for i in np.flatnonzero(~long):
        x = U(0x51ED270B)
        for y in h[first[text[i]] : first[text[i] + 1]]:
            x = U((int(x) * int(_A) + int(y)) & 0xFFFFFFFFFFFFFFFF)
        out[i] = mix(np.array([x]), int(n[text[i]]))[0]
    return out, at


def shingle_hashes(texts: pa.Array, k: int = SHINGLE, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    buf, at = flat(texts)
    start, end, first = words(buf, at)
    return shingles(word_hashes(buf, start, end), first, k, whole)
