"""Cost-balanced packing of token sequences.

Attention costs a document of n tokens `linear * n + quadratic * n^2`. Documents in descending length go to the sequence of
lowest cost that has room. The tokens of a block fill whole sequences of `capacity`, and its remainder fills sequences whose
lengths are powers of two, so no padding is needed anywhere; a document is cut only when it is longer than a sequence or when
no sequence has room for what is left of it.

Blocks are consecutive documents of one input partition, of at most `block_tokens` tokens: a task holds one block, no data is
shuffled, and a lost task repeats the same blocks. Every document belongs to one block, whatever its length; one that is longer
than a block is cut into whole sequences as it is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.runtime import only, slices

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class Known(dict):
    """Words by number; one that is asked for the first time gets the next number and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Token ids of texts, by white-space-separated words.

    The vocabulary's normaliser and pre-tokeniser never join text across white space, so a text's ids are its words' ids in a
    row, and ASCII capitals may be lowered first where it lowers them itself. Words seen before are looked up; new ones are
    encoded in strings of many, with a mark between them. `most` bounds the memory kept for words, not the words: beyond it,
    words that have been met once only are forgotten.
    """

    MARK = "\x01"
    SIGNS = ".,;:!?#%&*$)]}-"

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.most = most
        ids = lambda x: self.of.encode(x, add_special_tokens=False).ids
        self.mark = m[0] if len(m := ids(self.MARK)) == 1 and ids(f"a {self.MARK} a") == [*ids("a"), *m, *ids("a")] else None
        self.lowers = ids("AbC dEF") == ids("abc def")
        self.cuts = all(ids(f"a{x}") + ids(s) == ids(f"a{x}{s}") for x in "b1" for s in self.SIGNS)
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.size, self.uses, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def forget(self) -> None:
        """Keep the words met most, half of `most` at best."""
        words = list(self.known)
        uses = self.uses[: len(words)]
        least = 2
        while (uses >= least).sum() > self.most // 2:
            least *= 2
        keep = np.flatnonzero(uses >= least)
        ids, sizes = self.of_words(keep)
        uses = uses[keep] // 2
        self.clear()
        for i in keep.tolist():
            self.known[words[i]]
        self.known.new = []
        self.grow()
        self.uses[: len(keep)] = uses
        self.add(np.arange(len(keep)), ids, sizes)

    def grow(self) -> None:
        while len(self.known) > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size, self.uses))

    def encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each has."""
        if not new:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.mark is None or any(self.MARK in w for w in new):
            ids = [x.ids for x in self.of.encode_batch(new, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        some, sizes = [], []
        for i in range(0, len(new), 250):
            ids = np.array(self.of.encode(f" {self.MARK} ".join(new[i : i + 250]) + f" {self.MARK}", add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            some.append(np.delete(ids, marks))
            sizes.append(np.diff(marks, prepend=-1) - 1)
        return np.concatenate(some), np.concatenate(sizes)

    def add(self, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.begin[which] = self.used + np.cumsum(sizes) - sizes
        self.size[which] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def of_words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of known words in a row, and how many each has."""
        size = self.size[which]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[which] - ends + size, size)], size

    def learn(self) -> None:
        """Ids of the new words. Where the pre-tokeniser cuts between a letter or digit and other signs, the signs that end a word
        are encoded apart.
        """
        known, new = self.known, self.known.new
        first = len(known) - len(new)
        alone, whole, parts = [], [], []
        for w in new:  # which grows by parts that are new themselves
            c = w.rstrip(self.SIGNS) if self.cuts else w
            if c and len(c) < len(w) and c[-1].isalnum() and c[-1].isascii():
                whole.append(w)
                parts += [known[c], known[w[len(c) :]]]
            else:
                alone.append(w)
        self.grow()
        split = np.fromiter(map(known.__getitem__, whole), np.int64, len(whole))
        rest = np.setdiff1d(np.arange(first, len(known)), split, assume_unique=True)
        self.add(rest, *self.encoded(alone))
        if whole:
            ids, sizes = self.of_words(np.array(parts, np.int64))
            self.add(split, ids, sizes.reshape(-1, 2).sum(axis=1))
        known.new = []

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids for each text; null as empty."""
        if len(self.known) > self.most:
            self.forget()
        split = [self.words(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.known.new:
            self.learn()
        self.uses[: len(self.known)] += np.bincount(which, minlength=len(self.known))
        ids, size = self.of_words(which)
        stops = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # these split words in Python but not in the vocabulary's pattern
            return [text]
        if self.lowers and "<|" not in text:  # which may name a special token
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return text.split()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); lengths are those of a block's documents.

    As what is placed gets shorter, sequences that once had too little room come back: `waiting` holds them by room, `heap` those
    that have room for the piece at hand, by cost. A document is cut only when no sequence has room for it; the sequence with
    most room takes its beginning, and the rest is placed in its turn.
    """
    total = sum(lengths)
    whole, rest = divmod(total, capacity)
    room = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out: list[list[tuple[int, int, int]]] = [[] for _ in room]
    todo = [(-min(m - at, capacity), d, at) for d, m in enumerate(lengths) for at in range(0, m, capacity)]
    heapq.heapify(todo)
    waiting: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    for i, r in enumerate(room):
        waiting[r].append((0.0, i))
    heap: list[tuple[float, int]] = []
    least = most = capacity + 1  # all of room `least` or more are in heap; none that waits has more than `most`
    while todo:
        n, d, at = heapq.heappop(todo)
        n = -n
        while least > n:
            least -= 1
            for x in waiting[least]:
                heapq.heappush(heap, x)
            waiting[least] = []
        if heap:
            c, i = heapq.heappop(heap)
            put = n
        else:
            most = min(most, least - 1)
            while not waiting[most]:
                most -= 1
            c, i = min(waiting[most])
            waiting[most].remove((c, i))
            put = most
            heapq.heappush(todo, (put - n, d, at + put))
        out[i].append((d, at, put))
        room[i] -= put
        if room[i]:
            x = c + linear * put + quadratic * put * put, i
            if room[i] >= least:
                heapq.heappush(heap, x)
            else:
                waiting[room[i]].append(x)
    return out


def pack(
    df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0,
    quadratic: float = 1 / 1024, block_tokens: int = 1 << 20
) -> DataFrame:
    """Pack `doc_id`, `text` of every row into sequences of at most `capacity` tokens.

    A row's tokens are the ids of its whole text, then `end_id`; null or empty texts are `end_id` alone. Returns a row per
    piece, with its ids as little-endian unsigned 32-bit integers. Rows with a null or repeated doc_id are documents of their
    own. An empty table gives no rows. Other columns are left aside, whatever their names.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # document, start, its tokens, ids
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal number, held, size
            columns: list[list] = [[] for _ in range(8)]
            for seq in assign([len(x[3]) for x in held], capacity, linear, quadratic):
                full, at = sum(n for _, _, n in seq), 0
                for d, s, n in seq:
                    doc, start, tokens, ids = held[d]
                    for c, v in zip(columns, (doc, start + s, n, ids[s : s + n].astype("<u4").tobytes(), tokens, number, at, full), strict=True):
                        c.append(v)
                    at += n
                number += 1
            held, size = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4), strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for at in range(0, len(ids), block_tokens):
                        piece = ids[at : at + block_tokens]
                        if size + len(piece) > block_tokens:
                            yield packed()
                        held.append((doc, at, len(ids), piece))
                        size += len(piece)
        if held:
            yield packed()

    return only(df, doc_id="long", text="string").mapInArrow(kernel, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_tokens"
    )
