"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature: sigma spreads a document's shingles over a circle of 2^32 places; coordinate k is the least value that pi, turned by
k places, gives them. Two permutations thus serve all `COORDINATES`. Each of the `BANDS` bands joins four coordinates.

1. A scan gives each row its shingle set's size, 128-bit digest and signature. Rows of equal sets form one class at once, so
   exact copies, however many, cost one row afterwards.
2. Classes meet in band buckets. A bucket compares four-bit sketches of its members' signatures, first with a few hubs, then
   what they leave apart with all. It passes on a few pairs for each member, which connect all members that agree in `LOW`
   places, never all pairs of a group. Buckets beyond `HOT` are shared out; what a share leaves apart is compared with all
   other shares in turn, so the size of a bucket or of its shares changes which pairs are passed on but not what they connect.
3. These pairs are confirmed on full sets. Where a connected group of pairs falls into several parts by its confirmed links, the
   members outside its largest part are compared on full sets with all members of other parts, in blocks.
4. Connected components over confirmed links give each class its smallest doc_id.

A pair of Jaccard 0.75 misses all buckets with a probability of about 2e-4, one of 0.8 with less than 1e-5; it agrees in fewer
than `LOW` places with one of 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.components import components
from lumenspan.llm.kernel import SHINGLE, U, mix, shingle_hashes
from lumenspan.llm.runtime import FEW, discard, materialize, only, slices

COORDINATES = 64
WIDTH = 4
#: Two ways of dealing 64 coordinates into 16 bands of four each.
BANDS = np.concatenate([np.random.Generator(np.random.PCG64(i)).permutation(COORDINATES).reshape(-1, WIDTH) for i in (1, 2)])
SIGMA, PI = 0xA0761D6478BD642F, 0xE7037ED1
DIGEST = 0x1B873593, 0xCC9E2D51
#: Of 64 four-bit coordinates, this many agree in all but 1 in 100,000 pairs of Jaccard 0.75 (49 on average, deviation 3.4).
LOW = 34
#: Places that agree in about half of the pairs of Jaccard 0.77, and in nearly all that a link and such a pair bring together.
MID, CONNECT = 50, 28
#: Hubs that a bucket is compared with one by one; what they leave apart is compared in blocks.
HUBS = 64
#: Members of a bucket from which on it is shared out.
HOT = 1 << 15
#: Members that a share has left apart, in a task that compares them with another share.
LEFT = 4096
#: A group is compared in about DEALT x DEALT blocks, of so many documents and bytes of one side.
DEALT, BLOCKS, BLOCK_BYTES = 16, (64, 2048), 1 << 24
#: Rows with signatures, and bytes of shingle sets, in a file of a table.
SIGNED_ROWS, SET_BYTES = 1 << 15, 1 << 24


def pi(x: np.ndarray) -> np.ndarray:
    x = x ^ np.uint32(PI)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """sets: shingle hashes of non-empty documents in a row, which begin at `begin`. A row of coordinates per document."""
    circle = (mix(sets, SIGMA) >> U(32)).astype(np.uint32)
    out = np.empty((len(begin), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(pi(circle - np.uint32(k)), begin)
    return out


def distinct_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    h, at = shingle_hashes(texts, k)
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return sets, np.fromiter(map(len, sets), np.int64, len(sets))


def _digest(own: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(own, seed).sum(dtype=U).view(np.int64)) for seed in DIGEST)


def _signed(texts_of: str, k: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, texts_of):
                sets, n = distinct_sets(part.column(texts_of), k)
                full = np.flatnonzero(n)
                one, two, sig = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    one[full], two[full] = (np.add.reduceat(mix(every, seed), begin).view(np.int64) for seed in DIGEST)
                    for i, s in zip(full.tolist(), signatures(every, begin), strict=True):
                        sig[i] = s.tobytes()
                more = [c for c in part.schema.names if c not in ("doc_id", texts_of)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n), pa.array(one), pa.array(two), pa.array(sig, pa.binary()),
                        *(part.column(c) for c in more)
                    ],
                    names=["doc_id", "n_shingles", "one", "two", "sig", *more]
                )

    return kernel


def _banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            keys = np.empty((len(BANDS), len(sig)), U)
            for b, own in enumerate(BANDS):
                x = np.full(len(sig), b + 1, U)
                for c in own:
                    x = mix(x + sig[:, c])
                keys[b] = x
            low = (sig & np.uint32(15)).astype(np.uint8)
            sketch = pa.array([x.tobytes() for x in low[:, ::2] | low[:, 1::2] << 4], pa.binary())
            rid = part.column("rid").to_numpy()
            many = np.tile(np.arange(len(sig)), len(BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(rid[many]), sketch.take(pa.array(many))],
                names=["key", "rid", "sketch"]
            )


def _packed(sketch: np.ndarray) -> np.ndarray:
    """Sketches of a byte for each place as four words."""
    return np.ascontiguousarray(sketch[:, ::2] | sketch[:, 1::2] << 4).view(U)


def _unpacked(raw: list[bytes]) -> np.ndarray:
    both = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    sketch = np.empty((len(raw), COORDINATES), np.uint8)
    sketch[:, ::2], sketch[:, 1::2] = both & 15, both >> 4
    return sketch


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each of x agrees with each of y (packed sketches)."""
    out = np.full((len(x), len(y)), COORDINATES, np.uint8)
    for w in range(x.shape[1]):
        d = x[:, w, None] ^ y[None, :, w]
        d |= d >> U(2)
        d |= d >> U(1)
        out -= np.bitwise_count(d & U(0x1111111111111111))
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining each of a with each of b."""
    parent = _roots(parent)
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return parent
        parent = parent.copy()
        np.minimum.at(parent, high, low)
        parent = _roots(parent)


Pairs = list[tuple[np.ndarray, np.ndarray]]


def _joined(
    words: np.ndarray, rows: np.ndarray, others: np.ndarray, parent: np.ndarray, share: np.ndarray | None = None
) -> tuple[Pairs, np.ndarray]:
    """Each of rows against all others, of other shares if these are told: a pair with the nearest of each part that agrees in
    `LOW` places and isn't joined yet. parent holds roots; returns the pairs and the new roots.
    """
    out: Pairs = []
    step = max(1, (1 << 21) // max(len(others), 1))
    for at in range(0, len(rows), step):
        own = rows[at : at + step]
        same = _agreeing(words[own], words[others])
        for i, row in enumerate(own.tolist()):
            hit = np.flatnonzero(same[i] >= LOW)
            hit = hit[parent[others[hit]] != parent[row]]
            if share is not None:
                hit = hit[share[others[hit]] != share[row]]
            if not len(hit):
                continue
            hit = others[hit[np.argsort(-same[i, hit].astype(int), kind="stable")]]
            parts, first = np.unique(parent[hit], return_index=True)
            out.append((np.full(len(parts), row), hit[first]))
            parts = np.append(parts, parent[row])
            parent = np.where(np.isin(parent, parts), parts.min(), parent)
    return out, parent


def _bucket(rid: np.ndarray, sketch: np.ndarray) -> tuple[Pairs, np.ndarray]:
    """Pairs that connect all members which agree in `LOW` places, a few for each member, and each member's part: the place of one of its members.

    Members gather round hubs: the one that most others resemble comes first. A member leaves when it surely resembles a hub, or
    may resemble three. A later hub is paired with the nearest member of each earlier hub's circle. Then whatever is outside
    the largest part and was no hub is compared with all.
    """
    out: Pairs = []
    _, at, back = np.unique(_packed(sketch), axis=0, return_index=True, return_inverse=True)
    alike = at[back.ravel()]
    if len(at) < len(rid):  # equal sketches: paired with the first of them
        other = np.flatnonzero(alike != np.arange(len(rid)))
        out.append((rid[alike[other]], rid[other]))
    own = np.sort(at)
    r, s = rid[own], sketch[own]
    n = len(own)
    circle, tries = np.full(n, -1), np.zeros(n, np.int64)
    queue = np.argsort(mix(r.astype(U)), kind="stable")  # the same documents lead in every bucket
    hubs: list[int] = []
    joins: Pairs = []
    while len(queue := queue[circle[queue] < 0]) and len(hubs) < HUBS:
        first = queue[:32]
        hub = int(
            first[((s[first][:, None] == s[queue][None, :2048]).sum(axis=2) >= MID).sum(axis=1).argmax()]
        ) if len(queue) > 2 else int(queue[0])
        same = (s == s[hub]).sum(axis=1)
        free = circle < 0
        free[hub] = False
        hit = np.flatnonzero(free & (same >= LOW))
        joins.append((np.full(len(hit), hub), hit))
        near = np.flatnonzero((circle >= 0) & (same >= CONNECT))
        near = near[np.argsort(-same[near], kind="stable")]
        near = near[np.unique(circle[near], return_index=True)[1]]
        joins.append((np.full(len(near), hub), near))
        tries[hit] += 1
        circle[hit[(same[hit] >= MID) | (tries[hit] > 2)]] = len(hubs)
        circle[hub] = len(hubs)
        hubs.append(hub)
    a, b = (np.concatenate([j[i] for j in joins]) if joins else np.zeros(0, np.int64) for i in (0, 1))
    parent = _united(np.arange(n), a, b)
    out.append((r[a], r[b]))
    done = np.zeros(n, bool)
    done[hubs] = True
    words = None
    while len(todo := np.flatnonzero((parent != np.bincount(parent, minlength=n).argmax()) & ~done)):
        words = _packed(s) if words is None else words
        todo = todo[:64]
        found, parent = _joined(words, todo, np.arange(n), parent)
        out += [(r[a], r[b]) for a, b in found]
        done[todo] = True
    part = np.empty(len(rid), np.int64)
    part[own] = own[parent]
    return out, part[alike]


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and rid: candidate pairs of each bucket."""

    def pairs(key: np.ndarray, rid: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        size = np.diff(cuts)
        out = []
        two = cuts[:-1][size == 2]
        if len(two):
            two = two[((sketch[two] == sketch[two + 1]).sum(axis=1) >= LOW) & (rid[two] != rid[two + 1])]
            out.append((rid[two], rid[two + 1]))
        for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out += _bucket(rid[a : a + n], sketch[a : a + n])[0]
        a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("key").to_numpy(), batch.column("rid").to_numpy(), _unpacked(batch.column("sketch").to_pylist())))
        rows += batch.num_rows
        if rows < 20_000 or held[0][0][0] == held[-1][0][-1]:
            continue
        key, rid, sketch = (np.concatenate([x[i] for x in held]) for i in range(3))
        stop = int(np.searchsorted(key, key[-1]))
        yield pairs(key[:stop], rid[:stop], sketch[:stop])
        held, rows = [(key[stop:], rid[stop:], sketch[stop:])], len(key) - stop
    if held:
        yield pairs(*(np.concatenate([x[i] for x in held]) for i in range(3)))


def _by_group(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of sorted batches as columns, a group of equal values of the first `keys` columns at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield list(map(list, zip(*held, strict=True)))
                held = []
            held.append(row)
    if held:
        yield list(map(list, zip(*held, strict=True)))


def _pairs_of(found: Pairs) -> pa.RecordBatch:
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    both = both[both[:, 0] != both[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


_SHARE = {
    "key": pa.int64(), "salt": pa.int32(), "rid": pa.int64(), "sketch": pa.binary(), "part": pa.int64(),
    "main": pa.bool_(), "a": pa.int64(), "b": pa.int64()
}


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, salt, rid, sketch by key and salt: each share's pairs (a, b), and its members with their part and whether it is the largest."""
    for key, salt, rid, raw in _by_group(batches, 2):
        ids = np.array(rid)
        found, part = _bucket(ids, _unpacked(raw))
        pairs = _pairs_of(found)
        n, size = pairs.num_rows, np.bincount(part)
        columns = [pa.array(c, t) for c, t in zip((key, salt, rid, raw, ids[part], part == size.argmax()), _SHARE.values(), strict=False)]
        none = [pa.nulls(n, t) for t in list(_SHARE.values())[:6]]
        yield pa.RecordBatch.from_arrays([*none, *pairs.columns], names=list(_SHARE))
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rid), pa.int64()), pa.nulls(len(rid), pa.int64())], names=list(_SHARE))


def _families(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, salt, rid, sketch, size: the leader of each share's largest part. Pairs of those that may belong together, and the
    salts of those in the largest such family.
    """
    for key, salt, rid, raw, size in _by_group(batches, 1):
        words, ids = _packed(_unpacked(raw)), np.array(rid)
        parent, found = np.arange(len(rid)), []
        for i in range(len(rid)):
            near = np.flatnonzero((_agreeing(words[i : i + 1], words)[0] >= CONNECT) & (parent != parent[i]))
            near = near[np.unique(parent[near], return_index=True)[1]]
            found.append((np.full(len(near), ids[i]), ids[near]))
            parent = _united(parent, np.full(len(near), i), near)
        most = np.bincount(parent, np.array(size, float)).argmax()
        pairs, inside = _pairs_of(found), [s for s, p in zip(salt, parent.tolist(), strict=True) if p == most]
        n, m = pairs.num_rows, len(inside)
        yield pa.RecordBatch.from_arrays(
            [*pairs.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=["a", "b", "key", "salt"]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([key[0]] * m, pa.int64()), pa.array(inside, pa.int32())],
            names=["a", "b", "key", "salt"]
        )


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """task, side, salt, rid, part, sketch by task: pairs of what shares have left apart (side 0) with the nearest of each part of
    another share (side 1).
    """
    for _, side, salt, rid, part, raw in _by_group(batches, 1):
        words, ids, share, side = _packed(_unpacked(raw)), np.array(rid), np.array(salt), np.array(side)
        _, first, own = np.unique(np.stack((share, np.array(part))), axis=1, return_index=True, return_inverse=True)
        found, _ = _joined(words, np.flatnonzero(side == 0), np.flatnonzero(side == 1), first[own.ravel()], share)
        yield _pairs_of([(ids[a], ids[b]) for a, b in found])


def _candidates(classes: DataFrame, hot: int, n: int) -> DataFrame:
    """Pairs `a`, `b` of n classes (`rid`, `sig`) from all band buckets.

    One class in 64 tells which buckets have more than about `hot` members. These are gone through in shares of that size. The
    largest parts of a bucket's shares are connected by their leaders, in a family mostly; all members outside of it are
    compared with the members of every other share.
    """
    band = lambda c: c.select("rid", "sig").mapInArrow(_banded, "key long, rid long, sketch binary")
    banded = band(classes)
    drawn = band(classes.where(F.pmod(F.xxhash64("rid"), F.lit(64)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    large = materialize(
        drawn.where(F.col("n") * 64 > hot).select("key", F.ceil(F.col("n") * 64 / hot).cast("int").alias("shares")),
        len(BANDS) * n // hot, least=FEW
    )
    if not large.take(1):
        return banded.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_paired, "a long, b long")
    salted = banded.join(large, "key").withColumn(
        "salt", F.pmod(F.xxhash64("rid"), F.col("shares")).cast("int")
    ).select("key", "salt", "rid", "sketch")
    gathered = materialize(
        salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "rid").mapInArrow(
            _gathered, "key long, salt int, rid long, sketch binary, part long, main boolean, a long, b long"
        )
    )
    members = gathered.where("a IS NULL").select("key", "salt", "rid", "sketch", "part", "main")
    leaders = members.where("main").groupBy("key", "salt").agg(
        F.min_by(F.struct("rid", "sketch"), F.struct(F.col("rid") != F.col("part"), "rid")).alias("x"),
        F.count("*").alias("size")
    )
    joined = materialize(
        leaders.select("key", "salt", "x.rid", "x.sketch", "size").repartition("key").sortWithinPartitions("key", "salt").mapInArrow(
            _families, "a long, b long, key long, salt int"
        )
    )
    inside = joined.where("a IS NULL").select("key", "salt")
    left = materialize(
        members.where("NOT main").select("key", "salt", "rid", "sketch", "part").union(
            members.where("main").select("key", "salt", "rid", "sketch", "part").join(inside, ["key", "salt"], "left_anti")
        )
    )
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / LEFT).cast("int").alias("blocks")).join(large, "key")
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    one = left.join(blocks, "key").select(
        "key", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), every("shares", "share"),
        F.lit(0).alias("side"), "salt", "rid", "part", "sketch"
    )
    two = members.join(blocks, "key").select(
        "key", every("blocks", "block"), F.col("salt").alias("share"), F.lit(1).alias("side"), "salt", "rid", "part",
        "sketch"
    )
    tasks = one.union(two).withColumn("task", F.xxhash64("key", "block", "share")).select("task", "side", "salt", "rid", "part", "sketch")
    apart = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_apart, "a long, b long")
    cool = banded.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_paired, "a long, b long")
    return cool.union(gathered.where("a IS NOT NULL").select("a", "b")).union(joined.where("a IS NOT NULL").select("a", "b")).union(apart)


def _sets(k: int):
    """Rows of doc_id, text joined with the classes (rid, one, two) that the id stands for, rows of one id together: the set of
    each class, once.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given = None, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, _ = distinct_sets(part.column("text"), k)
                rids, rows = [], []
                for doc, rid, one, two, own in zip(
                    *(part.column(c).to_pylist() for c in ("doc_id", "rid", "one", "two")), sets, strict=True
                ):
                    if doc != now:
                        now, given = doc, set()
                    if rid not in given and len(own) and (one, two) == _digest(own):
                        given.add(rid)
                        rids.append(rid)
                        rows.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(rows, pa.binary())], names=["rid", "set"])

    return kernel


def _confirmed(percent: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                names=["a", "b"]
            )

    return kernel


def _across(percent: int):
    """Sorted by task and side (0: outside the largest part): a link from each document of side 0 to each other part that it is
    linked with.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            outer, inner = ([r for r in rows if r[0] == side] for side in (0, 1))
            found: set[tuple[int, int]] = set()
            if outer and inner:
                size = np.array([len(r[3]) for r in inner])
                at = np.concatenate(([0], np.cumsum(size)))
                every = np.concatenate([r[3] for r in inner])
                order = np.argsort(every, kind="stable")
                values, owner = every[order], np.repeat(np.arange(len(inner)), size)[order]
                part = np.array([r[2] for r in inner])
                for _, rid, own, x in outer:
                    low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                    n = high - low
                    where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    common = np.bincount(owner[where], minlength=len(inner))
                    hit = np.flatnonzero((100 * common >= percent * (len(x) + size - common)) & (part != own))
                    found.update((rid, inner[i][1]) for i in hit[np.unique(part[hit], return_index=True)[1]].tolist())
            pairs = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        task, held = None, []
        for batch in batches:
            for t, side, rid, part, own in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "rid", "part", "set")), strict=True):
                if t != task and held:
                    yield linked(held)
                    held = []
                task = t
                held.append((side, rid, part, np.frombuffer(own, U)))
        if held:
            yield linked(held)

    return kernel


def _between_parts(nodes: DataFrame, groups: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """nodes: `rid`, `n_shingles`. Links between different parts of one group, enough to connect those that have any; None if no
    group has parts.
    """
    n = nodes.join(
        groups.withColumnRenamed("root", "g"), F.col("rid") == F.col("node"), "left"
    ).drop("node").join(parts.withColumnRenamed("root", "p"), F.col("rid") == F.col("node"), "left").drop("node")
    n = materialize(n.select("rid", "n_shingles", F.coalesce("g", "rid").alias("gid"), F.coalesce("p", "rid").alias("part")), nodes.count(), least=FEW)
    sizes = n.groupBy("gid", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = F.struct("n", -F.col("part"))
    whole = sizes.groupBy("gid").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max_by("part", largest).alias("main"),
        (F.sum("n") - F.max("n")).alias("out"), (F.sum("s") - F.max_by("s", largest)).alias("out_s"),
        F.count("*").alias("parts")
    )
    block = F.least(F.greatest(F.sqrt(F.col("n") * F.col("out")) / DEALT, F.lit(BLOCKS[0])), F.lit(BLOCKS[1]))
    blocks = lambda n, s: F.ceil(F.greatest(F.col(n) / block, F.col(s) * 8 / BLOCK_BYTES)).cast("int")
    whole = materialize(whole.where("parts > 1 AND n > 2").select("gid", "main", blocks("n", "s").alias("inner"), blocks("out", "out_s").alias("outer")), nodes.count(), least=FEW)
    if not whole.take(1):
        return None
    n = n.join(whole, "gid").withColumn("at", F.xxhash64("rid"))
    every = lambda c, name: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(name)
    out = n.where("part <> main").select(
        "gid", "rid", "part", F.pmod("at", F.col("outer")).cast("int").alias("i"), every("inner", "j"),
        F.lit(0).alias("side")
    )
    inn = n.select("gid", "rid", "part", every("outer", "i"), F.pmod("at", F.col("inner")).cast("int").alias("j"), F.lit(1).alias("side"))
    tasks = out.union(inn).withColumn("task", F.xxhash64("gid", "i", "j")).select("task", "side", "rid", "part")
    return tasks.join(sets, "rid").select("task", "side", "rid", "part", "set").repartition("task").sortWithinPartitions("task", "side").mapInArrow(_across(percent), "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 75, k: int = SHINGLE, hot: int = HOT, tag: str | None = None) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id`, `kept` for each row of `doc_id`, `text`. If a column `tag` (long) is named, also it
    and `group_id`, which tells components apart even if ids repeat (null for rows that stand alone).

    Documents whose k-word shingle sets have a Jaccard similarity of `percent` hundredths or more are linked; component_id is
    the smallest doc_id reachable over links. Null, empty and blank texts have an empty set and stand alone, as do rows without
    a doc_id, whose component_id is null; all of these are kept. Repeated rows share a class; rows of one doc_id and different
    texts are documents each, linked by their own sets. An empty table gives no rows; other columns are left aside.
    """
    if not 1 <= percent <= 100 or percent < 75:
        raise ValueError("the bands are laid out for similarities of 75 to 100 hundredths")
    tags = {tag: "long"} if tag else {}
    docs = only(df, doc_id="long", text="string")
    count = docs.count()
    rows = only(df, doc_id="long", text="string", **tags).mapInArrow(
        _signed("text", k),
        ", ".join(["doc_id long, n_shingles long, one long, two long, sig binary", *(f"`{t}` long" for t in tags)])
    )
    rows = materialize(rows.repartition(max(FEW, -(-count // SIGNED_ROWS))), cleanup=True)  # after the scan, whose tasks stay as many
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("one", "two").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")
    )
    classes = materialize(classes.withColumn("rid", F.monotonically_increasing_id()), count)
    n = classes.count()
    pairs = materialize(_candidates(classes, hot, n).distinct(), n, cleanup=True, least=FEW)
    m = pairs.count()
    ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    ends = materialize(classes.select("rid", "doc", "one", "two", "n_shingles").join(ends, "rid"), 2 * m, least=FEW)
    size = 8 * (ends.agg(F.sum("n_shingles")).first()[0] or 0)
    sets = docs.join(
        ends.drop("n_shingles").hint("merge"), F.col("doc_id") == F.col("doc")
    ).select("doc_id", "rid", "one", "two", "text").mapInArrow(_sets(k), "rid long, set binary")
    sets = materialize(sets.repartition(max(FEW, -(-size // SET_BYTES))), cleanup=True)
    a, b = (sets.select(F.col("rid").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b"))
    links = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")
    parts = components(links, m)
    more = _between_parts(ends.select("rid", "n_shingles"), components(pairs, m), parts, sets, percent)
    roots = parts if more is None else components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), 2 * m)
    discard(pairs, sets)
    inside = roots.union(
        roots.select(F.col("root").alias("node"), "root").distinct()
    ).join(ends.select("rid", "doc"), F.col("node") == F.col("rid")).select("rid", "root", "doc")
    least = inside.groupBy("root").agg(F.min("doc").alias("found"))
    found = inside.join(least, "root").select("rid", "root", "found")
    named = classes.select("one", "two", "rid", "doc").join(found, "rid", "left")
    named = named.select("one", "two", F.coalesce("found", "doc").alias("found"), F.coalesce("root", "rid").alias("group_id"))
    out = rows.drop("sig").join(named, ["one", "two"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = out.withColumns({
        "component_id": F.when(alone, F.col("doc_id")).otherwise(F.coalesce("found", "doc_id")),
        "group_id": F.when(~alone, F.col("group_id")),
    })
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *([tag, "group_id"] if tag else []))
