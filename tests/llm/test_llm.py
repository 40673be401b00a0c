import base64
import bz2
import collections
import gzip
import hashlib
import io
import lzma
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import components, fingerprint, html_text, kernel, langid, minhash, mixing, packing, queries, runtime, secret_scan, substring, topk, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(1)
    long = sentence(rng, 30_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", None, "s", 3),
        (4, "One two\x0bthree", "en", None, 1), (5, long, "en", "t", 1), (6, long + " end", "en", "t", 1),
        (None, "no id here at all, none", "en", "s", 1), (7, "x" * 100_000, "de", "s", 1),
        (8, "Ünï ©ode 🎉 wörds \x1c and more", "de", "u", 1), (8, "Ünï ©ode 🎉 wörds \x1c and more", "de", "u", 1),
        (9, "12345 %%% 678", None, "s", 1)
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("key", "rid", "one", "two", "sig", "a", "b", "size", "target", "ids", "score", "_size", "findings", "part", "task"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_kernel_hashes_tell_words_apart():
    texts = ["Ab  c\td\n", None, "", "ab c d", "ab cd", "a" * 600_000 + " b", " x"]
    h, at = kernel.shingle_hashes(pa.array(texts), 3)
    sets = [tuple(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    assert sets[0] == sets[3] and len(sets[0]) == 1 and sets[1] == sets[2] == () and len({sets[3], sets[4], sets[5], sets[6]}) == 4
    buf, off = kernel.flat(pa.array(texts).slice(3, 2))
    start, end, first = kernel.words(buf, off)
    assert first.tolist() == [0, 3, 5] and [bytes(buf[a:b]) for a, b in zip(start, end)] == [b"ab", b"c", b"d", b"ab", b"cd"]


# ---- packing


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for d, x in docs:
        ids = np.append(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4"), np.uint32(1))
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    seqs, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for own in seqs.values():
        at = 0
        for a, n in sorted(own):
            assert a == at and n > 0
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(n * c for (_, n, _), c in want.items())
    for (d, n, crc), c in want.items():
        if c == 1 and sum(1 for k in want if k[0] == d) == 1:
            pieces = sorted((r.start, r.ids) for r in by[d])
            assert zlib.crc32(b"".join(bytes(x) for _, x in pieces)) == crc
            assert all(r.doc_tokens == n for r in by[d])


def test_packing_covers_every_token(spark, odd, none):
    rows = packing.pack(odd, WORDS).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(none, WORDS).count() == 0
    assert packing.digest(packing.pack(odd.where("doc_id = 1"), WORDS)).collect()[0][:5] == (1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1)


def test_packing_blocks_smaller_than_a_document(spark, odd):
    rows = packing.pack(odd, WORDS, block_tokens=4096).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()])


def test_assignment_balances_cost():
    rng = random.Random(3)
    lengths = [rng.randint(1, 1500) for _ in range(400)]
    seqs = packing.assign(lengths, 2048, 1.0, 1 / 1024)
    full = [s for s in seqs if sum(n for _, _, n in s) == 2048]
    cost = [sum(n + n * n / 1024 for _, _, n in s) for s in full]
    assert len(full) == sum(lengths) // 2048 and max(cost) < 1.6 * np.mean(cost)


def placed_slowly(lengths, capacity, linear, quadratic):
    """The packing rule by looking at every sequence each time, and how often a document was cut although a sequence had room."""
    whole, rest = divmod(sum(lengths), capacity)
    room = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    cost, out = [0.0] * len(room), [[] for _ in room]
    todo = [(-min(m - at, capacity), d, at) for d, m in enumerate(lengths) for at in range(0, m, capacity)]
    while todo:
        n, d, at = min(todo)
        todo.remove((n, d, at))
        fits = [i for i, r in enumerate(room) if r >= -n] or [i for i, r in enumerate(room) if r == max(room)]
        i = min(fits, key=lambda i: (cost[i], i))
        put = min(-n, room[i])
        if put < -n:
            todo.append((n + put, d, at + put))
        out[i].append((d, at, put))
        room[i] -= put
        cost[i] += linear * put + quadratic * put * put
    return out


def test_assignment_takes_the_cheapest_sequence_with_room():
    rng = random.Random(4)
    for _ in range(120):
        lengths = [rng.randint(1, rng.choice([5, 50, 300])) for _ in range(rng.randint(0, 60))]
        assert packing.assign(lengths, 64, 1.0, 1 / 1024) == placed_slowly(lengths, 64, 1.0, 1 / 1024)


@pytest.mark.parametrize("kind", ["log-normal", "mixed"])
def test_few_documents_are_cut(kind):
    """Blocks of a million tokens: a document is cut only when no sequence has room."""
    rng = np.random.default_rng(6)
    draw = (lambda: rng.lognormal(5, 1.2)) if kind == "log-normal" else (
        lambda: rng.integers(1, 60) if rng.random() < 0.7 else rng.integers(600, 1400)
    )
    lengths = []
    while sum(lengths) < 1_000_000:
        lengths.append(max(1, int(draw())))
    sequences = packing.assign(lengths, 2048, 1.0, 1 / 1024)
    assert sum(n for s in sequences for _, _, n in s) == sum(lengths)
    pieces = collections.Counter(d for s in sequences for d, _, _ in s)
    cut = [d for d, n in pieces.items() if n > -(-lengths[d] // 2048)]
    assert len(cut) < 0.06 * len(lengths) and max(pieces[d] for d in cut) <= 6


def test_words_that_are_new_in_known_parts_only(spark):
    """A slice of which every new word is made of known ones teaches the encoder nothing more."""
    docs = [(1, "the end ." + " x" * 600_000), (2, "the end."), (3, "the end . end.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check_packing(packing.pack(df, WORDS).collect(), docs)


def test_encoder_keeps_what_it_meets_often():
    rng = random.Random(2)
    e = packing.Encoder(WORDS, most=40)
    for _ in range(30):
        t = sentence(rng, 30) + " often met words."
        assert e([t])[0].tolist() == e.of.encode(t, add_special_tokens=False).ids
    assert "often" in e.known and len(e.known) <= 40 + 2 * 33


def test_encoder_forgets_and_goes_on():
    small = packing.Encoder(WORDS, most=3)
    whole = packing.Encoder(WORDS)
    texts = ["a b c d e f.", "g, h! (i) it's \x01 <|endoftext|> x<|ENDOFTEXT|>", "ÀÉ 'quoted' don't 12ab34"] * 2
    for t in texts:
        want = whole.of.encode(t, add_special_tokens=False).ids
        assert small([t])[0].tolist() == want == whole([t])[0].tolist()


# ---- top k


def brute_top(ids, v, asked, k=10):
    out = []
    for i in asked:
        s = [(-int(np.dot(v[i], v[j])), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
        out += [(ids[i], n + 1, d, -x) for n, (x, d) in enumerate(sorted(s)[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_top_k_is_exact(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)) * rng.choice([0.1, 1, scale], size=(900, 1))
    x[100:140] = x[100]
    df = spark.createDataFrame(
        [(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"
    ).withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == sorted(brute_top(list(range(900)), np.floor(1024 * x).astype(np.int64), range(0, 900, 50)))


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (7, [1e300, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]),
        (None, [9.0, 9.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (100, [1.0]), (200, [0.0, 0.0])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [5, 6, 6] and [g[2] for g in got if g[0] == 200] == [0, 5, 6]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_coordinate_pruning_is_used_and_exact():
    rng = np.random.default_rng(5)
    v = rng.integers(-1000, 1000, (3000, 3))
    q = v[:20]
    want = brute_top(list(range(3000)), v, range(20), 5)
    best = topk.search(np.arange(3000), v, np.arange(20), q, np.full(20, topk.LOW), 5)
    assert [(i, n + 1, int(best.id[i, n]), int(best.score[i, n])) for i in range(20) for n in range(5)] == want


# ---- substring


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    x, at, t = rng.integers(0, 1 << 62, 700, dtype=np.uint64) << np.uint64(1), np.array([0, 300, 305, 305, 700]), 20
    l, c, r = substring.compact_windows(x, at, t)
    want = []

    def grow(a, b):
        if b - a + 1 >= t:
            m = a + int(np.argmin(x[a : b + 1]))
            want.append((a, m, b))
            grow(a, m - 1), grow(m + 1, b)

    for a, b in zip(at[:-1], at[1:]):
        grow(int(a), int(b) - 1)
    assert sorted(zip(l.tolist(), c.tolist(), r.tolist())) == sorted(want)


def exact_repeats(docs, n=50):
    seen = collections.defaultdict(set)
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(d)
    return {d for own in seen.values() if len(own) > 1 for d in own}


def test_repeats_are_found_and_clean_documents_left(spark):
    rng = random.Random(7)
    common, near = sentence(rng, 60), sentence(rng, 90).split()
    docs = []
    for i in range(60):
        t = [sentence(rng, rng.randint(5, 150))]
        if i % 3 == 0:
            t.insert(rng.randint(0, 1), common.upper() if i % 2 else common)
        docs.append((i, " ".join(t)))
    changed = near[:40] + ["other"] + near[41:]
    docs += [
        (100, sentence(rng, 30) + " " + " ".join(near)), (101, " ".join(changed) + " " + sentence(rng, 30)),
        (102, sentence(rng, 40) + " " + " ".join(sentence(rng, 49).split())), (103, None), (104, ""),
        (None, docs[0][1]), (105, docs[0][1])
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("x"))
    got = substring.repeats(df).collect()
    found = {r.doc_id for r in got}
    assert exact_repeats([x for x in docs if x[0] is not None]) <= found
    assert found == {i for i in range(60) if i % 3 == 0} | {100, 101, 105}
    for r in got:
        a, b = words(dict(docs)[r.doc_id])[r.start_word : r.end_word], words(dict(docs)[r.match_doc_id])
        assert len(a) >= 50 and len(
            {tuple(a[i : i + 5]) for i in range(len(a) - 4)} & {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        ) >= 0.6 * len(a)
    assert substring.repeats(df.limit(0)).count() == 0


def linked_docs(links, n):
    root = list(range(n))
    for a, b in zip(links.column("a").to_pylist(), links.column("b").to_pylist()):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    return all(root[i] < i for i in range(1, n))


def test_long_runs_of_one_window_in_parts(monkeypatch):
    rng = random.Random(8)
    common = sentence(rng, 70)
    texts = [f"{sentence(rng, 20)} {common} {sentence(rng, 20)}" for i in range(300)]
    made = []
    for i, x in enumerate(texts):
        buf, at = kernel.flat(pa.array([x]))
        start, end, first = kernel.words(buf, at)
        h, at = kernel.shingles(kernel.word_hashes(buf, start, end), first, 5, whole=False)
        made.append(substring._rows(h, at, at, np.array([i]), 46))
    columns = [np.concatenate(x) for x in zip(*made)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    table = pa.table([*(pa.array(x[order]) for x in columns), pa.array(np.zeros(len(order), np.int64))], names=list(substring._NAMES))
    for held in (1 << 18, 100):
        monkeypatch.setattr(substring, "HELD", held)
        monkeypatch.setattr(substring, "READY", min(held, 20_000))
        links = pa.Table.from_batches(list(substring._linked(iter(table.to_batches(max_chunksize=50)))))
        assert links.num_rows < 300 * 40 and linked_docs(links, 300)


def test_hot_windows_are_combined_in_each_task(spark, monkeypatch):
    """What all documents share leaves each task once for a group, and the documents are linked all the same."""
    rng = random.Random(9)
    common = sentence(rng, 70)
    docs = [
        (i, f"{sentence(rng, 20)} {common} {sentence(rng, 20)}") for i in range(400)
    ] + [(1000 + i, sentence(rng, 90)) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    plain = substring.shared_passages(df).collect()
    monkeypatch.setattr(substring, "HOT", 64 * 3)
    keys = collections.Counter(r.key for r in df.mapInArrow(substring._keys(5, 46), "key long").collect())
    hot = np.array(sorted(k for k, n in keys.items() if n > 50), np.int64)
    rows = df.mapInArrow(substring._windows(5, 46, hot, 1 << 18), substring.WINDOWS).where("win = 0")
    most = rows.groupBy("key").count().agg(F.max("count")).first()[0]
    assert len(hot) >= 6 and max(keys.values()) == 400 and most < 50
    for got in (plain, substring.shared_passages(df).collect()):
        assert linked_docs(pa.table({"a": [r.a for r in got], "b": [r.b for r in got]}), 400) and len(got) < 1600
        assert all(r.a_end - r.a_start >= 70 and r.b < 1000 for r in got)


def test_passages_around_a_line_of_many_documents(spark):
    """Lines of 45 words, too short alone, are in many documents; some share a few words more, but not with the first of them."""
    rng = random.Random(3)
    texts, pairs = [], set()
    for line in (sentence(rng, 45) for _ in range(8)):
        n = len(texts)
        texts += [[sentence(rng, 60), line, sentence(rng, 60)] for _ in range(60)]
        for i in range(6):
            more = sentence(rng, 6)
            pairs.add((n + 5 + i, n + 40 + i))
            for j in (n + 5 + i, n + 40 + i):
                texts[j].insert(2 if i % 2 else 1, more)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = substring.shared_passages(df).collect()
    assert {(r.a, r.b) for r in got} == pairs and all(r.a_end - r.a_start >= 51 for r in got)  # chance may add a word


def test_near_passages_around_a_line_of_many_documents(spark):
    """The line, another word, and some words that two documents share: 54 words with one change."""
    rng = random.Random(5)
    texts, pairs = [], set()
    for line in (sentence(rng, 45) for _ in range(6)):
        n = len(texts)
        texts += [f"{sentence(rng, 60)} {line} {sentence(rng, 60)}" for _ in range(40)]
        for i in range(6):
            more = sentence(rng, 8)
            pairs.add((n + 3 + i, n + 30 + i))
            for j in (n + 3 + i, n + 30 + i):
                texts[j] = f"{sentence(rng, 60)} {line} changed{j} {more} {sentence(rng, 60)}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = substring.shared_passages(df).collect()
    assert {(r.a, r.b) for r in got} <= pairs and len({(r.a, r.b) for r in got}) >= 0.95 * len(pairs)


def test_passages_of_repeated_words_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    docs = [(i, f"{sentence(rng, 30)} {'so ' * (60 + 7 * i)}{'on ' * (50 + i)}{sentence(rng, 30)}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (sorted(map(tuple, substring.shared_passages(df.repartition(n)).collect())) for n in (2, 7))
    assert one == two and linked_docs(pa.table({"a": [r[0] for r in one], "b": [r[3] for r in one]}), 40)


def test_shuffles_of_a_written_table_are_removed(spark):
    import time

    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files.getAllFiles().toString()))
    before = shuffles()
    table = runtime.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), cleanup=True)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and table.count() == 7 and spark.conf.get(runtime.CLEANUP, None) is None


def test_a_passage_between_two_repeated_words(spark):
    rng = random.Random(4)
    docs = [(1, ["The"] * 30 + ["one"] * 25 + ["two"] * 35 + ["the"] * 40), (2, ["one"] * 45 + ["two"] * 90), (3, ["two"] * 70)]
    df = spark.createDataFrame([(i, f"{sentence(rng, 40)} {' '.join(x)} {sentence(rng, 40)}") for i, x in docs], "doc_id long, text string")
    got = {tuple(r) for r in substring.shared_passages(df).collect()}
    assert (1, 70, 130, 2, 60, 120) in got and (2, 3) in {(r[0], r[3]) for r in got}


def test_windows_of_a_run_in_parts_are_crowded(monkeypatch):
    """A group of ten has two windows in each part of a run, too few to look crowded there: the whole run counts as crowded."""
    monkeypatch.setattr(substring, "HELD", 20)
    monkeypatch.setattr(substring, "READY", 20)
    rows = [(8, i, i + 100 << 32 | 60 << 16 | 60, (1 << 48) * (1 if i % 10 == 5 else i + 2), 0) for i in range(100)]
    table = pa.table([pa.array(x) for x in zip(*rows)], names=list(substring._NAMES))
    links = pa.Table.from_batches(list(substring._linked(iter(table.to_batches(max_chunksize=20))))).to_pylist()
    told = {r["a"]: r["at"] for r in links if r["a"] == r["b"]}
    assert set(range(100)) == set(told) and told[5] == 60 << 32 | 105
    assert {r["a"] for r in links if r["a"] != r["b"]} <= set(range(5, 100, 10))


def test_a_hub_comes_to_its_partners_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    one = sentence(rng, 3000).split()
    docs = [(0, " ".join(one))] + [(i, f"{sentence(rng, 10)} {' '.join(one[20 * i : 20 * i + 60])}") for i in range(1, 100)]
    docs += [docs[5], docs[5]]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {
        partners: sorted(
            map(tuple, substring.shared_passages(df).collect())
        ) for partners in (64, 3) if not monkeypatch.setattr(substring, "PARTNERS", partners)
    }
    assert got[64] == got[3] and {r[3] for r in got[3] if r[0] == 0} == set(range(1, 100))
    assert len(set(got[3])) == len(got[3])


@pytest.mark.parametrize("n, changes", [(50, 1), (60, 1), (80, 2), (101, 2), (101, 3), (150, 4)])
def test_recall_of_changed_passages(spark, n, changes):
    """Pairs of passages with changed words at random places: all of 75 % similarity by brute force are looked for."""
    rng = random.Random(n + changes)
    docs, want = [], set()
    for i in range(150):
        one = sentence(rng, n).split()
        two = one[:]
        for j in rng.sample(range(5, n - 5), changes):  # a passage begins and ends with five equal words
            two[j] = "changed"
        a, b = ({tuple(x[j : j + 5]) for j in range(n - 4)} for x in (one, two))
        docs += [(2 * i + j, f"{sentence(rng, 40)} {' '.join(p)} {sentence(rng, 40)}") for j, p in enumerate((one, two))]
        if 100 * len(a & b) >= 75 * len(a | b):
            want.add((2 * i, 2 * i + 1))
    got = {(r.a, r.b) for r in substring.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 20 and len(got & want) >= 0.98 * len(want), (len(got & want), len(want))
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_a_passage_that_one_document_repeats_often(spark):
    rng = random.Random(9)
    common = sentence(rng, 60)
    for m in (1, 16, 17, 50):
        docs = [
            (1, f"{sentence(rng, 20)} {common} {sentence(rng, 20)}"),
            (2, " ".join(f"{sentence(rng, 30 + i)} {common}" for i in range(m)))
        ]
        got = {(r.a, r.b, r.b_start) for r in substring.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got and {x[:2] for x in got} == {(1, 2)}, m


def test_near_passages_are_found(spark):
    rng = random.Random(10)
    docs, pairs = [], set()
    for i in range(200):  # Jaccard 0.80 to 0.85 over 50 to 66 words
        one = sentence(rng, 50 + i % 17).split()
        two = [*one[: len(one) // 2], "changed", *one[len(one) // 2 + 1 :]]
        docs += [(2 * i + j, f"{sentence(rng, 60)} {' '.join(p)} {sentence(rng, 60)}") for j, p in enumerate((one, two))]
        pairs.add((2 * i, 2 * i + 1))
    got = {(r.a, r.b) for r in substring.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= pairs and len(got) >= 198


def test_repeats_of_odd_rows(odd):
    assert {r.doc_id for r in substring.repeats(odd).collect()} == {5, 6}


def test_all_exact_repeats_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert exact_repeats(docs) <= {r.doc_id for r in queries.op3_substring(spark, SF).collect()}


# ---- html


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("<script>x</script>", ""), ("plain &lt;text&gt; &amp more", "plain <text> & more"),
        ("<body><nav><a>Home</a></nav><article><h1>T</h1><p>One  two<br>three</p><p>Four</p><aside>Side</aside><p>Five</article><footer>&copy; x</footer>", "T\n\nOne two three\n\nFour\n\nFive"),
        ("<article><p>Some <b>bold <i class='ad'>buy</i> text</b> that goes <ins class=adsbygoogle>ad</ins>on.</p></article>", "Some bold text that goes on."),
        ("<main><p>Some long text of an article, it goes on.</p><div class='comments'><p>A comment that is quite long, too, really.</p></div></main>", "Some long text of an article, it goes on."),
        ("<div class='wrap has-sidebar'><div id='cookie-notice'>We use cookies</div><div class='post'><p>First paragraph of the text here.</p><p>Ok.</p><p>Last paragraph of the text here.</p></div><div class='sidebar'><ul><li><a>x</a></ul></div><form>Mail <input></form></div>", "First paragraph of the text here.\n\nOk.\n\nLast paragraph of the text here."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_an_article_lose_no_text():
    rng = random.Random(4)
    long, short = [sentence(rng, 120) for _ in range(4)], sentence(rng, 100)
    p = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    menu = "<nav><a>Home</a></nav>"
    assert html_text.main_text(
        f"<body>{menu}<div><section>{p(long)}</section><section>{p([short])}</section></div></body>"
    ) == "\n\n".join([*long, short])
    divs = [" ".join(long), short, sentence(rng, 60)]
    assert html_text.main_text(f"<body>{menu}" + "".join(f"<div>{t}</div>" for t in divs) + "</body>") == "\n\n".join(divs)
    assert html_text.main_text(f"<body>{menu}<h1>Title</h1>{p(long)}<p>The end.</p></body>") == "\n\n".join(["Title", *long, "The end."])


LINKS = "".join(f"<div><a href=/{i}>Go to part {i}</a></div>" for i in range(8))


def telling_nothing(rng):
    """A page without article, main or names that say anything, by its parts; and its text."""
    title, long, short = sentence(rng, 6), [sentence(rng, rng.randint(40, 120)) for _ in range(4)], "So it is."
    text = [title, long[0], short, long[1], f"A <b>list</b> of {short}", long[2], long[3]]
    inner = f"<h2>{title}</h2>" + "".join(f"<p>{t}</p>" for t in text[1:])
    return text, inner


@pytest.mark.parametrize("indent", [False, True])
def test_ratios_find_the_text_of_pages_that_say_nothing(monkeypatch, indent):
    rng = random.Random(11)
    for _ in range(40):
        text, inner = telling_nothing(rng)
        side = "".join(f"<div><span>{sentence(rng, 2)}</span> <a>{sentence(rng, 1)}</a></div>" for _ in range(6))
        page = f"<html><body><div class=x1><div>{LINKS}</div></div><div class=x2><div class=x3>{inner}</div><div class=x4>{side}</div></div><div class=x5><span>Since</span> <b>1999</b> <a>Us</a></div></body></html>"
        if indent:
            page = page.replace("<div", "\n  <div").replace("<p", "\n<p")
        want = "\n\n".join(re.sub("<[^>]*>", "", t) for t in text)
        assert html_text.main_text(page) == want
        with monkeypatch.context() as m:
            m.setattr(html_text, "upper", lambda ratio, sigma: np.ones(len(ratio), bool))
            assert html_text.main_text(page) != want  # the clusters decide, not what elements are called


def test_parts_beside_the_content():
    rng = random.Random(12)
    one, two = (f"<p>{sentence(rng, 90)}</p><p>{sentence(rng, 70)}</p>" for _ in range(2))
    said = lambda *x: [re.sub("<[^>]*>", "", p) for h in x for p in re.findall("<p>.*?</p>", h)]
    # two parts with content, links between and before them
    assert html_text.main_text(
        f"<body><div>{LINKS}</div><div><div>{LINKS}</div>{one}</div><div>{LINKS}</div><div>{two}</div><div>{LINKS}</div></body>"
    ).split("\n\n") == said(one, two)
    # a short part between
    assert html_text.main_text(
        f"<body><div>{LINKS}</div><div>{one}</div><div>Yes, <a>so</a> it was.</div><div>{two}</div></body>"
    ).split("\n\n") == [*said(one), "Yes, so it was.", *said(two)]
    # a page that is one form, a form on a page, lines of the source
    assert html_text.main_text(f"<body><form><div>{LINKS}</div><div>{one}</div></form></body>").split("\n\n") == said(one)
    assert html_text.main_text(f"<body><div>{one}</div><form>Your name, please <input></form></body>").split("\n\n") == said(one)
    assert html_text.main_text("<body><div>" + one.replace(" ", "\n") + f"</div><div>{LINKS}</div></body>").split("\n\n") == said(one)


@pytest.mark.parametrize(
    "unit",
    [
        "<div>", "<div>x", "<div class=ad>x", "<span>x", "<b><table>", "<ul><li>x", "<p><b>x", "<form>x",
        "<article><div class=ad>x", "</p>", "x<br>", "<td>x\n"
    ]
)
def test_deep_nesting_takes_linear_time(unit):
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text(unit * n)
        return time.process_time() - began

    took(1000)
    n = (1 << 20) // len(unit) // 4
    assert min(took(4 * n) for _ in range(2)) < 8 * max(took(n), 0.05)


def test_extraction_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op4_html(spark, SF).collect()}
    import html as H

    for p in pages.collect():
        inner = p.html.split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_extraction_keeps_other_columns(spark):
    df = spark.createDataFrame(
        [(1, None, "<p>a b</p>", "t", 5), (None, "u", None, None, None), (1, None, "<p>a b</p>", "t", 5)],
        "page_id long, url string, html string, text string, other int"
    )
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, None, 5, "a b", 3), (None, "u", None, "", 0), (1, None, 5, "a b", 3)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_page():
    body = "".join(f"<p>Paragraph {i} with some words in it.</p>" for i in range(20_000))
    assert html_text.main_text(f"<nav>x</nav><article>{body}</article>").count("\n\n") == 19_999


# ---- language


def test_held_out_accuracy(spark):
    got = queries.op5_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    pred = collections.defaultdict(set)
    for r in got:
        pred[r.doc_id].add(r.lang_pred)
    assert len(got) == odd.count() and pred[1] == pred[2] == pred[3] == pred[9] == {"und"} and pred[5] <= {"en", "de"}
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit("xx"))).collect()} == {"xx", "und"}


def test_prediction_sees_only_text(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.lang_pred for r in langid.identify(d).collect()}
    model = langid.fit(langid.held_out(d).where("NOT held_out"))
    b = {r.doc_id: r.lang_pred for r in langid.predict(d.select("doc_id", "text", F.lit("zz").alias("lang")), model).collect()}
    assert a == b


def test_rare_languages_and_copies_are_learnt(spark):
    """A language of a few texts copied thousands of times beside larger ones, and more languages than any bound on them would leave."""
    rng = random.Random(6)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    text = lambda c, n=20: " ".join("".join(rng.choice(letters[c]) for _ in range(5)) for _ in range(n))
    rows = [(text("aa"), "aa") for _ in range(2000)] + [(text("bb"), "bb") for _ in range(2000)] + [
        (t, "cc") for t in [text("cc") for _ in range(5)] for _ in range(600)
    ]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_lang=50)
    assert model["families"] == ["aa", "bb", "cc"]
    asked = [(c, text(c)) for c in letters for _ in range(10)]
    got = langid.predict(spark.createDataFrame(asked, "lang string, text string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), model)
    assert got.columns == ["lang", "text", "lang_pred", "score"] and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got.collect())
    many = [(f"{'xyz'[i % 3]}{i} " * 5, f"l{i:03}") for i in range(260)]
    assert len(langid.fit(spark.createDataFrame(many, "text string, lang string"), most_rows=300)["families"]) == 260
    assert len(langid.fit(spark.createDataFrame(many, "text string, lang string"), most_rows=100)["families"]) == 100


def test_closely_related_languages_are_told_apart(spark):
    rng = random.Random(8)
    common = [sentence(rng, 1) for _ in range(200)]
    own = {c: [sentence(rng, 1) for _ in range(60)] for c in ("en", "de", "nl", "fr", "it")}
    text = lambda c: " ".join(rng.choice(own[c] if rng.random() < 0.4 else common) for _ in range(60))
    rows = [(i, text(c), c) for i, c in enumerate(rng.choices(sorted(own), k=1500))]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {d: c for d, _, c in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


# ---- mixing


def brute_mix(rows):
    size = [len(re.findall(SPACE, t or "")) for _, t, _ in rows]
    by = collections.defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        by[s] += n
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, goal = 1.5 * sum(size), set(names), {}
    while open_:
        full = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > 2 * by[s]]
        if not full:
            goal |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            break
        for s in full:
            goal[s] = 2.0 * by[s]
            open_.discard(s)
        left = 1.5 * sum(size) - sum(goal.values())
    return size, by, goal


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_mixing(spark, odd, table):
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    size, by, goal = brute_mix(rows)
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, n) for (d, _, _), n in zip(rows, size))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(
        spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    ).agg(F.sum("taken")).first()[0] == 0


def test_epochs_come_before_fractions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for r in mixing.mix(d).where("size > 0").collect():
        assert r.epochs * r["size"] <= r.taken <= (r.epochs + 1) * r["size"]
    sample = mixing.sample(d)
    assert sample.columns == d.columns and sample.schema == d.schema
    n = sample.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(n / d.select(F.sum(mixing.n_words(F.col("text")))).first()[0] - 1.5) < 0.1


def test_better_documents_are_drawn_first(spark):
    d = spark.createDataFrame(
        [(i, "word " * 10 + ("#### " * 10 if i % 2 else "more " * 10), "s") for i in range(600)] + [(9999, "y " * 40_000, "t")],
        "doc_id long, text string, source string"
    )
    got = mixing.mix(d, weights=(1,), fraction=0.15).where("source = 's'").collect()
    good, bad = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert good > 1.15 * bad


def test_a_source_of_low_quality_is_dealt_into_many_ranges(spark):
    d = spark.createDataFrame(
        [(i, "#### " * 5 + f"{i} {i}", "s") for i in range(4000)] + [(9999, "y " * 40_000, "t")],
        "doc_id long, text string, source string"
    )
    rows = mixing._told(d, 6)
    most = rows.where("source = 's'").groupBy(F.floor(F.log2("_key") * mixing.BINS)).count().agg(F.max("count")).first()[0]
    assert rows.agg(F.min(mixing.text_quality(F.col("text")))).first()[0] < 0.2 and most < 15
    taken = mixing.mix(d, weights=(1,), fraction=0.15).where("source = 's'").agg(F.sum("taken"), F.first("target")).first()
    assert abs(taken[0] - taken[1]) <= 1


def test_many_sources_share_as_by_rounds(spark):
    rng = random.Random(5)
    rows = [
        (
            i, "w " * rng.choice([0, 1, 3, 40, 900]),
            rng.choice([None, *(chr(97 + k) + "é" * (k % 3) for k in range(25))])
        ) for i in range(300)
    ]
    size, by, goal = brute_mix(rows)
    got = {
        r.source: r.target for r in mixing.mix(
            spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
        ).collect()
    }
    assert set(got) == set(by) and all(abs(got[s] - goal[s]) < 1e-6 for s in by)


def test_sample_keeps_columns_of_any_name(spark):
    names = ["epochs", "target", "taken", "source_size", "budget", "_size", "_key", "_row", "_s", "cut_key", "a.b"]
    d = spark.createDataFrame(
        [(i, "word " * 20, "s", *[i] * len(names)) for i in range(50)],
        f"doc_id long, text string, source string, {', '.join(f'`{n}` int' for n in names)}"
    )
    got = mixing.sample(d).collect()
    assert mixing.sample(d).columns == d.columns and len(got) == 75 and all(set(r[3:]) == {r.doc_id} for r in got)


def test_rows_are_numbered_in_order(spark):
    from lumenspan.llm import runtime

    rng = random.Random(2)
    values = [rng.choice([None, *range(50)]) for _ in range(2000)]
    got = runtime.numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), F.col("v").asc_nulls_last()).collect()
    assert sorted(r._n for r in got) == list(range(2000))
    assert [r.v for r in sorted(got, key=lambda r: r._n)] == sorted(values, key=lambda v: (v is None, v))
    assert runtime.numbered(spark.createDataFrame([], "v int"), F.col("v")).count() == 0


# ---- fingerprints


def test_fingerprints_of_edited_texts(spark, odd, none):
    for df in (
        odd.where("doc_id <> 8 OR doc_id IS NULL").unionByName(odd.where("doc_id = 8").limit(1)),
        spark.read.parquet(f"{SF}/documents.parquet")
    ):
        docs = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
        got = {r.doc_id: r for r in fingerprint.edited_by_next(df.repartition(5)).collect()}
        assert len(got) == len(docs)
        for (d, t), (e, nxt) in zip(docs, docs[1:] + docs[:1]):
            edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            a, b, c = fingerprint.sketches([t, edited, nxt])
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.written(a), fingerprint.written(b))
            assert r.near_edited == fingerprint.likeness(a, b) and r.near_next == fingerprint.likeness(a, c) and got[e].fingerprint == fingerprint.written(c)
    assert fingerprint.edited_by_next(none).count() == 0
    one = fingerprint.edited_by_next(odd.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_is_that_of_the_shingle_sets(spark, odd):
    """Against sets of words, by nothing of the operator's own: exact where all shingles are kept, within four deviations else."""
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    exact = 0
    for df in (odd.where("doc_id <> 8").select("doc_id", "text"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")):
        docs = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: -x[0])
        got = {r.doc_id: r for r in fingerprint.edited_by_next(df.repartition(3)).collect()}
        for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
            own, new, nex = (shingle_set(x) for x in (t, t[: len(t) - len(t) // 3] + nxt[: len(t) // 3], nxt))
            kept = (len(got[d].fingerprint) - 13) // 12
            assert min(len(own), 48) <= kept <= len(own) and (kept == len(own) or kept < 48 + len(own) / 8)
            for near, true, other in ((got[d].near_edited, jaccard(own, new), new), (got[d].near_next, jaccard(own, nex), nex)):
                n = max(min(len(own | other), 48), len(own | other) // 16)
                if max(len(own), len(other)) <= 48:
                    exact += 1
                    assert abs(near - true) < 1e-12
                else:
                    assert abs(near - true) <= 4 * (true * (1 - true) / n) ** 0.5 + 3 / n, (d, near, true, n)
    assert exact > 20


def test_sketches_estimate_merge_and_contain():
    rng = random.Random(5)
    a, b = sentence(rng, 9000), sentence(rng, 2000)
    both = a + " " + b
    x, y, z = fingerprint.sketches([a, b, both])
    assert abs(fingerprint.containment(y, z) - 1) < 0.02 and abs(fingerprint.likeness(x, z) - 9000 / 11000) < 0.05
    m = fingerprint.merge(x, y)
    assert fingerprint.likeness(m, z) > 0.98
    assert fingerprint.written(fingerprint.read(fingerprint.written(z))) == fingerprint.written(z)
    small = fingerprint.sketches([sentence(rng, 30), ""])
    assert len(small[0][1]) == 26 and fingerprint.likeness(small[1], small[1]) == 1.0 and fingerprint.likeness(small[0], small[1]) == 0.0


def test_equal_texts_have_equal_fingerprints(spark, odd):
    by = collections.defaultdict(set)
    for r in odd.select("doc_id", "text").join(fingerprint.fingerprints(odd), "doc_id").collect():
        by[r.text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nx</p>" + "é" * 600
    rows = [
        (1, "http://www.B.example/x?b=1&a=2#f", big), (2, "https://b.example/x", "short"), (3, None, big),
        (4, "http://a.example:8080/", None), (5, "u\r\nv", ""), (6, "http://b.example/x?a=2&b=1", big),
        (None, "http://c.example/", big), (7, "x", "short"), (8, "http://l.example/", "z" * 2_000_000)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.history(df.repartition(3), str(tmp_path / "w")).collect()
    by = {r.page_id: r for r in got}
    for i, u, h in rows:
        raw = (h or "").encode()
        same = [p for p, _, x in rows if p is not None and (x or "").encode() == raw]
        lead = max(same) if len(raw) >= 1000 else i
        r = by[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if i == lead else ("revisit", lead))
        assert r.url == (None if u is None else u.replace("\r\n", ""))
    keys = [(r.url_key.encode(), r.stamp) for r in got]
    assert keys == sorted(keys) and by[1].url_key == by[6].url_key == "example,b)/x?a=2&b=1"
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    assert data.count(b"WARC-Type: revisit") == 3 and data.endswith(b"\r\n\r\n")
    assert warc.history(df.limit(0), str(tmp_path / "e")).count() == 0


def test_archives_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Payloads with separators at their ends and inside, long ones, and a merge of many ranges."""
    rng = random.Random(3)
    ends = ["\r\n\r\n", "\r\n", "\r\r\n\r\n", "\r\n\r", "\n\r\n\r\n\r\n", "x"]
    rows = [
        (
            i, f"http://h{rng.randrange(9)}.example/{rng.randrange(5)}",
            rng.choice(ends) + "\r\n\r\n".join(sentence(rng, rng.randrange(40)) for _ in range(rng.randrange(5))) + rng.choice(ends)
        ) for i in range(400)
    ] + [(999, None, "é\r\n\r\n" * 300_000)]
    rows += [(i, "http://hot.example/", "") for i in range(1000, 1200)] + [(5000, "http://hot.example/", "same")] * 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "RANGE_ROWS", 64)
    warc.write(df.repartition(5), str(tmp_path / "w"))
    captures = warc.runs(spark, str(tmp_path / "w"))
    got = warc.merge(captures).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows
    )
    keys = [(r.url_key.encode(), r.stamp, r.page_id) for r in got]
    assert keys == sorted(keys) and warc.merge(captures).rdd.getNumPartitions() >= 9
    for p in (tmp_path / "w").glob("*.gz"):  # offsets and lengths are those of the archive
        data = gzip.open(p).read()
        for r in got:
            if r.run.endswith(p.name):
                assert data[r.offset :].startswith(b"WARC/1.1\r\n") and data[r.offset + r.length : r.offset + r.length + 4] == b"\r\n\r\n"


def test_damaged_archives_are_refused():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(h, b, at, n) for h, b, at, n in warc.parsed(io.BytesIO(record * 2))] == [
        ({"content-length": "3"}, b"abc", 0, len(record) - 4),
        ({"content-length": "3"}, b"abc", len(record), len(record) - 4)
    ]
    for bad in (record[:-6], record[1:], record + b"x"):
        with pytest.raises(ValueError):
            list(warc.parsed(io.BytesIO(bad)))
    assert io.BufferedReader(warc.Stream(iter([record[:5], b"", record[5:], record])), 7).read() == record * 2


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(k)]
    got = list(warc.LoserTree([iter([(x, (x, i)) for x in r]) for i, r in enumerate(runs)]))
    assert got == sorted((x, i) for i, r in enumerate(runs) for x in r)


# ---- near-duplicates


def brute_components(docs):
    s = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(s[a] & s[b])
            if s[a] and s[b] and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def test_groups_of_near_copies(spark):
    rng = random.Random(9)
    docs, n = [], 0
    for g in range(4):
        base = sentence(rng, 120).split()
        for _ in range(50):
            w = base[:]
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            docs.append((n, " ".join(w).upper() if n % 2 else " ".join(w)))
            n += 1
    docs += [(n + i, t) for i, t in enumerate(["", None, "  ", "one", "One", "a b c d", "a b c d e", *[docs[3][1]] * 20, *(sentence(rng, 40) for _ in range(30))])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    for hot in (minhash.HOT, 4):  # the latter shares out every bucket that one of the drawn classes is in
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, hot=hot).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert {
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (6, 29_997, 5, False),
        (None, 2, None, True), (7, 1, 7, True), (8, 2, 8, True)
    } <= got
    assert minhash.near_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(odd, percent=50)


def agree(a, b):
    return (a[:, None] == b[None]).sum(axis=2)


def parts_of(n, a, b):
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def families(rng, n, spread):
    """Sketches of a few families, their members between them, and some that resemble none."""
    base = rng.integers(0, 16, (3, 64)).astype(np.uint8)
    base = np.concatenate([base, np.where(np.arange(64) < 34, base[0], base[1])[None]])
    of = rng.integers(0, len(base) + 1, n)
    out = np.where(rng.random((n, 64)) < rng.choice(spread, n)[:, None], rng.integers(0, 16, (n, 64)), base[np.minimum(of, len(base) - 1)])
    return np.where((of == len(base))[:, None], rng.integers(0, 16, (n, 64)), out).astype(np.uint8)


@pytest.mark.parametrize("n, hubs", [(2, 64), (3, 64), (40, 64), (40, 1), (700, 64), (700, 2), (700, 0)])
def test_buckets_connect_all_that_agree(monkeypatch, n, hubs):
    monkeypatch.setattr(minhash, "HUBS", hubs)
    for seed in range(4):
        rng = np.random.default_rng(seed)
        sketch = families(rng, n, [0, 0.1, 0.3, 0.45])
        assert (minhash._agreeing(minhash._packed(sketch), minhash._packed(sketch)) == agree(sketch, sketch)).all()
        pairs, part = minhash._bucket(np.arange(n) * 3 + 5, sketch)
        a, b = (np.concatenate([p[i] for p in pairs]) // 3 - 1 for i in (0, 1))
        root = parts_of(n, a, b)
        x, y = np.nonzero(agree(sketch, sketch) >= minhash.LOW)
        assert (root[x] == root[y]).all() and len(a) <= 8 * n
        assert len({*zip(root.tolist(), part.tolist())}) == len(set(root.tolist())) == len(set(part.tolist()))


@pytest.mark.parametrize("left", [4096, 16])
def test_shares_of_a_hot_bucket_connect_all_that_agree(spark, monkeypatch, left):
    """One bucket in shares of about 60: what agrees is connected, as it would be in one piece."""
    monkeypatch.setattr(minhash, "LEFT", left)
    rng = np.random.default_rng(7)
    n = 1500
    sketch = families(rng, n, [0.1, 0.3, 0.42])
    bands = np.unique(minhash.BANDS[0])
    sketch[:, bands] = 3
    sig = sketch.astype(np.uint32) | (rng.integers(0, 1 << 28, sketch.shape).astype(np.uint32) << 4)
    sig[:, bands] = 3
    df = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in enumerate(sig)], "rid long, sig binary")
    pairs = minhash._candidates(df, 60, n).collect()
    a, b = (np.array([p[i] for p in pairs]) for i in (0, 1))
    root = parts_of(n, a, b)
    x, y = np.nonzero(agree(sketch, sketch) >= minhash.LOW)
    assert (root[x] == root[y]).all() and len(a) < 32 * n


def test_ids_with_several_texts_are_documents_each(spark):
    rng = random.Random(3)
    one, two, three = (sentence(rng, 60) for _ in range(3))
    rows = [
        (1, one), (7, one), (7, two), (7, two), (9, two + " more"), (7, three), (12, three), (20, one + " or so"),
        (7, None)
    ] + [(30, one)] * 40
    got = collections.Counter(
        (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    )
    want = [
        (1, 56, 1, True), (7, 56, 1, False), (7, 56, 7, True), (7, 56, 7, True), (9, 57, 7, False), (7, 56, 7, True),
        (12, 56, 7, False), (20, 58, 1, False), (7, 0, 7, True)
    ] + [(30, 56, 1, False)] * 40
    assert got == collections.Counter(want)


def test_near_duplicates_write_few_files(spark, monkeypatch):
    """A file costs a task the start of processes: their number follows what tables hold, not partitions of the input or of shuffles."""
    rng = random.Random(11)
    base = [sentence(rng, 80) for _ in range(30)]
    docs = [(i, base[i % 30] + " " + sentence(rng, i % 7)) for i in range(150)]
    files = []

    def counted(*args, f=runtime.materialize, **more):
        out = f(*args, **more)
        files.append(sum(x.startswith("part-") for x in os.listdir(out._written.removeprefix("file:"))))
        return out

    for module in (minhash, components):
        monkeypatch.setattr(module, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(40))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == brute_components(docs)
    assert len(files) > 5 and max(files) <= runtime.FILES and sorted(files)[-2] <= runtime.FEW


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [
        (rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)
    ] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
KEY = "AKIA" + "Q7" * 8


def base_spans(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_base_findings_of_all_texts(spark, odd):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        text = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            text[r.doc_id].append(r.text or "")
        for r in secret_scan.digest(secret_scan.scan(df)).collect():
            own = base_spans(text[r.doc_id][0])
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x[0] for x in own) for k in secret_scan.KINDS]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
            assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(r.spans.split(",") if r.spans else [])


def test_neighbours_in_a_batch_hide_no_secret():
    for one in ("see the code", "deadbeef", "xQ7/", None, ""):
        texts = pa.array([one, "deadbeefdeadbeef00 is it", "", one, f"{B64(f'the key is {KEY} ok')} is it", one], pa.string())
        assert secret_scan.batch_findings(texts) == [secret_scan.scan_text(t or "") for t in texts.to_pylist()]


B64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        KEY.replace("A", "%41"), "".join(f"\\u{ord(c):04x}" for c in KEY), "".join(f"\\x{ord(c):02x}" for c in KEY), B64(f"the key is {KEY} ok"), B64(gzip.compress(f"key {KEY}".encode())),
        B64(zlib.compress(f"key {KEY}".encode())), B64(B64(f"x {KEY}")), B64("".join(f"%{ord(c):02X}" for c in KEY)), B64(gzip.compress(B64(f"nested {KEY} here").encode())), "".join(f"%{ord(c):02x}" for c in B64(f"the key {KEY}")),
    ],
)
def test_layers_are_unwrapped(hidden):
    text = f"é before {hidden} after"
    found = [f for f in secret_scan.scan_text(text) if f[0] == "access"]
    assert found and all(f[3] > 0 and 9 <= f[1] < f[2] <= 9 + len(hidden) for f in found)
    assert KEY not in secret_scan.redacted(text, secret_scan.scan_text(text)) and secret_scan.redacted(text, secret_scan.scan_text(text)).startswith("é before ")


def test_spans_of_escapes_are_exact():
    text = f"x %41{KEY[1:]} y"
    assert [f[:3] for f in secret_scan.scan_text(text) if f[3]] == [("access", 2, 2 + len(KEY) + 2)]
    assert [f[:3] for f in secret_scan.scan_text("token%20%3D%20abcdefghijklmnop")] == [("assign", 0, 30)]


def test_ties_failures_and_endless_layers():
    assert [f[:3] for f in secret_scan.scan_text("token = short token=abcdefghijkl")] == [("assign", 14, 32)]
    assert secret_scan.search("ſecret=abcdefghijklmnop") == []
    assert [f[0] for f in secret_scan.scan_text("secret=0123456789abcdef0123")] == ["assign", "hex"]
    assert secret_scan.scan_text("%25" * 2000) == [] and secret_scan.scan_text(B64("A" * 30) * 50) == []
    deep = KEY
    for _ in range(12):
        deep = B64(f"pad {deep} pad")
    assert [f[0] for f in secret_scan.scan_text(deep)].count("access") == 1


def test_equal_layers_at_other_places_are_opened():
    inner = B64(f"the key is {KEY} ok")
    for parts in (
        [B64(f"first {inner}"), B64(f"second {inner}")], [inner, B64(f"again {inner}")],
        [inner, "x%20" + "".join(f"%{ord(c):02x}" for c in inner)]
    ):
        text = "\n".join(parts)
        spans = [f[1:3] for f in secret_scan.scan_text(text) if f[0] == "access"]
        at = 0
        for p in parts:
            assert any(at <= a < b <= at + len(p) for a, b in spans)
            at += len(p) + 1


def test_layers_that_are_wrapped_unclean_or_in_parts(monkeypatch):
    wrap = lambda x, n, end="\n": end.join(B64(x)[i : i + n] for i in range(0, len(B64(x)), n))
    rng = random.Random(3)
    pad = sentence(rng, 60)
    raw = f"{pad} key {KEY} {pad}".encode()
    hidden = [
        wrap(f(raw), n, end) for f in (gzip.compress, zlib.compress, lambda x: x) for n,
        end in ((64, "\n"), (76, "\r\n"), (64, "\n  "))
    ]
    hidden += [
        wrap(f"{pad[:45]} {KEY} {pad}", 64), B64(f"\ufeffno\u00a0break {KEY} ok"),
        B64(b"one bad \xff byte " + KEY.encode() + b" ok")
    ]
    hidden += [B64(f(b"first") + f(KEY.encode())) for f in (gzip.compress, bz2.compress, lzma.compress)]
    large = B64(gzip.compress(b"x " * 40_000 + KEY.encode() + b" y" * 40_000))
    for h in [*hidden, large]:
        if h is large:
            monkeypatch.setattr(secret_scan, "PIECE", 1 << 15)
            monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
        text = f"see: {h}\nend of it"
        assert any(f[0] == "access" and f[3] and 5 <= f[1] < f[2] <= 5 + len(h) for f in secret_scan.scan_text(text)), h
    assert [
        text[a:b] for text in (f"{B64(b'bad ' + bytes([255]) + b' ' + KEY.encode())} z",) for k, a, b,
        *_ in secret_scan.scan_text(text)
    ] == [B64(b"bad \xff " + KEY.encode())[8:].rstrip("=")]


@pytest.mark.parametrize("depth", [1, 5, 17, 40, 90])
def test_spans_through_many_layers(depth):
    hidden = "".join("%" + "25" * (depth - 1) + f"{ord(c):02x}" for c in KEY)
    text = f"é🎉 a%20{hidden} z"
    spans = [f[1:3] for f in secret_scan.scan_text(text) if f[0] == "access"]
    assert (7, 7 + len(hidden)) in spans and len(set(spans)) == 1
    wrapped = base64.b64encode(f"ä {hidden} ä".encode()).decode()
    (a, b), = {f[1:3] for f in secret_scan.scan_text(f"🎉🎉 {wrapped}\n") if f[0] == "access"}
    n = len(wrapped.rstrip("="))
    assert 3 < a <= 3 + 3 * 4 // 3 + 1 and 3 + n - 7 < b <= 3 + n


def test_escapes_of_escapes_take_linear_time():
    import time

    began = time.process_time()
    found = secret_scan.scan_text("%" + "25" * 50_000 + f"41{KEY[1:]}")
    assert time.process_time() - began < 20 and any(f[0] == "access" for f in found)


def test_a_large_layer_takes_little_memory():
    """48 MB behind 65 KB, in a process of its own."""
    import subprocess
    import sys

    code = (
        "import base64, gzip, io, resource; from lumenspan.llm import secret_scan as s\n"
        "out = io.BytesIO(); z = gzip.GzipFile(fileobj=out, mode='wb')\n"
        f"for i in range(48): z.write(b'x ' * (1 << 19))\n"
        f"z.write(b'{KEY} end'); z.close()\n"
        "text = 'see ' + base64.b64encode(out.getvalue()).decode()\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10\n"
        "before = peak(); found = s.scan_text(text); print(len(text), sum(f[0] == 'access' for f in found), peak() - before)"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True,
        cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    )
    n, found, grown = map(int, done.stdout.split())
    assert n < 70_000 and found == 1 and grown < 200


def test_redaction_keeps_columns(spark, odd, none):
    df = odd.withColumn("text", F.when(F.col("doc_id") == 2, F.lit(f"my {KEY} x")).otherwise(F.col("text")))
    got = secret_scan.redact(df)
    assert got.schema == df.schema and got.count() == df.count() and secret_scan.redact(none).count() == 0
    assert got.where("doc_id = 2").first().text == "my [secret] x"
    assert got.where("doc_id = 5").first().text == df.where("doc_id = 5").first().text and got.where("doc_id = 1").first().text is None


# ---- queries, SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rel = c.sql(queries.SQL[name])
    assert names == sorted(rel.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(
        map(str, (tuple(dict(zip(rel.columns, r))[n] for n in names) for r in rel.fetchall()))
    )


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_rows = spark.createDataFrame(
        [
            (10_001, None, None, "src1", None), (10_002, "12 34", "en", None, 5),
            (10_003, f"hello token={KEY} x", None, "src1", 9), (10_003, f"hello token={KEY} x", None, "src1", 9)
        ],
        docs.schema
    )
    docs = docs.union(odd_rows)
    kept = [docs]
    for _, stage in pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).persist())
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert set(ids[0]) - set(ids[1]) == {10_001, 10_002}
    want = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in kept[1].collect()]).items() if d == c}
    assert sorted(ids[2]) == sorted(want)
    assert sorted(ids[3]) == sorted(ids[2]) and not any(base_spans(r.text or "") for r in kept[3].collect())
    assert all(
        k.columns == docs.columns for k in kept[1:5]
    ) and set(ids[4]) <= set(ids[3]) and max(collections.Counter(ids[4]).values()) <= 2
    check_packing([r for r in packing.pack(kept[4], WORDS).collect()], [(r.doc_id, r.text) for r in kept[4].collect()])
    assert sum(r.length for r in kept[5].collect()) == sum(r.doc_tokens for r in kept[5].collect() if r.start == 0)
    for k in kept[1:]:
        k.unpersist()


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Rows that share an id: different texts stay, near copies and repeated rows leave one, whatever their other columns say."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    one, two = sentence(rng, 80), sentence(rng, 80)
    rows = [(7, one, "en", "s", 1), (7, one, "en", "s", 1), (7, one, "de", "t", 1), (7, one + " more", "en", "s", 1), (7, two, "en", "s", 1), (9, two, "en", "s", 1)]
    rows += [(11, None, "en", "s", 0), (11, None, "en", "s", 0), (None, two, "en", "s", 1), (None, two, "en", "s", 1)]
    got = dict(pipeline.STAGES)["near-duplicates"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id, r.text is None, r.text == two) for r in got if r.doc_id) == [(7, False, False), (7, False, True), (11, True, False)]
    assert sum(r.doc_id is None for r in got) == 2 and set(map(tuple, got)) <= set(rows)


def test_pipeline_of_nothing(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        d = stage(spark, d, SF)
        assert d.count() == 0


def test_tables_can_be_released(spark):
    from lumenspan.llm import runtime

    assert runtime.materialize(spark.range(3)).count() == 3
    assert runtime.release(spark) >= 1 and runtime.release(spark) == 0
    kept = runtime.finished(spark, lambda: runtime.materialize(spark.range(5)).where("id > 1"))
    assert kept.count() == 3 and runtime._made == [kept._written]
    runtime.discard(kept, kept, spark.range(1))
    assert runtime._made == [] and not os.path.exists(kept._written.removeprefix("file:"))


def test_batches_are_made_small_only_if_larger(spark):
    from lumenspan.llm import runtime

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, want in (("64m", str(runtime.BATCH_BYTES)), ("1m", "1m")):
        spark.conf.set(key, given)
        runtime.small_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.unset(key)
