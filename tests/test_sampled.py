"""Preservation over drawn queries, against sums over all pairs."""

import numpy as np
import pytest

from lumenspan.functions import scores as S
from lumenspan.operators import dense, utility
from lumenspan.operators.profiles import Profile

P = [Profile("d2", 2), Profile("d3", 3), Profile("full", 6)]
RNG = np.random.default_rng(5)
DOCS = {f"{i:03d}": RNG.normal(size=6).tolist() for i in range(41)} | {"900": None, "901": [0.0] * 6}
DOCS["010"] = DOCS["011"] = DOCS["012"]
QUERIES = {f"q{i}": RNG.normal(size=6).tolist() for i in range(9)} | {"none": None}
CHUNK = 7


def one(metric, s, r, negative=(0.0, 0.0)):
    relative = lambda a, b: 1 - abs(a - b) / max(abs(a), 1e-6)
    m = relative(s - negative[0], r - negative[1])
    d = abs(s - r)
    return {
        S.METRICS[0]: relative(s, r), S.METRICS[1]: 1 / (1 + d), S.METRICS[2]: 1 / (1 + d * d), S.METRICS[3]: m,
        S.METRICS[4]: 0.7 * relative(s, r) + 0.3 * m
    }[metric]


def score(q, v, m, similarity):
    a, b = np.array(q[:m]), np.array(v[:m])
    return float(a @ b) / (1.0 if similarity == "dot" else max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12))


def brute(metric, similarity):
    names, out = sorted(DOCS), {}
    chunks = {x: [y for y in names if names.index(y) // CHUNK == i // CHUNK] for i, x in enumerate(names)}
    for x in names:
        for p in P:
            values = []
            for q in QUERIES.values():
                if metric in S.MARGIN_METRICS and len(chunks[x]) == 1:
                    values.append(1.0)
                elif q and DOCS[x]:
                    others = [y for y in chunks[x] if y != x and DOCS[y]]
                    mean = lambda m: float(np.mean(sorted((score(q, DOCS[y], m, similarity) for y in others), reverse=True)[:4]))  # noqa: E731, B023
                    negative = (mean(6), mean(p.dimension)) if metric in S.MARGIN_METRICS else (0.0, 0.0)
                    values.append(one(metric, score(q, DOCS[x], 6, similarity), score(q, DOCS[x], p.dimension, similarity), negative))
            out[x, p.name] = min(max(float(np.mean(values)), 0.0), 1.0) if values else 0.0
    return out


def tables(spark):
    return (
        spark.createDataFrame(list(DOCS.items()), "docno string, v array<double>"),
        spark.createDataFrame(list(QUERIES.items()), "qid string, qvec array<double>")
    )


def agrees(spark, metric, similarity="dot"):
    docs, queries = tables(spark)
    got = utility.sampled_quality(docs, queries, P, metric, similarity, n=len(QUERIES), chunk=CHUNK).collect()
    want = brute(metric, similarity)
    assert len(got) == len(want)
    assert all(abs(r["profile_quality"] - want[r["docno"], r["profile"]]) < 1e-9 for r in got)


@pytest.mark.parametrize("similarity", ["dot", "cosine"])
@pytest.mark.parametrize("metric", S.METRICS[:3])
def test_sampled_quality_agrees_with_all_pairs(spark, metric, similarity):
    agrees(spark, metric, similarity)


def test_sampled_quality_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 200)
    monkeypatch.setattr(dense, "SHARD_BYTES", 500)
    agrees(spark, S.METRICS[1])


def test_sampled_quality_draws_and_may_have_nothing_to_draw(spark):
    docs, queries = tables(spark)
    some = queries.where("qid <> 'none'")
    a = utility.sampled_quality(docs, some, P, n=3).collect()
    assert sorted(a) == sorted(utility.sampled_quality(docs, some, P, n=3).collect()) and len(a) == 3 * len(DOCS)
    assert utility.sampled_quality(docs, queries.limit(0), P).count() == 0
    with pytest.raises(ValueError):
        utility.sampled_quality(docs, queries, P, "no metric")


def pairs_listed(df) -> bool:
    return "NestedLoopJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_sampled_quality_lists_no_pairs(spark):
    docs, queries = tables(spark)
    assert not pairs_listed(utility.sampled_quality(docs, queries, P, S.METRICS[1], n=99))


@pytest.mark.parametrize("similarity", ["dot", "cosine"])
@pytest.mark.parametrize("metric", S.MARGIN_METRICS)
def test_sampled_margins_agree_with_all_pairs(spark, metric, similarity):
    agrees(spark, metric, similarity)


def test_sampled_margins_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 200)
    monkeypatch.setattr(dense, "SHARD_BYTES", 500)
    agrees(spark, S.METRICS[3])


def test_sampled_margins_list_no_pairs(spark):
    docs, queries = tables(spark)
    assert not pairs_listed(utility.sampled_quality(docs, queries, P, S.METRICS[3], n=99, chunk=CHUNK))
