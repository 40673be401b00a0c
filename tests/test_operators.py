import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.functions import scores as S
from lumenspan.functions import text as X
from lumenspan.functions import vectors as V
from lumenspan.operators import bm25, dense, encoding, evaluation, relevance, routing, training, utility
from lumenspan.operators.profiles import Profile
from lumenspan.sources import config, sinks, tables
from lumenspan.streaming import online

P = [Profile("d2", 2), Profile("full", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 0.0, 3.0, 4.0]), ("c", [0.0, 0.0, 0.0, 0.0]), ("d", [1.0, 0.0, 0.0, 0.0])],
        "docno string, v array<float>"
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("1", [1.0, 0.0, 1.0, 0.0]), ("2", [0.0, 1.0, 0.0, 1.0])], "qid string, qvec array<float>")


def test_residual_utility_guards(spark, docs):
    got = {(r["docno"], r["profile"]): r["utility"] for r in utility.residual(docs, P).collect()}
    assert got == {
        ("a", "d2"): 1.0, ("a", "full"): 1.0, ("b", "d2"): 0.0, ("b", "full"): 1.0, ("c", "d2"): 1.0,
        ("c", "full"): 1.0, ("d", "d2"): 1.0, ("d", "full"): 1.0
    }


def test_residual_utility_grows_with_the_prefix(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(str(i), [float(x) for x in rng.normal(size=16)]) for i in range(20)], "docno string, v array<double>")
    u = d.select(*(V.residual_utility("v", m).alias(f"m{m}") for m in (1, 2, 5, 9, 16))).collect()
    assert all(list(r) == sorted(r) for r in u)


def test_search_breaks_ties_by_docno_and_agrees_with_pairs(spark, docs, queries):
    full = dense.materialize(docs, dense.uniform(docs, P[1]))
    got = [tuple(r) for r in dense.search(queries, full, 3).orderBy("qid", "rank").collect()]
    assert [x[1] for x in got if x[0] == "1"] == ["b", "a", "d"]
    pairs = {
        (r["qid"], r["docno"]): r["full_score"] for r in dense.pair_scores(
            queries.select("qid").join(F.broadcast(docs.select("docno"))), queries, docs, P[1:]
        ).collect()
    }
    assert all(abs(pairs[q, d] - s) < 1e-9 for q, d, s, _ in got)


def test_blocks_and_shards_change_nothing(spark, docs, queries, monkeypatch):
    full = dense.cut(docs, P[1].dimension)
    a = sorted(map(tuple, dense.search(queries, full, 2).collect()))
    for bytes_ in (8, 40):
        for name in ("BLOCK_BYTES", "SHARD_BYTES", "SCORE_BYTES"):
            monkeypatch.setattr(dense, name, bytes_)
        assert sorted(map(tuple, dense.search(queries, full, 2).collect())) == a


@pytest.mark.parametrize("similarity", ["dot", "cosine"])
@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, monkeypatch, similarity, small):
    """Against all products: ties, equal vectors, own vectors, several widths in one pass, a corpus of mixed widths."""
    if small:
        for name in ("BLOCK_BYTES", "SHARD_BYTES", "SCORE_BYTES"):
            monkeypatch.setattr(dense, name, 2048)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 8)).astype(float)
    v[50:80] = v[50]
    v[90:] = np.where(rng.random((210, 8)) < 0.5, rng.normal(size=(210, 8)), v[90:])
    ids = [f"d{i}" for i in rng.permutation(300)]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "docno string, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids[:60], v[:60])], "qid string, qvec array<double>")

    def brute(widths):
        out = set()
        for i in range(60):
            own = []
            for j in range(300):
                if i != j:
                    a, b = v[i, : widths[j]], v[j, : widths[j]]
                    s = a @ b / (1 if similarity == "dot" else max(np.linalg.norm(a), 1e-12) * max(np.linalg.norm(b), 1e-12))
                    own.append((-round(s, 9), ids[j]))
            out |= {(ids[i], x, n + 1) for n, (_, x) in enumerate(sorted(own)[:7])}
        return out

    got = dense.search_widths(q, d, [3, 8], 7, similarity, skip_self=True).collect()
    for w in (3, 8):
        assert {(r.qid, r.docno, r["rank"]) for r in got if r.w == w} == brute([w] * 300)
    widths = rng.choice([2, 5, 8], 300)
    mixed = spark.createDataFrame([(i, x[:w].tolist()) for i, x, w in zip(ids, v, widths)], "docno string, vec array<double>")
    assert {(r.qid, r.docno, r["rank"]) for r in dense.search(q, mixed, 7, similarity, skip_self=True).collect()} == brute(widths)


def test_search_kinds_and_budgets(spark, docs, queries):
    full = dense.cut(docs, P[1].dimension)
    exact = sorted(map(tuple, dense.search(queries, full, 2).collect()))
    with pytest.warns(UserWarning):
        assert sorted(map(tuple, dense.search_by("hnsw", queries, full, 2).collect())) == exact
    assert sorted(map(tuple, dense.search_by("flat", queries, full, 2).collect())) == exact
    own = dense.uniform(docs, P[1])
    assert dense.check_fits(own, 10_000) is own
    with pytest.raises(MemoryError):
        dense.check_fits(own, 1)


def test_missing_vectors_are_an_error(spark, docs):
    with pytest.raises(KeyError):
        dense.materialize(docs.where("docno <> 'a'"), dense.uniform(docs, P[1]))


def test_uniform_assignment_is_the_full_run(spark, docs, queries):
    runs = dense.runs(queries, docs, P, dense.uniform(docs, P[1]), 4)
    got = {n: sorted(tuple(r)[2:] for r in runs.where(F.col("run") == n).collect()) for n in ("full_run", "optimized_run", "profile_d2_run")}
    assert got["full_run"] == got["optimized_run"] != got["profile_d2_run"]


def test_hard_negatives_leave_the_row_out(spark):
    s = spark.createDataFrame(
        [("q", "p", f"d{i}", float(x)) for i, x in enumerate([5, 4, 4, 3, 1])] + [("r", "p", "d0", 1.0)],
        "qid string, profile string, docno string, s double"
    )
    got = {(r["qid"], r["docno"]): r["s_negative"] for r in utility.hard_negatives(s, "s", 2).collect()}
    x = [5, 4, 4, 3, 1]
    for i in range(5):
        assert abs(got["q", f"d{i}"] - np.mean(sorted((v for j, v in enumerate(x) if j != i), reverse=True)[:2])) < 1e-12
    assert got["r", "d0"] is None


def test_calibration_of_single_candidates(spark):
    run = spark.createDataFrame(
        [("q", "a", 3.0, 0), ("r", "a", 2.0, 0), ("r", "b", 1.0, 1), ("r", "c", 0.0, 2)],
        "qid string, docno string, score double, rank int"
    )
    got = {(r["qid"], r["docno"]): (r["relevance_final"], r["confidence"], r["uncertainty"]) for r in relevance.calibrate(run).collect()}
    assert got == {("q", "a"): (0.0, 0.0, 1.0), ("r", "a"): (1.0, 0.5, 0.5), ("r", "b"): (0.5, 0.0, 1.0), ("r", "c"): (0.0, 0.5, 0.5)}


def test_judgements_fan_out_and_keep_unknown_labels(spark):
    run = relevance.calibrate(spark.createDataFrame([("q", "a", 3.0, 0), ("q", "b", 2.0, 1)], "qid string, docno string, score double, rank int"))
    qrels = spark.createDataFrame([("q", "a", "2"), ("q", "a", "3"), ("q", "b", "x")], "qid string, docno string, label string")
    assert sorted(r["relevance_final"] for r in relevance.judged(run, qrels).collect()) == pytest.approx([0.0, 2 / 3, 1.0])
    m = relevance.judged(run, qrels, scale="explicit_map", mapping={"3": 0.5})
    assert sorted(
        (r["docno"], r["relevance_final"], r["is_qrel_overridden"]) for r in m.collect()
    ) == [("a", 0.5, True), ("a", 1.0, True), ("b", 0.0, False)]
    with pytest.raises(ValueError):
        relevance.judged(run, qrels, label="grade")


def test_modes_of_relevance(spark):
    topics = spark.createDataFrame([("1", "red fox"), ("2", "blue: sky")], "qid string, query string")
    corpus = spark.createDataFrame([("a", "a red fox"), ("b", "red red sky"), ("c", None), ("d", "blue sky sky")], "docno string, text string")
    run = bm25.run(bm25.build(corpus), topics, 5)
    assert [r["docno"] for r in run.where("qid = '1'").orderBy("rank").collect()] == ["a", "b"]
    for mode in relevance.MODES:
        assert relevance.estimate(mode, run, topics, corpus, fraction=0.5).count() == 4
    assert bm25.build(corpus).stats().first()["n_docs"] == 4
    assert bm25.run(bm25.build(corpus), topics, 5, "TF_IDF").count() == 4


def test_routing(spark):
    t = spark.createDataFrame([("1", "x"), ("2", "y")], "qid string, query string")
    q = spark.createDataFrame([("1", "a", 1)], "qid string, docno string, label int")
    r = routing.split_by_qrels(t, q)
    assert [x["qid"] for x in r.opt_topics.collect()] == ["2"] and routing.utility_qrels(r).count() == 0
    assert routing.utility_qrels(routing.shared(t, q)).count() == 0
    assert routing.utility_qrels(routing.dual_source(t, q, t.where("qid = '2'").withColumn("qid", F.lit("9")), q)).count() == 1
    with pytest.raises(ValueError):
        routing.split_by_qrels(t.where("qid = '1'"), q)


def test_measures_by_hand(spark):
    runs = spark.createDataFrame(
        [("r", "1", "a", 3.0), ("r", "1", "b", 2.0), ("r", "1", "c", 1.0)],
        "run string, qid string, docno string, score double"
    )
    qrels = spark.createDataFrame([("1", "b", 2), ("1", "z", 1), ("2", "a", 2)], "qid string, docno string, label int")
    got = {r["qid"]: r for r in evaluation.per_query(runs, qrels).collect()}
    dcg, idcg = 2 / np.log2(3), 2 + 1 / np.log2(3)
    assert got["1"]["ndcg10"] == pytest.approx(dcg / idcg) and got["1"]["ap_rel2"] == 0.5 == got["1"]["rr_rel2"] and got["1"]["recall100"] == 0.5
    assert [got["2"][m] for m in evaluation.MEASURES] == [0.0] * 7 and got["1"]["map"] == 0.25 and got["1"]["recip_rank"] == 0.5


def test_p_values():
    assert evaluation.p_value(2.0, 11) == pytest.approx(0.07338803477074, abs=1e-10)
    assert evaluation.p_value(12.706204736, 2) == pytest.approx(0.05, abs=1e-8)
    assert evaluation.p_value(None, 5) is None


def test_text_functions(spark):
    d = spark.createDataFrame([(" \t", "b \n", None), ("a ", None, "c:d")], "x string, y string, z string")
    got = d.select(X.compose_text("x", "y", "z").alias("t"), X.sanitize_query(F.col("z")).alias("q")).collect()
    assert [r["t"] for r in got][1] == "a \nc:d" and [r["q"] for r in got] == [None, "c d"]


def test_training_data(spark):
    n = spark.createDataFrame(
        [("q", [("p1",), ("p2",)], [("n1",), ("n2",), ("n3",)]), ("r", [("p",)], [])],
        "query string, positive_passages array<struct<text string>>, negative_passages array<struct<text string>>"
    )
    t = training.nested(n)
    assert t.count() == 6 and training.nested(n, negatives=None).count() == 3
    with pytest.raises(ValueError):
        training.validated(t.union(t.selectExpr("anchor", "' \t'", "negative")))
    rows = spark.createDataFrame([(3, "a", None), (1, "x", "y"), (2, "b", " ")], "n int, anchor string, positive string")
    with pytest.raises(ValueError, match="the first in positive of n 2"):
        training.validated(rows, "n")
    assert training.validated(rows.where("n = 1"), "n").count() == 1


def test_files_and_streams(spark, tmp_path, docs):
    (tmp_path / "t.tsv").write_text("qid\tquery\n2\tb\n1\ta\n")
    (tmp_path / "q.tsv").write_text("qid\tdocno\tlabel\n1\ta\t2\n1\tb\tx\n9\ta\t1\n")
    t = tables.topics(spark, str(tmp_path / "t.tsv"), max_queries=1)
    assert [tuple(r) for r in t.collect()] == [("1", "a")]
    assert tables.qrels(spark, str(tmp_path / "q.tsv"), of=t).count() == 1 and tables.qrels(spark, None).count() == 0
    (tmp_path / "s.json").write_text(
        '{"global_step": 2, "log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "loss": "nan?", "epoch": 1.0}]}'
    )
    assert [(r["step"], r["loss"]) for r in tables.trainer_log(spark, str(tmp_path / "s.json")).collect()] == [(1.0, 0.5), (2.0, None)]
    for i, head in enumerate(("name,a", "name,b")):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "pt_experiment.csv").write_text(f"{head}\nx,1\n")
    df, errors = tables.result_files(spark, str(tmp_path))
    assert df.count() == 2 and {"a", "b", "name", "file"} <= set(df.columns) and not errors
    sinks.save(docs, str(tmp_path / "docs"), rows_per_file=1)
    q = online.start(spark, str(tmp_path / "docs"), "docno string, v array<float>", P, 0.1, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["docno"]: r["profile"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["docno"]: r["profile"] for r in online.choose(docs, P, 0.1).collect()}
    with pytest.raises(ValueError):
        tables.checked_vectors(docs.union(docs.limit(1)))
    with pytest.raises(ValueError):
        tables.checked_vectors(docs, width=5)


def test_index_is_kept_and_reused(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "x y")], "docno string, text string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        bm25.resolve(spark, path, corpus, build_if_missing=False)
    assert bm25.resolve(spark, path, corpus).terms.count() == 2
    assert bm25.resolve(spark, path, None, build_if_missing=False).terms.count() == 2


def test_vector_cache(spark, tmp_path):
    d = spark.createDataFrame([(str(i), "x y" if i else None) for i in range(20)], "docno string, text string")
    made = []
    make = lambda df: made.append(1) or encoding.encode(df, "docno", "text", encoding.HashingEncoder(8))
    for resume in ("auto", "auto", "restart"):
        assert encoding.cached(spark, str(tmp_path / "v"), "k", d, make, resume=resume, chunks=3).count() == 20
    assert len(made) == 6 and encoding.newest(spark, str(tmp_path / "v")) == "k" and encoding.newest(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        encoding.cached(spark, str(tmp_path / "v"), "other", d, make, resume="fail", chunks=3)
    (tmp_path / "v" / "k" / "chunk-0001-of-0003" / "_SUCCESS").unlink()  # as an interruption leaves it
    assert encoding.cached(spark, str(tmp_path / "v"), "k", d, make, chunks=3).count() == 20 and len(made) == 7
    assert encoding.store_name("me/vectors", "My Model/large", "", "x") == "me/vectors_my-model-large__x"
    long = encoding.store_name("v", "m" * 100)
    assert len(long) == 2 + 64 and long != encoding.store_name("v", "m" * 101) and encoding.store_name("v", "...") == "v_model"


def test_writers_leave_no_parts(spark, tmp_path, docs):
    to = tmp_path / "t.csv"
    sinks.save(docs.select("docno"), str(to), "csv")
    with pytest.raises(Exception):
        sinks.save(docs.select(F.raise_error(F.lit("no")).alias("docno")), str(to), "csv")
    assert spark.read.csv(str(to), header=True).count() == docs.count()
    sinks.save(docs.limit(0).select("docno"), str(to), "csv")
    sinks.save_json(spark, {"a": 1}, str(tmp_path / "x" / "a.json"))
    sinks.save_json(spark, {"a": 2}, str(tmp_path / "x" / "a.json"))
    assert (tmp_path / "x" / "a.json").read_text() == '{\n  "a": 2\n}' and spark.read.csv(str(to), header=True).count() == 0
    c = config.parse(RAW | {"utility": {"relevance": {"scale": {"mode": "explicit_map", "explicit_map": {"1": 0.5}}}}})
    sinks.save_config(spark, c, str(tmp_path / "c.yaml"))
    assert config.as_dict(config.load(str(tmp_path / "c.yaml"))) == config.as_dict(c)


def test_fallbacks_of_evaluation_are_told():
    c = config.parse(RAW | {"data": RAW["data"] | {"local_eval_topics_path": "e", "eval_pyterrier_dataset": "x"}})
    told = " ".join(config.fallback_warnings(c))
    assert "default qrels" in told and "qrels come from the dataset" in told and "default topics" not in told
    assert config.fallback_warnings(config.parse(RAW)) == []


def test_tail_reports(spark):
    t = utility.Tail("rbp_residual_interval")
    scored = spark.createDataFrame(
        [("a", "p", 0.1, 0.5), ("b", "p", 0.3, 1.0), ("a", "q", 0.0, 0.25)],
        "docno string, profile string, utility double, profile_quality double"
    )
    r = utility.tail_report(t, scored, 2)
    assert r["tail_profile_quality_mean_by_profile"] == {"p": 0.75, "q": 0.25} and (
        r["tail_utility_min"], r["tail_utility_max"]
    ) == (0.0, 0.3) and abs(r["tail_utility_mean"] - 0.4 / 3) < 1e-12
    for none in (utility.tail_report(t, None, 0), utility.tail_report(t, scored.limit(0), 0)):
        assert none["tail_utility_max"] == 0.0 and none["tail_profile_quality_mean_by_profile"] == {} and none["tail_expected_relevance_per_doc"] == 0.0
    with pytest.raises(ValueError):
        utility.estimator("none")


def test_scores(spark):
    f, r = F.lit(2.0), F.lit(-1.0)
    got = spark.range(1).select(
        S.relative(f, r), S.absolute(f, r), S.squared(f, r), S.unit_scale(F.lit(5.0), 0, 3), S.rank_discount(F.lit(0)),
        S.slug(F.lit(" a/b--c. "))
    ).first()
    assert list(got) == [-0.5, 0.25, 0.1, 1.0, 1.0, "a-b-c"]
    assert S.budget_bytes(None, 0.5) == 1 << 29 and S.budget_bytes(7, 0.5) == 7
    half = spark.range(1).select(V.rounded(F.array(F.lit(0.1), F.lit(0.0), F.lit(-3.14159)), "float16").alias("h")).first()["h"]
    assert half == [float(np.float16(x)) for x in (0.1, 0.0, -3.14159)]


RAW = {
    "data": {"local_topics_path": "t", "local_qrels_path": "q", "local_corpus_path": "c"},
    "profiles": [{"name": "d2", "dimension": 2}, {"name": "full", "dimension": 4}]
}


@pytest.mark.parametrize(
    "bad",
    [
        {"utility": {"metric": "x"}}, {"nothing": {}}, {"data": {"x": 1}}, {"profiles": []},
        {"optimization": {"mode": "streaming"}}, {"retrieval": {"top_k": 0}},
        {"profiles": [{"name": "full", "dimension": 2}, {"name": "d4", "dimension": 4}]}, {"data": {}},
        {"utility": {"relevance": {"scale": {"mode": "explicit_map"}}}}
    ]
)
def test_configurations_that_are_refused(bad):
    with pytest.raises(config.ConfigError):
        config.parse(RAW | bad)


def test_configuration_of_older_names():
    with pytest.warns(UserWarning):
        c = config.parse(
            RAW | {
                "data": RAW["data"] | {"candidates_per_query": 7, "candidate_source": "pyterrier_bm25"},
                "optimization": {"algorithm": "lagrangian_dual", "budget_gb": 1}
            }
        )
    assert (
        c.retrieval.candidate_k, c.retrieval.mode, c.optimization.algorithm, config.budget(c)
    ) == (7, "pyterrier_candidates", "lagrangian_relaxation", 1 << 30)


def test_approximate_search_finds_most(spark):
    from lumenspan.plans import catalog

    d = "/root/testdata/sf0.001"
    want = {(r.qid, r.docno) for r in catalog.dense_topk_dot(spark, d).collect()}
    for name, least in (("ann_ivf", 0.9), ("ann_lsh", 0.9)):
        got = {(r.qid, r.docno) for r in catalog.QUERIES[name](spark, d).collect()}
        assert len(got & want) / len(want) >= least


def test_all_cells_are_exact(spark, docs, queries):
    corpus = dense.materialize(docs, dense.uniform(docs, P[1]))
    got = sorted((r.qid, r.docno) for r in dense.ivf_search(queries, corpus, 3, cells=2, probes=2).collect())
    assert got == sorted((r.qid, r.docno) for r in dense.search(queries, corpus, 3).collect())
