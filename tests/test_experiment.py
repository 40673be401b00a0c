import pytest

from lumenspan.operators import encoding, evaluation
from lumenspan.plans.experiment import Experiment, benchmark
from lumenspan.sources import config, tables

TEXTS = ["red fox jumps", "blue sky and red sun", "green grass grows", "the fox sleeps in grass", "sun and sky", "a quick brown dog"]


@pytest.fixture
def cfg(spark, tmp_path):
    spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "docno string, text string").write.parquet(str(tmp_path / "c"))
    (tmp_path / "t.tsv").write_text("qid\tquery\n1\tred fox\n2\tblue sky\n3\tgrass\n4\tdog: brown\n")
    (tmp_path / "q.tsv").write_text("qid\tdocno\tlabel\n1\t0\t2\n2\t1\t2\n2\t4\t1\n")

    def make(**more):
        raw = {
            "data": {"local_topics_path": str(tmp_path / "t.tsv"), "local_qrels_path": str(tmp_path / "q.tsv"), "local_corpus_path": str(tmp_path / "c")},
            "profiles": [{"name": "d8", "dimension": 8}, {"name": "d16", "dimension": 16}, {"name": "full", "dimension": 32}],
            "optimization": {"budget_bytes": 6 * 40}, "retrieval": {"top_k": 5}, "execution": {"output_dir": str(tmp_path / "out")},
        }
        for k, v in more.items():
            raw[k] = raw.get(k, {}) | v
        return config.parse(raw)

    return make


def test_residual_experiment(spark, cfg, tmp_path):
    e = Experiment(spark, cfg(utility={"estimator": "residual_norm", "residual_norm": {"norm": 1}}))
    r = e.run()
    assert {x["run"] for x in r.runs.select("run").distinct().collect()} == {
        "full_run", "profile_d16_run", "profile_d8_run", "optimized_run"
    }
    assert r.report["optimization"]["total_cost_bytes"] <= 240 and r.assignments.count() == 6
    e.persist(r)
    assert spark.read.csv(f"{e.folder}/pt_experiment.csv", header=True).count() == 4 * len(evaluation.MEASURES)
    assert config.as_dict(config.load(f"{e.folder}/config_snapshot.yaml")) == config.as_dict(e.cfg)


@pytest.mark.parametrize(
    "source, tail, metric",
    [
        ("bm25", "static_default", "relative_score_dissimilarity"),
        ("hybrid_rerank", "rbp_residual_interval", "hybrid_score_margin_utility"),
        ("dense", "rbp_residual_interval", "absolute_score_utility")
    ]
)
def test_query_log_experiments(spark, cfg, source, tail, metric):
    c = cfg(
        data={
            "local_topics_path": cfg().data.local_topics_path, "local_qrels_path": cfg().data.local_qrels_path,
            "local_corpus_path": cfg().data.local_corpus_path, "single_log_policy": "split_by_qrels"
        },
        utility={"metric": metric, "relevance": {"weak_source": source, "top_k_candidates": 4}, "tail": {"mode": tail}},
        retrieval={"include_bm25_baseline": source == "bm25", "top_k": 5}
    )
    r = Experiment(spark, c).run()
    assert r.utility.count() == 18 and r.utility.where("utility IS NULL").count() == 0
    assert r.report["routing"]["opt_queries"] == 2 == r.report["routing"]["eval_queries"]


def test_candidate_retrieval_over_named_sources(spark, cfg):
    c = cfg(retrieval={"mode": "pyterrier_candidates"})
    named = tables.Catalog()
    named.register("small", "topics", lambda s: tables.topics(s, c.data.local_topics_path))
    named.register("small", "corpus", lambda s: tables.corpus(s, c.data.local_corpus_path))
    named.register("small", "qrels", lambda s: tables.qrels(s, c.data.local_qrels_path))
    own = cfg(retrieval={"mode": "pyterrier_candidates"})
    own.data.pyterrier_dataset, own.data.local_topics_path, own.data.local_corpus_path, own.data.local_qrels_path = "small", None, None, None
    a, b = Experiment(spark, c).run(), Experiment(spark, own, named).run()
    assert evaluation.by_run(a.scores) == evaluation.by_run(b.scores)
    with pytest.raises(KeyError):
        named.load(spark, "other", "topics")


def test_benchmark_matrix(spark, cfg, tmp_path):
    c = cfg()
    t, q, d = tables.topics(spark, c.data.local_topics_path), tables.qrels(spark, c.data.local_qrels_path), tables.corpus(spark, c.data.local_corpus_path)
    got = benchmark(spark, t, q, d, {"h": encoding.HashingEncoder(32)}, [8, 32])
    assert got.count() == 2 * len(evaluation.MEASURES)
    to = str(tmp_path / "b")
    for _ in range(2):  # the second time from the cache
        again = benchmark(spark, t, q, d, {"h": encoding.HashingEncoder(32)}, [8, 32], cache=f"{to}/cache", output=to)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    for name, n in (("metrics_long", 2 * len(evaluation.MEASURES)), ("metrics_wide", 2), ("ranking_summary", len(evaluation.MEASURES))):
        assert spark.read.csv(f"{to}/{name}.csv", header=True).count() == n
    assert (tmp_path / "b" / "run_metadata.json").exists() and len(list((tmp_path / "b" / "cache").iterdir())) == 2
