"""Experiments from configurations: route, encode, estimate, optimise, retrieve, evaluate, persist."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators import bm25, dense, encoding, evaluation, knapsack, relevance, reporting, routing, utility
from lumenspan.operators.profiles import Profile, check, with_profiles
from lumenspan.sources import config as C
from lumenspan.sources import sinks, tables
from lumenspan.sources.shared import kept

log = logging.getLogger("lumenspan")


@dataclass
class Result:
    assignments: DataFrame
    runs: DataFrame
    scores: DataFrame
    utility: DataFrame
    pairs: DataFrame | None = None
    score_pairs: DataFrame | None = None
    report: dict = field(default_factory=dict)


class Experiment:
    """One configuration. `vectors` (`docno`, `v`) and `encoder` may be given; by default documents and queries are encoded by hashing."""

    def __init__(
        self, spark: SparkSession, cfg: SimpleNamespace, catalog: tables.Catalog | None = None,
        encoder: encoding.Encoder | None = None, vectors: DataFrame | None = None,
        query_vectors: DataFrame | None = None, scorer: relevance.Scorer = relevance.overlap
    ):
        self.spark, self.cfg, self.catalog, self.scorer = spark, cfg, catalog or tables.Catalog(), scorer
        self.profiles: list[Profile] = C.catalogue(cfg)
        self.full = next(p for p in self.profiles if p.name == cfg.model.full_profile_name)
        self.encoder = encoder or encoding.HashingEncoder(self.full.dimension)
        self.given, self.given_queries = vectors, query_vectors
        self.encoded: dict[tuple, DataFrame] = {}
        self.tail: dict = {}
        for line in C.fallback_warnings(cfg):
            log.warning(line)
        self.folder = f"{cfg.execution.output_dir}/{cfg.execution.experiment_name}"

    # sources

    def topics(self, data: SimpleNamespace) -> DataFrame:
        if data.pyterrier_dataset and not data.local_topics_path:
            t = self.catalog.load(self.spark, data.pyterrier_dataset, "topics")
            return t.orderBy("qid").limit(data.max_queries) if data.max_queries else t
        return tables.topics(self.spark, data.local_topics_path, data.topic_column, data.max_queries)

    def qrels(self, data: SimpleNamespace, topics: DataFrame) -> DataFrame:
        if data.pyterrier_dataset and not data.local_qrels_path:
            q = self.catalog.load(self.spark, data.pyterrier_dataset, "qrels")
        else:
            q = tables.qrels(self.spark, data.local_qrels_path, data.qrels_label_column)
        return q.join(topics.select("qid"), "qid", "left_semi") if data.max_queries else q

    def corpus(self, data: SimpleNamespace) -> DataFrame:
        if data.pyterrier_dataset and not data.local_corpus_path:
            c = self.catalog.load(self.spark, data.pyterrier_dataset, "corpus")
            return c.orderBy("docno").limit(data.max_docs) if data.max_docs else c
        return tables.corpus(self.spark, data.local_corpus_path, tuple(data.text_fields), data.docno_column, data.max_docs)

    def route(self) -> routing.Routed:
        own, ev = self.cfg.data, C.evaluation(self.cfg).data
        if self.cfg.utility.estimator == "residual_norm":
            t = self.topics(ev)
            return routing.shared(t, self.qrels(ev, t))
        t = self.topics(own)
        q = self.qrels(own, t)
        if C.has_eval_overrides(self.cfg):
            et = self.topics(ev)
            return routing.dual_source(t, q, et, self.qrels(ev, et))
        return routing.split_by_qrels(t, q) if own.single_log_policy == "split_by_qrels" else routing.shared(t, q)

    # vectors

    def context(self, role: str, prompt: str, data: SimpleNamespace) -> str:
        return encoding.context(role=role, model=self.encoder.name, prompt=prompt, width=self.encoder.width, data=C.as_dict(data))

    def doc_vectors(self, corpus: DataFrame) -> DataFrame:
        """Given vectors; else those of a store that is configured and there; else made chunk by chunk, where finished chunks of
        this context stay. In this order, and checked.
        """
        check = lambda v: tables.checked_vectors(v.select("docno", "v"), self.full.dimension, corpus)
        if self.given is not None:
            return check(self.given)
        d, m, x = self.cfg.data, self.cfg.model, self.cfg.execution
        if d.hf_embeddings_repo_id and d.full_embeddings_source != "compute":
            store = encoding.store_name(
                d.hf_embeddings_repo_id, m.model_name_or_path,
                *([f"adapter-{m.adapter_type}", m.adapter_name, m.adapter_path] if m.adapter_type else [])
            )
            if encoding.finished(self.spark, store):
                return tables.vectors(self.spark, store, d.hf_embeddings_docno_column, d.hf_embeddings_vector_column, self.full.dimension, corpus)
            if d.full_embeddings_source == "hf_dataset":
                raise FileNotFoundError(f"no vectors at {store}")
        make = lambda df: encoding.encode(df, "docno", "text", self.encoder, m.document_prompt)
        if not x.embedding_checkpoint_enabled:
            return make(corpus)
        folder = x.embedding_checkpoint_dir or f"{x.output_dir}/embeddings"
        key = self.context("document", m.document_prompt, C.evaluation(self.cfg).data)
        return check(encoding.cached(self.spark, folder, key, corpus, make, "docno", x.embedding_checkpoint_resume))

    def query_vectors(self, topics: DataFrame) -> DataFrame:
        """As given, or encoded once for a set of topics and kept."""
        if self.given_queries is not None:
            return self.given_queries.join(topics.select("qid"), "qid", "left_semi").select("qid", "qvec")
        key = topics.select(F.coalesce(F.sum(F.xxhash64("qid", "query").cast("decimal(38,0)")), F.lit(0)), F.count("*")).first()
        if tuple(key) not in self.encoded:
            self.encoded[tuple(key)] = kept(encoding.encode(topics, "qid", "query", self.encoder, self.cfg.model.query_prompt).withColumnRenamed("v", "qvec"))
        return self.encoded[tuple(key)]

    # stages

    def bm25_run(self, corpus: DataFrame, topics: DataFrame, k: int, first_rank: int = 0) -> DataFrame:
        d = self.cfg.data
        index = bm25.resolve(
            self.spark, d.local_terrier_index_path, corpus,
            True if not d.local_terrier_index_path else d.build_local_terrier_index_if_missing
        )
        return bm25.run(index, topics, k, self.cfg.retrieval.terrier_wmodel, first_rank)

    def relevance(self, routed: routing.Routed, corpus: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
        r, k = self.cfg.utility.relevance, self.cfg.retrieval.candidate_k
        source = "bm25" if r.mode == "model" else r.weak_source
        lexical = lambda: relevance.head(
            self.bm25_run(corpus, routed.opt_topics, k).join(corpus.select("docno"), "docno", "left_semi"),
            r.top_k_candidates
        )
        vectors = lambda: dense.search(
            queries, docs.select("docno", F.col("v").alias("vec")), min(k, r.top_k_candidates),
            self.cfg.model.similarity, first_rank=0
        )
        run = lexical() if source == "bm25" else vectors() if source == "dense" else relevance.fuse(lexical(), vectors(), r.rerank_k)
        pairs = relevance.estimate(r.mode, run, routed.opt_topics, corpus, r.calibration, r.high_impact_fraction, self.scorer)
        s = r.scale
        return relevance.judged(
            pairs, routing.utility_qrels(routed), r.qrel_adjustment, s.mode, s.min_label, s.max_label, s.explicit_map,
            self.cfg.utility.relevance_threshold
        )

    def utilities(self, routed: routing.Routed, corpus: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        u = self.cfg.utility
        if utility.estimator(u.estimator) is utility.residual:
            return utility.residual(docs, self.profiles, int(u.residual_norm.norm), u.residual_norm.epsilon), None, None
        queries = self.query_vectors(routed.opt_topics)
        pairs = self.relevance(routed, corpus, docs, queries)
        scored = utility.observed(
            pairs, queries, docs, self.profiles, metric=u.metric, similarity=self.cfg.model.similarity,
            epsilon=u.epsilon, alpha=u.alpha, negatives=u.margin_negatives
        )
        tail = None
        unranked = docs.select("docno").join(pairs.select("docno"), "docno", "left_anti")
        t = utility.Tail(
            u.tail.mode, u.tail.target_residual, u.tail.conservatism_beta, u.tail.expected_fraction,
            u.tail.max_tail_relevance, u.tail.profile_quality, u.tail.sampled_quality_queries, u.tail.utility_low
        )
        if u.tail.mode == "rbp_residual_interval":
            quality = utility.padding_quality(docs, self.profiles) if t.quality == "cosine_padding" else utility.sampled_quality(
                docs, queries, self.profiles, u.metric, self.cfg.model.similarity, t.sampled_queries, u.seed, u.epsilon,
                u.alpha, u.margin_negatives
            )
            tail = kept(utility.tail_utility(unranked, docs, quality, t))
        self.tail = utility.tail_report(t, tail, unranked.count() if tail is not None else 0)
        return utility.table(docs, self.profiles, utility.mean_utility(scored), tail, u.default_utility_profile_name), pairs, scored

    def run(self) -> Result:
        cfg = self.cfg
        check(self.profiles, None, cfg.model.full_profile_name)
        routed = self.route()
        log.info("queries are routed (%s); utilities by %s", routed.mode, cfg.utility.estimator)
        corpus = self.corpus(C.evaluation(cfg).data if cfg.utility.estimator == "residual_norm" else cfg.data)
        docs = self.doc_vectors(corpus)
        table, pairs, scored = self.utilities(routed, corpus, docs)
        o = cfg.optimization
        solved = knapsack.solve(
            table, self.profiles, C.budget(cfg), o.max_iter, o.tolerance, o.lambda_low, o.lambda_high,
            cfg.execution.dtype
        )
        log.info(
            "%d documents assigned: %d of %d bytes", solved.report["num_docs"], solved.report["total_cost_bytes"],
            solved.report["budget_bytes"]
        )
        dims = with_profiles(docs.select("docno"), self.profiles, cfg.execution.dtype).select("docno", "profile", "dimension")
        queries = self.query_vectors(routed.eval_topics)
        assigned = solved.assignments.join(dims, ["docno", "profile"])
        baseline = self.bm25_run(corpus, routed.eval_topics, cfg.retrieval.top_k, 1) if cfg.retrieval.include_bm25_baseline else None
        if cfg.retrieval.mode == "dense_exact":
            runs = dense.runs(
                queries, docs, self.profiles, assigned, cfg.retrieval.top_k, cfg.model.similarity, self.full.name,
                bm25=baseline
            )
        else:
            runs = self.reranked(queries, docs, self.bm25_run(corpus, routed.eval_topics, cfg.retrieval.candidate_k), assigned, baseline)
        scores = evaluation.per_query(runs, routed.eval_qrels)
        report = {
            "optimization": solved.report, "routing": routing.metadata(routed).first().asDict(),
            "memory": reporting.memory_summary(solved.assignments, self.full.cost(cfg.execution.dtype)).first().asDict()
        }
        if pairs is not None:
            report["tail"] = self.tail
            report["coverage"] = utility.coverage(docs.select("docno"), pairs, utility.mean_utility(scored)).first().asDict()
        return Result(solved.assignments, runs, scores, table, pairs, scored, report)

    def reranked(self, queries: DataFrame, docs: DataFrame, found: DataFrame, assigned: DataFrame, baseline: DataFrame | None) -> DataFrame:
        """The same runs over lexical candidates."""
        corpora = {"full_run": dense.cut(docs, self.full.dimension)}
        corpora |= {
            f"profile_{p.name}_run": dense.cut(docs, p.dimension) for p in sorted(
                self.profiles, key=lambda p: (p.dimension, p.name), reverse=True
            ) if p != self.full
        }
        corpora["optimized_run"] = dense.materialize(docs, assigned)
        every = [("bm25_run", baseline)] if baseline is not None else []
        every += [(n, dense.rerank(found, queries, c, self.cfg.model.similarity)) for n, c in corpora.items()]
        out = None
        for i, (name, r) in enumerate(every):
            own = r.select(F.lit(name).alias("run"), F.lit(i).alias("run_order"), "qid", "docno", "score", "rank")
            out = own if out is None else out.unionByName(own)
        return out

    def persist(self, r: Result) -> None:
        x, f = self.cfg.execution, self.folder
        first = "bm25_run" if self.cfg.retrieval.include_bm25_baseline else "full_run"
        sinks.save(r.assignments, f"{f}/assignments.parquet")
        sinks.save(r.utility, f"{f}/utility_table.parquet")
        sinks.save(r.assignments.select("docno").orderBy("docno"), f"{x.output_dir}/corpus_metadata.parquet")
        if x.save_runs:
            sinks.save(r.runs, f"{f}/runs.parquet")
        if x.save_score_pairs and r.score_pairs is not None:
            sinks.save(r.score_pairs, f"{f}/score_pairs.parquet", rows_per_file=100_000)
        sinks.save(evaluation.significance(evaluation.compare(r.scores, first), first), f"{f}/pt_experiment.csv", "csv")
        sinks.save_json(self.spark, r.report | {"metrics_by_run": evaluation.by_run(r.scores)}, f"{f}/summary.json")
        sinks.save_config(self.spark, self.cfg, f"{f}/config_snapshot.yaml")


def benchmark(
    spark: SparkSession, topics: DataFrame, qrels: DataFrame, corpus: DataFrame, models: dict[str, encoding.Encoder],
    dimensions: list[int], k: int = 100, similarity: str = "dot", candidates: DataFrame | None = None,
    cache: str | None = None, output: str | None = None
) -> DataFrame:
    """Models by dimensions: `model_id`, `dimension`, `metric`, `value`. Each model encodes once at its full width; all widths are searched in one pass. With candidates, these are reranked.

    cache: a folder that keeps vectors by model, role, width and ids. output: a folder for the four result files.
    """

    def vectors(df: DataFrame, role: str, key: str, text: str, encoder: encoding.Encoder) -> DataFrame:
        make = lambda d: encoding.encode(d, key, text, encoder)
        if not cache:
            return kept(make(df))
        ids = df.select(F.coalesce(F.sum(F.xxhash64(key, text).cast("decimal(38,0)")), F.lit(0)), F.count("*")).first()
        return encoding.cached(
            spark, f"{cache}/{encoding.store_name(role, encoder.name)}",
            encoding.context(model=encoder.name, role=role, width=encoder.width, ids=tuple(map(str, ids))), df, make,
            key
        )

    runs = None
    for name, encoder in models.items():
        docs = vectors(corpus, "documents", "docno", "text", encoder)
        queries = vectors(topics, "queries", "qid", "query", encoder).withColumnRenamed("v", "qvec")
        if candidates is None:
            own = [dense.search_widths(queries, docs, dimensions, k, similarity)]
        else:
            own = [dense.rerank(candidates, queries, dense.cut(docs, m), similarity, k).withColumn("w", F.lit(m)) for m in dimensions]
        for r in own:
            r = r.select(F.concat(F.lit(f"{name}\t"), F.col("w").cast("string")).alias("run"), "qid", "docno", "score")
            runs = r if runs is None else runs.unionByName(r)
    means = evaluation.means(evaluation.per_query(runs, qrels))
    part = F.split("run", "\t")
    wide = means.select(part[0].alias("model_id"), part[1].cast("int").alias("dimension"), *evaluation.MEASURES)
    long = reporting.to_long(wide, ["model_id", "dimension"], list(evaluation.MEASURES))
    if output:
        long = kept(long)
        sinks.save_benchmark(
            long, ["model_id", "dimension"], list(evaluation.MEASURES), output,
            {
                "models": sorted(models), "dimensions": dimensions, "k": k, "similarity": similarity,
                "mode": "full" if candidates is None else "candidates"
            }
        )
    return long
