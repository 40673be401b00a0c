"""Queries over the provided tables, each with the SQL that it must agree with.

Documents are the rows of `embeddings`, or of `documents` where text is needed; queries are the rows of `embeddings` whose id is
divisible by 20, or those of `benchmark`. Judgements of vectors are equal labels, graded by the document's id; a text is relevant
to a benchmark item that it contains. A document's own vector is no answer to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions import scores as S
from lumenspan.functions import text as X
from lumenspan.functions import vectors as V
from lumenspan.operators import bm25, dense, encoding, evaluation, knapsack, relevance, reporting, routing, training, utility
from lumenspan.operators.profiles import Profile, frame, with_profiles
from lumenspan.sources import sinks, tables
from lumenspan.sources.shared import folder, kept
from lumenspan.streaming import online

PROFILES = [Profile("d8", 8), Profile("d16", 16), Profile("d32", 32), Profile("full", 64)]
COSTS = [p.cost() for p in PROFILES]
NAMES = [p.name for p in PROFILES]
LAMBDA = 0.0078
GRID = [0.0, 0.006, 0.007, 0.0075, 0.0078, 0.0081, 0.009, 0.012]
K = 10
CANDIDATES = 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_vec(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("docno"), F.col("embedding").alias("v"), "label")


def query_vec(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel")
    )


def qrels_dense(spark: SparkSession, d: str) -> DataFrame:
    q, v = query_vec(spark, d), doc_vec(spark, d)
    return q.join(v, F.col("qlabel") == F.col("label")).where("qid <> docno").select(
        "qid", "docno", (F.lit(1) + F.col("docno").cast("int") % 3).alias("label")
    )


def full_corpus(spark: SparkSession, d: str) -> DataFrame:
    return doc_vec(spark, d).select("docno", F.col("v").alias("vec"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Dense candidates, ranks from 0."""
    return dense.search(query_vec(spark, d), full_corpus(spark, d), CANDIDATES, skip_self=True, first_rank=0)


def text_corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docno"), "text")


def text_topics(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def residuals(spark: SparkSession, d: str, p: int = 1) -> DataFrame:
    return utility.residual(doc_vec(spark, d), PROFILES, p)


def wide(spark: SparkSession, d: str) -> knapsack.Problem:
    """Residual utilities in the order of profiles, with half of the full budget."""
    u = online.utilities(doc_vec(spark, d), PROFILES, 1)
    n = read(spark, d, "embeddings").count()
    return knapsack.Problem(u, NAMES, COSTS, n * 64, n)


def assigned(spark: SparkSession, d: str) -> DataFrame:
    p = wide(spark, d)
    return knapsack.assignments(knapsack.at_lambda(p, LAMBDA), p)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- SQL parts

_DV = "dv AS (SELECT CAST(vec_id AS VARCHAR) AS docno, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), qv AS (SELECT docno AS qid, v AS qvec, label AS qlabel FROM dv WHERE CAST(docno AS BIGINT) % 20 = 0)"
_PROF = "prof(idx, profile, dimension, cost_bytes) AS (VALUES (0, 'd8', 8, CAST(16 AS BIGINT)), (1, 'd16', 16, 32), (2, 'd32', 32, 64), (3, 'full', 64, 128))"
_ALL = "scored AS (SELECT qid, docno, round(list_inner_product(qvec, v), 9) AS score FROM qv, dv WHERE qid <> docno)"
_RANKED = "ranked AS (SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank FROM scored)"
_CAND = f"{_DV}, {_ALL}, {_RANKED}, cand AS (SELECT qid, docno, score, rank - 1 AS rank FROM ranked WHERE rank <= {CANDIDATES})"
_ABS = "coalesce(list_sum(list_transform({0}, lambda x: abs(x))), 0)"
_SQ = "coalesce(list_sum(list_transform({0}, lambda x: x * x)), 0)"
_N1, _N2 = _ABS.format("v"), f"sqrt({_SQ.format('v')})"
_RES1 = f"res AS (SELECT docno, idx, profile, dimension, cost_bytes, CASE WHEN {_N1} <= 1e-12 OR dimension >= 64 THEN 1.0 ELSE least(greatest(1 - {_ABS.format('v[dimension + 1 : 64]')} / greatest({_N1}, 1e-12), 0.0), 1.0) END AS utility FROM dv, prof)"
_RES2 = f"res AS (SELECT docno, idx, profile, dimension, cost_bytes, CASE WHEN {_N2} <= 1e-12 OR dimension >= 64 THEN 1.0 ELSE least(greatest(1 - sqrt({_SQ.format('v[dimension + 1 : 64]')}) / greatest({_N2}, 1e-12), 0.0), 1.0) END AS utility FROM dv, prof)"
_PICK = f"pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY utility - {LAMBDA} * cost_bytes DESC, idx) AS n FROM res) WHERE n = 1)"
_QRELS = "qrels AS (SELECT qid, docno, 1 + CAST(docno AS BIGINT) % 3 AS label FROM qv JOIN dv ON qlabel = label WHERE qid <> docno)"
_TOK = r"'[\p{L}\p{N}]+'"


# ---- sources and scalar functions


@query("SELECT CAST(doc_id AS VARCHAR) AS docno, regexp_replace(concat_ws(chr(10), CASE WHEN regexp_replace(source, '^\\s+|\\s+$', '', 'g') <> '' THEN source END, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN text END), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def compose_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docno"), X.compose_text("source", "text").alias("text"))


@query("SELECT page_id, replace(url, ':', ' ') AS query FROM pages")
def sanitize_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", X.sanitize_query(F.col("url")).alias("query"))


@query("SELECT item_id, concat('query: ', text) AS query, coalesce(text, '') AS body FROM benchmark")
def prompt_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(
        "item_id", X.prompted("query: ", F.col("text")).alias("query"), X.index_text("text").alias("body")
    )


@query("SELECT CAST(e.vec_id AS VARCHAR) AS docno FROM embeddings e ANTI JOIN documents d ON e.vec_id = d.doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents d ANTI JOIN embeddings e ON e.vec_id = d.doc_id")
def missing_docnos(spark: SparkSession, d: str) -> DataFrame:
    v, t = doc_vec(spark, d), text_corpus(spark, d)
    return tables.missing_docnos(v, t).union(tables.missing_docnos(t, v))


@query("SELECT CAST(doc_id AS VARCHAR) AS docno, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def duplicate_docnos(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "documents").select("doc_id").union(read(spark, d, "labels").select("doc_id"))
    return tables.duplicate_docnos(both.select(F.col("doc_id").cast("string").alias("docno")))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS none FROM events")
def numeric_log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", S.number(F.get_json_object("props", "$.k")).alias("k"), S.number(F.col("event_type")).alias("none")
    )


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug, substr(sha256(url), 1, 8) AS digest FROM pages")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(
        "page_id", S.slug(F.col("url")).alias("slug"),
        F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 8).alias("digest")
    )


@query("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY source")
def id_digests(spark: SparkSession, d: str) -> DataFrame:
    ids = F.concat_ws("\n", F.sort_array(F.collect_list(F.col("doc_id").cast("string"))))
    return read(spark, d, "documents").groupBy("source").agg(F.sha2(ids.cast("binary"), 256).alias("digest"))


@query("SELECT * FROM (VALUES (0, 'd8', 8, CAST(16 AS BIGINT)), (1, 'd16', 16, 32), (2, 'd32', 32, 64), (3, 'full', 64, 128)) t(idx, profile, dimension, cost_bytes)")
def profile_costs(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, PROFILES)


# ---- vectors and utilities from vectors


@query(f"WITH {_DV}, {_ALL}, {_RANKED} SELECT qid, docno, round(score, 6) AS score, rank FROM ranked WHERE rank <= {K}")
def dense_topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dense.search(query_vec(spark, d), full_corpus(spark, d), K, skip_self=True), "score")


@query(f"WITH {_DV}, scored AS (SELECT qid, docno, round(list_inner_product(qvec[1:32], v[1:32]) / (greatest(sqrt({_SQ.format('qvec[1:32]')}), 1e-12) * greatest(sqrt({_SQ.format('v[1:32]')}), 1e-12)), 9) AS score FROM qv, dv WHERE qid <> docno), {_RANKED} SELECT qid, docno, round(score, 6) AS score, rank FROM ranked WHERE rank <= {K}")
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    return rounded(dense.search(query_vec(spark, d), dense.cut(v, PROFILES[2].dimension), K, "cosine", skip_self=True), "score")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK}, scored AS (SELECT qid, docno, round(list_inner_product(qvec[1:dimension], v[1:dimension]), 9) AS score FROM qv, dv JOIN pick USING (docno) WHERE qid <> docno), {_RANKED} SELECT qid, docno, round(score, 6) AS score, rank FROM ranked WHERE rank <= {K}")
def mixed_width_topk(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    dims = with_profiles(v.select("docno"), PROFILES).select("docno", "profile", "dimension")
    corpus = dense.materialize(v, assigned(spark, d).join(dims, ["docno", "profile"]))
    return rounded(dense.search(query_vec(spark, d), corpus, K, skip_self=True), "score")


@query(f"WITH {_CAND}, r AS (SELECT qid, docno, round(list_inner_product(qvec[1:16], v[1:16]), 9) AS score FROM cand JOIN qv USING (qid) JOIN dv USING (docno)) SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank FROM r")
def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    return rounded(dense.rerank(candidates(spark, d), query_vec(spark, d), dense.cut(v, PROFILES[1].dimension)), "score")


@query(f"WITH {_CAND}, r AS (SELECT qid, docno, round(list_inner_product(qvec[1:32], v[1:32]), 9) AS score FROM cand JOIN qv USING (qid) JOIN dv USING (docno)), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS INTEGER) AS rank FROM r) SELECT qid, docno, round(score, 6) AS score, rank FROM s WHERE rank <= 5")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    return rounded(dense.rerank(candidates(spark, d), query_vec(spark, d), dense.cut(v, PROFILES[2].dimension), k=5), "score")


@query(f"WITH {_CAND} SELECT qid, count(*) AS n_dropped FROM cand ANTI JOIN (SELECT CAST(doc_id AS VARCHAR) AS docno FROM labels) l USING (docno) GROUP BY qid")
def dropped_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dense.dropped(candidates(spark, d), read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("docno")))


for _p, _part in ((1, _RES1), (2, _RES2)):

    def _residual(spark: SparkSession, d: str, p: int = _p) -> DataFrame:
        return rounded(residuals(spark, d, p), "utility")

    _residual.__name__ = f"residual_norm_l{_p}"
    query(f"WITH {_DV}, {_PROF}, {_part} SELECT docno, profile, round(utility, 6) AS utility FROM res")(_residual)


@query(f"WITH {_DV}, {_PROF}, {_RES1} SELECT profile, count(*) AS n, round(min(utility), 6) AS min_utility, round(avg(utility), 6) AS mean_utility, round(max(utility), 6) AS max_utility FROM res GROUP BY profile")
def residual_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(utility.report(residuals(spark, d)), "min_utility", "mean_utility", "max_utility")


@query(f"WITH {_DV}, {_PROF} SELECT docno, profile, round(least(greatest({_SQ.format('v[1:dimension]')} / (greatest({_N2}, 1e-12) * greatest(sqrt({_SQ.format('v[1:dimension]')}), 1e-12)), 0.0), 1.0), 6) AS profile_quality FROM dv, prof")
def cosine_padding_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(utility.padding_quality(doc_vec(spark, d), PROFILES), "profile_quality")


@query(f"WITH {_DV} SELECT docno, round(list_sum(list_transform(v, lambda x: x / greatest({_N2}, 1e-12))), 6) AS total, round({_N2}, 6) AS length FROM dv")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    n = V.normalized("v")
    return doc_vec(spark, d).select(
        "docno", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(V.norm("v"), 6).alias("length")
    )


_ROUNDED = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, floor(log2(abs(x))) - {0}), 0) * pow(2.0, floor(log2(abs(x))) - {0}) END"


@query(f"WITH {_DV} SELECT docno, {', '.join(f'round(list_sum(list_transform(v, lambda x: {_ROUNDED.format(bits - 1)})), 9) AS {name}' for name, bits in (('float16', 11), ('bfloat16', 8)))} FROM dv")
def rounded_vectors(spark: SparkSession, d: str) -> DataFrame:
    total = lambda kind: F.round(F.aggregate(V.rounded("v", kind), F.lit(0.0), lambda a, x: a + x), 9).alias(kind)
    return doc_vec(spark, d).select("docno", total("float16"), total("bfloat16"))


@query(f"WITH {_DV} SELECT docno, round(list_sum(list_transform(range(1, 33), lambda i: i * (v[i] + v[i + 32]) / 2)), 6) AS mean, round(list_sum(list_transform(range(1, 33), lambda i: i * v[i])), 6) AS cls FROM dv")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Halves of a vector as two token vectors."""
    rows = F.array(V.prefix("v", 32), V.suffix("v", 32))
    weighed = lambda how: F.round(
        F.aggregate(F.transform(V.pooled(rows, 32, how), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6
    ).alias(how)
    return doc_vec(spark, d).select("docno", weighed("mean"), weighed("cls"))


# ---- text retrieval


@query(f"WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS docno, regexp_extract_all(lower(text), {_TOK}) AS w FROM documents), p AS (SELECT docno, term, count(*) AS tf FROM (SELECT docno, unnest(w) AS term FROM t) GROUP BY docno, term) SELECT (SELECT count(*) FROM t) AS n_docs, (SELECT count(DISTINCT term) FROM p) AS n_terms, (SELECT count(*) FROM p) AS n_postings, (SELECT CAST(sum(len(w)) AS BIGINT) FROM t) AS n_tokens, (SELECT round(avg(len(w)), 6) FROM t) AS avgdl")
def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.build(text_corpus(spark, d)).stats(), "avgdl")


def text_run(spark: SparkSession, d: str, k: int) -> DataFrame:
    topics = text_topics(spark, d)
    return bm25.run(bm25.build(text_corpus(spark, d), only=bm25.query_terms(topics)), topics, k)


_BM25 = f"""t AS (SELECT CAST(doc_id AS VARCHAR) AS docno, regexp_extract_all(lower(text), {_TOK}) AS w FROM documents),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT CAST(item_id AS VARCHAR) AS qid, unnest(regexp_extract_all(lower(replace(text, ':', ' ')), {_TOK})) AS term FROM benchmark) GROUP BY qid, term),
p AS (SELECT docno, term, count(*) AS tf FROM (SELECT docno, unnest(w) AS term FROM t) GROUP BY docno, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
s AS (SELECT qid, docno, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 9) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN t USING (docno), n GROUP BY qid, docno),
bm AS (SELECT qid, docno, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 AS INTEGER) AS rank FROM s)"""


@query(f"WITH {_BM25} SELECT qid, docno, round(score, 5) AS score, rank FROM bm WHERE rank < {K}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text_run(spark, d, K), "score", digits=5)


@query(f"WITH {_BM25}, z AS (SELECT qid, docno, score FROM bm WHERE rank < 50), c AS (SELECT qid, docno, count(*) AS n FROM z GROUP BY qid, docno), x AS (SELECT z.qid, z.docno, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), {_TOK})), list_distinct(t.w))) / greatest(len(list_distinct(list_concat(regexp_extract_all(lower(b.text), {_TOK}), t.w))), 1) AS j FROM z JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = z.qid JOIN t USING (docno)), r AS (SELECT qid, docno, round(j, 9) AS score FROM x) SELECT qid, docno, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 AS INTEGER) AS rank FROM r")
def cross_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relevance.rescore(text_run(spark, d, 50), text_topics(spark, d), text_corpus(spark, d)), "score")


# ---- relevance

_HALF = "half AS (SELECT qid, docno, round(list_inner_product(qvec[1:32], v[1:32]), 9) AS score FROM qv, dv WHERE qid <> docno), h AS (SELECT qid, docno, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS n FROM half) WHERE n <= 20)"


@query(f"WITH {_CAND}, {_HALF}, u AS (SELECT qid, docno, max(score) AS score FROM (SELECT qid, docno, score FROM cand UNION ALL SELECT * FROM h) GROUP BY qid, docno), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) - 1 AS INTEGER) AS rank FROM u) SELECT qid, docno, round(score, 6) AS score, rank FROM r WHERE rank < 15")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    half = dense.search(query_vec(spark, d), dense.cut(v, PROFILES[2].dimension), CANDIDATES, skip_self=True)
    return rounded(relevance.fuse(candidates(spark, d), half, 15), "score")


_MM = "mm AS (SELECT qid, docno, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9) AS rel FROM cand WINDOW w AS (PARTITION BY qid))"
_RL = "mm AS (SELECT qid, docno, least(greatest(1 / log2(rank + 2), 0.0), 1.0) AS rel FROM cand)"
_CONF = "nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docno) AS n FROM mm), cal AS (SELECT qid, docno, rel, least(greatest(abs(rel - coalesce(max(CASE WHEN n = 2 THEN rel END) OVER (PARTITION BY qid), max(CASE WHEN n = 1 THEN rel END) OVER (PARTITION BY qid))), 0.0), 1.0) AS conf FROM nn)"
_CAL_OUT = "SELECT qid, docno, round(rel, 6) AS relevance_final, round(conf, 6) AS confidence, round(1 - conf, 6) AS uncertainty FROM cal"


def _calibrated(spark: SparkSession, d: str, how: str) -> DataFrame:
    return rounded(
        relevance.calibrate(candidates(spark, d), how).select("qid", "docno", "relevance_final", "confidence", "uncertainty"),
        "relevance_final", "confidence", "uncertainty"
    )


@query(f"WITH {_CAND}, {_MM}, {_CONF} {_CAL_OUT}")
def calibrate_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, "minmax_score")


@query(f"WITH {_CAND}, {_RL}, {_CONF} {_CAL_OUT}")
def calibrate_ranklog(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, "rank_log_discount")


@query(f"WITH {_CAND} SELECT qid, docno, CAST(1.0 AS DOUBLE) AS relevance_final, CAST(1.0 AS DOUBLE) AS confidence, CAST(0.0 AS DOUBLE) AS uncertainty FROM cand")
def calibrate_constant(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, "constant_one")


_TOP3 = "keys AS (SELECT qid, docno FROM (SELECT *, row_number() OVER (ORDER BY round(1 - conf, 9) DESC, round(abs(rel) * (2 - conf), 9) DESC, qid, docno) AS n FROM cal) WHERE n <= greatest(1, CAST(floor((SELECT count(*) FROM cal) * 0.2) AS BIGINT)))"


@query(f"WITH {_CAND}, {_MM}, {_CONF}, {_TOP3} SELECT qid, docno FROM keys")
def uncertain_high_impact(spark: SparkSession, d: str) -> DataFrame:
    p = relevance.calibrate(candidates(spark, d))
    n = p.count()
    return p.orderBy(
        F.round("uncertainty", 9).desc(), F.round(S.impact(F.col("relevance_final"), F.col("uncertainty")), 9).desc(),
        "qid", "docno"
    ).limit(max(1, int(n * 0.2))).select("qid", "docno")


@query(f"WITH {_CAND}, {_MM}, {_CONF}, ref AS (SELECT qid, docno, 1 / log2(rank + 2) AS r2 FROM cand WHERE rank % 2 = 0) SELECT c.qid, c.docno, round(coalesce(r2, rel), 6) AS relevance_final, CASE WHEN r2 IS NULL THEN 'weak' ELSE 'hybrid' END AS source_mode FROM cal c LEFT JOIN ref r ON r.qid = c.qid AND r.docno = c.docno")
def merge_refined(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    refined = relevance.calibrate(c, "rank_log_discount").join(
        c.where("rank % 2 = 0").select("qid", "docno"), ["qid", "docno"], "left_semi"
    )
    return rounded(relevance.merge_refined(relevance.calibrate(c), refined).select("qid", "docno", "relevance_final", "source_mode"), "relevance_final")


def _judged(spark: SparkSession, d: str, **how) -> DataFrame:
    p = relevance.judged(relevance.calibrate(candidates(spark, d)), qrels_dense(spark, d), **how)
    return rounded(p.select("qid", "docno", "relevance_final", "is_qrel_overridden"), "relevance_final")


_J = f"WITH {_CAND}, {_MM}, {_CONF}, {_QRELS} SELECT c.qid, c.docno, round({{0}}, 6) AS relevance_final, {{1}} AS is_qrel_overridden FROM cal c LEFT JOIN qrels r ON r.qid = c.qid AND r.docno = c.docno"


@query(_J.format("CASE WHEN label IS NULL THEN rel ELSE least(greatest(label, 0), 3) / 3.0 END", "label IS NOT NULL"))
def qrels_hard_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


@query(_J.format("CASE label WHEN 1 THEN 0.3 WHEN 3 THEN 1.0 ELSE rel END", "label IS NOT NULL"))
def qrels_hard_map(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, scale="explicit_map", mapping={"1": 0.3, "3": 1.0})


@query(_J.format("CASE WHEN label >= 2 THEN 1.0 ELSE rel END", "coalesce(label >= 2, false)"))
def qrels_relevant_only(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d, how="relevant_only_to_one", threshold=2.0)


_TQ = "tq AS (SELECT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docno, 2 AS label FROM benchmark b JOIN documents x ON contains(x.text, b.text)), tt AS (SELECT CAST(item_id AS VARCHAR) AS qid FROM benchmark)"


def qrels_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's text. A document that does holds the item's longest inner word as a word, so only those that
    share it are looked at.
    """
    parts = lambda c: F.split(c, r"\s+")
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("t")).where("t IS NOT NULL")
    inner = F.filter(F.slice(parts("t"), F.lit(2), F.greatest(F.size(parts("t")) - 2, F.lit(0))), lambda w: w != "")
    items = items.withColumn("w", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"])
    docs = read(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(parts("text"))).alias("w"))
    near = words.join(items.where("w IS NOT NULL"), "w").select("item_id", "t", "doc_id").join(docs, "doc_id")
    short = docs.join(F.broadcast(items.where("w IS NULL").select("item_id", "t").limit(SHORT_ITEMS)), F.contains("text", "t"))
    if items.where("w IS NULL").count() > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items of fewer than three words")
    held = near.where(F.contains("text", "t")).select("item_id", "doc_id").union(short.select("item_id", "doc_id"))
    return held.select(F.col("item_id").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("docno"), F.lit(2).alias("label"))


#: Items without a word inside are looked for in all documents; more than so many are refused.
SHORT_ITEMS = 1000


def text_split(spark: SparkSession, d: str) -> routing.Routed:
    """Items split by whether a document holds them, which may be all or none. The documents are read for them once."""
    return routing.split_by_qrels(text_topics(spark, d), kept(qrels_text(spark, d)), allow_empty=True)


@query(f"WITH {_TQ} SELECT qid, CASE WHEN qid IN (SELECT qid FROM tq) THEN 'eval' ELSE 'opt' END AS side FROM tt")
def route_split_by_qrels(spark: SparkSession, d: str) -> DataFrame:
    r = text_split(spark, d)
    return r.opt_topics.select("qid", F.lit("opt").alias("side")).union(r.eval_topics.select("qid", F.lit("eval").alias("side")))


@query(f"WITH {_TQ}, n AS (SELECT (SELECT count(DISTINCT qid) FROM tq) AS e, (SELECT count(*) FROM tt) AS a, (SELECT count(*) FROM tq) AS j) SELECT a - e AS opt_queries, e AS eval_queries, CAST(0 AS BIGINT) AS opt_qrels, j AS eval_qrels, CAST(0 AS BIGINT) AS overlap, 'split_by_qrels' AS mode FROM n")
def route_overlap(spark: SparkSession, d: str) -> DataFrame:
    return routing.metadata(text_split(spark, d))


@query(f"WITH {_BM25}, z AS (SELECT qid, docno, score FROM bm WHERE rank < 20), x AS (SELECT z.qid, z.docno, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), {_TOK})), list_distinct(t.w))) / greatest(len(list_distinct(list_concat(regexp_extract_all(lower(b.text), {_TOK}), t.w))), 1) AS j FROM z JOIN benchmark b ON CAST(b.item_id AS VARCHAR) = z.qid JOIN t USING (docno)), cand AS (SELECT qid, docno, round(j, 9) AS score FROM x), {_MM}, {_CONF} {_CAL_OUT}")
def model_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates rescored by query and text, and calibrated."""
    p = relevance.estimate("model", text_run(spark, d, 20), text_topics(spark, d), text_corpus(spark, d))
    return rounded(p.select("qid", "docno", "relevance_final", "confidence", "uncertainty"), "relevance_final", "confidence", "uncertainty")


@query(f"WITH {_CAND} SELECT qid, docno, rank FROM cand SEMI JOIN (SELECT CAST(doc_id AS VARCHAR) AS docno FROM labels) USING (docno)")
def known_docnos(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).join(
        read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("docno")), "docno", "left_semi"
    ).select("qid", "docno", "rank")


@query(f"WITH {_TQ}, n AS (SELECT count(*) AS n FROM tq) SELECT 'shared' AS routing, CAST(0 AS BIGINT) AS may_override UNION ALL SELECT 'dual_source', n FROM n")
def suppressed_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgements never override where a query is on both sides."""
    t, q = text_topics(spark, d), kept(qrels_text(spark, d))
    other = t.withColumn("qid", F.concat(F.lit("e"), "qid"))
    counted = lambda name, r: routing.utility_qrels(r).agg(F.count("*").alias("may_override")).select(
        F.lit(name).alias("routing"), "may_override"
    )
    return counted("shared", routing.shared(t, q)).union(counted("dual_source", routing.dual_source(t, q, other, q)))


# ---- utilities from a query log

_PAIRS = f"{_CAND}, {_PROF}, sc AS (SELECT qid, docno, profile, list_inner_product(qvec, v) AS s, list_inner_product(qvec[1:dimension], v[1:dimension]) AS r FROM cand JOIN qv USING (qid) JOIN dv USING (docno), prof)"
_NEG = """w1 AS (SELECT *, count(*) OVER (PARTITION BY qid, profile) AS n, row_number() OVER (PARTITION BY qid, profile ORDER BY s DESC, docno) AS ns, row_number() OVER (PARTITION BY qid, profile ORDER BY r DESC, docno) AS nr FROM sc),
ws AS (SELECT a.qid, a.docno, a.profile, avg(b.s) AS sn FROM w1 a JOIN w1 b ON b.qid = a.qid AND b.profile = a.profile AND b.docno <> a.docno AND b.ns - (CASE WHEN a.ns < b.ns THEN 1 ELSE 0 END) <= 4 GROUP BY a.qid, a.docno, a.profile),
wr AS (SELECT a.qid, a.docno, a.profile, avg(b.r) AS rn FROM w1 a JOIN w1 b ON b.qid = a.qid AND b.profile = a.profile AND b.docno <> a.docno AND b.nr - (CASE WHEN a.nr < b.nr THEN 1 ELSE 0 END) <= 4 GROUP BY a.qid, a.docno, a.profile),
w2 AS (SELECT * FROM w1 JOIN ws USING (qid, docno, profile) JOIN wr USING (qid, docno, profile))"""
_REL = "(1 - abs(s - r) / greatest(abs(s), 1e-6))"
_MAR = "(1 - abs((s - sn) - (r - rn)) / greatest(abs(s - sn), 1e-6))"


def _preserved(spark: SparkSession, d: str, metric: str) -> DataFrame:
    p = utility.preserved(candidates(spark, d).select("qid", "docno"), query_vec(spark, d), doc_vec(spark, d), PROFILES, metric)
    return rounded(p.select("qid", "docno", "profile", "score_preservation"), "score_preservation", digits=5)


for _name, _metric, _from, _value in (
    ("preserve_relative", S.METRICS[0], "sc", _REL),
    ("preserve_absolute", S.METRICS[1], "sc", "1 / (1 + abs(s - r))"),
    ("preserve_squared", S.METRICS[2], "sc", "1 / (1 + (s - r) * (s - r))"),
    ("preserve_margin", S.METRICS[3], "w2", f"CASE WHEN n <= 1 THEN 1.0 ELSE {_MAR} END"),
    ("preserve_hybrid", S.METRICS[4], "w2", f"CASE WHEN n <= 1 THEN 1.0 ELSE 0.7 * {_REL} + 0.3 * {_MAR} END"),
):

    def _preserve(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        return _preserved(spark, d, metric)

    _preserve.__name__ = _name
    query(f"WITH {_PAIRS}{', ' + _NEG if _from == 'w2' else ''} SELECT qid, docno, profile, round({_value}, 5) AS score_preservation FROM {_from}")(_preserve)


def log_pairs(spark: SparkSession, d: str) -> DataFrame:
    return relevance.calibrate(candidates(spark, d))


def log_means(spark: SparkSession, d: str) -> DataFrame:
    return utility.mean_utility(utility.observed(log_pairs(spark, d), query_vec(spark, d), doc_vec(spark, d), PROFILES))


_LOG = f"{_PAIRS}, {_MM}, mu AS (SELECT docno, profile, avg(rel * {_REL}) AS u FROM sc JOIN mm USING (qid, docno) GROUP BY docno, profile)"


@query(f"WITH {_LOG} SELECT dv.docno, prof.profile, round(coalesce(u, CASE WHEN prof.profile = 'full' THEN 1.0 ELSE 0.0 END), 6) AS utility FROM dv CROSS JOIN prof LEFT JOIN mu ON mu.docno = dv.docno AND mu.profile = prof.profile")
def utility_query_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(utility.table(doc_vec(spark, d), PROFILES, log_means(spark, d)), "utility")


@query(f"WITH {_DV}, {_PROF} SELECT docno, profile, CASE WHEN profile = 'full' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS utility FROM dv, prof")
def default_utility(spark: SparkSession, d: str) -> DataFrame:
    return utility.default(doc_vec(spark, d), PROFILES)


def _tail(spark: SparkSession, d: str, tail: utility.Tail, quality: DataFrame) -> DataFrame:
    v = doc_vec(spark, d)
    unranked = v.select("docno").join(candidates(spark, d).select("docno"), "docno", "left_anti")
    return rounded(utility.tail_utility(unranked, v, quality, tail), "utility", "profile_quality", digits=8)


_UN = "un AS (SELECT docno FROM dv ANTI JOIN cand USING (docno)), nu AS (SELECT count(*) AS n FROM un)"
_PQ = f"pq AS (SELECT docno, profile, least(greatest({_SQ.format('v[1:dimension]')} / (greatest({_N2}, 1e-12) * greatest(sqrt({_SQ.format('v[1:dimension]')}), 1e-12)), 0.0), 1.0) AS q FROM dv, prof)"


@query(f"WITH {_CAND}, {_PROF}, {_UN}, {_PQ} SELECT docno, profile, round(greatest(0.0, least(0.01, 0.005 / n) * q - 0.5 * (0.005 / n) * q), 8) AS utility, round(q, 8) AS profile_quality FROM pq SEMI JOIN un USING (docno), nu")
def tail_utility_beta(spark: SparkSession, d: str) -> DataFrame:
    return _tail(spark, d, utility.Tail("rbp_residual_interval"), utility.padding_quality(doc_vec(spark, d), PROFILES))


@query(f"WITH {_CAND}, {_PROF}, {_UN}, {_PQ} SELECT docno, profile, CAST(0.001 AS DOUBLE) AS utility, round(q, 8) AS profile_quality FROM pq SEMI JOIN un USING (docno)")
def tail_utility_lowbound(spark: SparkSession, d: str) -> DataFrame:
    return _tail(
        spark, d, utility.Tail("rbp_residual_interval", beta=None, low=0.001),
        utility.padding_quality(doc_vec(spark, d), PROFILES)
    )


@query(f"WITH {_CAND}, {_PROF}, {_UN}, pq AS (SELECT docno, profile, least(greatest(avg(1 / (1 + abs(list_inner_product(qvec, v) - list_inner_product(qvec[1:dimension], v[1:dimension])))), 0.0), 1.0) AS q FROM qv, dv, prof GROUP BY docno, profile) SELECT docno, profile, round(greatest(0.0, least(0.01, 0.005 / n) * q - 0.5 * (0.005 / n) * q), 8) AS utility, round(q, 8) AS profile_quality FROM pq SEMI JOIN un USING (docno), nu")
def tail_utility_sampled(spark: SparkSession, d: str) -> DataFrame:
    q = query_vec(spark, d)
    quality = utility.sampled_quality(doc_vec(spark, d), q, PROFILES, S.METRICS[1], n=q.count())
    return _tail(spark, d, utility.Tail("rbp_residual_interval", quality="sampled_dense_score_preservation"), quality)


_CHUNKS = "ch AS (SELECT docno, (row_number() OVER (ORDER BY docno) - 1) // 512 AS chunk FROM dv), sc AS (SELECT qid, docno, profile, chunk, list_inner_product(qvec, v) AS s, list_inner_product(qvec[1:dimension], v[1:dimension]) AS r FROM qv, dv JOIN ch USING (docno), prof)"
_CHUNK_NEG = """w1 AS (SELECT *, count(*) OVER (PARTITION BY qid, profile, chunk) AS n, row_number() OVER (PARTITION BY qid, profile, chunk ORDER BY s DESC, docno) AS ns, row_number() OVER (PARTITION BY qid, profile, chunk ORDER BY r DESC, docno) AS nr FROM sc),
ws AS (SELECT a.qid, a.docno, a.profile, avg(b.s) AS sn FROM w1 a JOIN w1 b ON b.qid = a.qid AND b.profile = a.profile AND b.chunk = a.chunk AND b.ns <= 5 AND b.docno <> a.docno AND b.ns - (CASE WHEN a.ns < b.ns THEN 1 ELSE 0 END) <= 4 GROUP BY a.qid, a.docno, a.profile),
wr AS (SELECT a.qid, a.docno, a.profile, avg(b.r) AS rn FROM w1 a JOIN w1 b ON b.qid = a.qid AND b.profile = a.profile AND b.chunk = a.chunk AND b.nr <= 5 AND b.docno <> a.docno AND b.nr - (CASE WHEN a.nr < b.nr THEN 1 ELSE 0 END) <= 4 GROUP BY a.qid, a.docno, a.profile),
w2 AS (SELECT * FROM w1 LEFT JOIN ws USING (qid, docno, profile) LEFT JOIN wr USING (qid, docno, profile))"""


@query(f"WITH {_DV}, {_PROF}, {_CHUNKS}, {_CHUNK_NEG} SELECT docno, profile, round(least(greatest(avg(CASE WHEN n <= 1 THEN 1.0 ELSE {_MAR} END), 0.0), 1.0), 5) AS profile_quality FROM w2 GROUP BY docno, profile")
def sampled_quality_margin(spark: SparkSession, d: str) -> DataFrame:
    q = query_vec(spark, d)
    return rounded(utility.sampled_quality(doc_vec(spark, d), q, PROFILES, S.METRICS[3], n=q.count()), "profile_quality", digits=5)


@query(f"WITH {_CAND}, c AS (SELECT count(*) AS n_pairs, count(DISTINCT docno) AS pair_docs, count(DISTINCT qid) AS pair_queries, CAST(0 AS BIGINT) AS overrides FROM cand), n AS (SELECT count(*) AS n_docs FROM dv) SELECT n_pairs, pair_docs, pair_queries, overrides, n_docs, n_docs - pair_docs AS default_docs, round((n_docs - pair_docs) / n_docs, 6) AS default_fraction FROM c, n")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(utility.coverage(doc_vec(spark, d).select("docno"), log_pairs(spark, d), log_means(spark, d)), "default_fraction")


# ---- the knapsack


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK} SELECT docno, profile, round(utility, 6) AS utility, cost_bytes FROM pick")
def lambda_assign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assigned(spark, d), "utility")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK} SELECT docno, profile FROM pick")
def online_choice(spark: SparkSession, d: str) -> DataFrame:
    return online.choose(doc_vec(spark, d), PROFILES, LAMBDA, 1).select("docno", "profile")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, lam(l) AS (VALUES {', '.join(f'({x})' for x in GRID)}), k AS (SELECT l, cost_bytes, utility, row_number() OVER (PARTITION BY l, docno ORDER BY utility - CAST(l AS DOUBLE) * cost_bytes DESC, idx) AS n FROM res, lam) SELECT CAST(l AS DOUBLE) AS lam, CAST(sum(cost_bytes) AS BIGINT) AS cost, round(sum(utility), 4) AS utility FROM k WHERE n = 1 GROUP BY l")
def lambda_curve(spark: SparkSession, d: str) -> DataFrame:
    got = knapsack.curve(wide(spark, d), GRID)
    return spark.createDataFrame([(x, c, round(float(u), 4)) for x, (c, u) in got.items()], "lam double, cost long, utility double")


@query(f"WITH {_DV}, {_PROF}, {_RES1} SELECT docno, profile, round(utility, 6) AS utility, cost_bytes FROM res WHERE idx = 0")
def cheapest_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = wide(spark, d)
    return rounded(knapsack.assignments(knapsack.cheapest(p).chosen, p), "utility")


_UPS = "ups AS (SELECT * FROM (SELECT p.docno, r.idx AS target, r.cost_bytes - p.cost_bytes AS extra, r.utility - p.utility AS gain, (r.utility - p.utility) / (r.cost_bytes - p.cost_bytes) AS ratio, row_number() OVER (PARTITION BY p.docno ORDER BY (r.utility - p.utility) / (r.cost_bytes - p.cost_bytes) DESC, r.utility - p.utility DESC, r.idx) AS n FROM pick p JOIN res r ON r.docno = p.docno AND r.cost_bytes > p.cost_bytes AND r.utility > p.utility) WHERE n = 1)"
_DOWNS = "downs AS (SELECT * FROM (SELECT p.docno, r.idx AS target, p.cost_bytes - r.cost_bytes AS saved, p.utility - r.utility AS loss, (p.utility - r.utility) / (p.cost_bytes - r.cost_bytes) AS ratio, row_number() OVER (PARTITION BY p.docno ORDER BY (p.utility - r.utility) / (p.cost_bytes - r.cost_bytes), p.utility - r.utility, p.cost_bytes - r.cost_bytes DESC, r.idx) AS n FROM pick p JOIN res r ON r.docno = p.docno AND r.cost_bytes < p.cost_bytes) WHERE n = 1)"


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK}, {_UPS} SELECT docno, target, extra, round(gain, 6) AS gain, round(ratio, 8) AS ratio FROM ups")
def upgrade_moves(spark: SparkSession, d: str) -> DataFrame:
    p = wide(spark, d)
    return rounded(rounded(knapsack.upgrade_moves(knapsack.at_lambda(p, LAMBDA), p), "gain"), "ratio", digits=8)


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK}, {_DOWNS} SELECT docno, target, saved, round(loss, 6) AS loss, round(ratio, 8) AS ratio FROM downs")
def downgrade_moves(spark: SparkSession, d: str) -> DataFrame:
    p = wide(spark, d)
    return rounded(rounded(knapsack.downgrade_moves(knapsack.at_lambda(p, LAMBDA), p), "loss"), "ratio", digits=8)


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK}, {_DOWNS}, o AS (SELECT CAST(sum(cost_bytes) AS BIGINT) // 10 AS over FROM pick), c AS (SELECT *, sum(saved) OVER (ORDER BY ratio, loss, saved DESC, docno, target ROWS UNBOUNDED PRECEDING) AS cum FROM downs) SELECT docno, target, saved FROM c, o WHERE cum - saved < over")
def downgrade_pass(spark: SparkSession, d: str) -> DataFrame:
    p = wide(spark, d)
    chosen = knapsack.at_lambda(p, LAMBDA)
    return knapsack.downgrade_pass(
        chosen, p, knapsack.candidate(chosen, p, LAMBDA, "at_lambda").cost // 10
    ).select("docno", "target", "saved")


@query(f"WITH RECURSIVE {_DV}, {_PROF}, {_RES1}, pick AS (SELECT * FROM res WHERE idx = 0), {_UPS}, m AS (SELECT docno, target, extra, row_number() OVER (ORDER BY ratio DESC, gain DESC, docno, target) AS n FROM ups), room AS (SELECT CAST(count(*) * 64 - count(*) * 16 AS BIGINT) AS r FROM dv), g AS (SELECT CAST(0 AS BIGINT) AS n, r, false AS took FROM room UNION ALL SELECT m.n, CASE WHEN m.extra <= g.r THEN g.r - m.extra ELSE g.r END, m.extra <= g.r FROM g JOIN m ON m.n = g.n + 1) SELECT docno, target FROM m JOIN g USING (n) WHERE took")
def upgrade_pass(spark: SparkSession, d: str) -> DataFrame:
    """Upgrades of the cheapest choice that fit half of the full budget."""
    p = wide(spark, d)
    base = knapsack.cheapest(p)
    taken, _, _ = knapsack.upgrade_round(knapsack.upgrade_moves(base.chosen, p), p.budget - base.cost)
    return taken


@query()
def optimize_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole solution at half of the full budget."""
    n = read(spark, d, "embeddings").count()
    return rounded(knapsack.solve(residuals(spark, d), PROFILES, n * 64).assignments, "utility")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK} SELECT count(*) AS n_docs, CAST(sum(cost_bytes) AS BIGINT) AS total_bytes, round(avg(cost_bytes), 6) AS mean_bytes, count(*) * 128 AS full_bytes, round(1 - sum(cost_bytes) / (count(*) * 128), 6) AS saved_fraction FROM pick")
def memory_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.memory_summary(assigned(spark, d), COSTS[-1]), "mean_bytes", "saved_fraction")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK} SELECT profile, count(*) AS n_docs, CAST(sum(cost_bytes) AS BIGINT) AS cost_bytes, round(sum(utility), 4) AS utility FROM pick GROUP BY profile")
def profile_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.profile_counts(assigned(spark, d)), "utility", digits=4)


@query(f"WITH {_DV}, {_PROF}, {_RES1} SELECT round(greatest(0.0001, (max(utility) - min(utility)) / 16), 9) AS lam FROM res")
def lambda_bound(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(knapsack.lambda_ceiling(wide(spark, d)), 9),)], "lam double")


@query(f"WITH {_DV}, {_PROF}, {_RES1}, lam(l) AS (VALUES {', '.join(f'({x})' for x in GRID)}), k AS (SELECT l, cost_bytes, utility, row_number() OVER (PARTITION BY l, docno ORDER BY utility - CAST(l AS DOUBLE) * cost_bytes DESC, idx) AS n FROM res, lam), c AS (SELECT CAST(l AS DOUBLE) AS lam, CAST(sum(cost_bytes) AS BIGINT) AS cost, sum(utility) AS utility FROM k WHERE n = 1 GROUP BY l), b AS (SELECT count(*) * 64 AS budget FROM dv) SELECT kind, lam, cost FROM (SELECT 'feasible' AS kind, lam, cost, row_number() OVER (ORDER BY utility DESC, cost DESC) AS n FROM c, b WHERE cost <= budget UNION ALL SELECT 'infeasible', lam, cost, row_number() OVER (ORDER BY cost, utility DESC) FROM c, b WHERE cost > budget) WHERE n = 1")
def candidate_policy(spark: SparkSession, d: str) -> DataFrame:
    """Of the choices at several multipliers, the best that fits the budget and the closest that doesn't."""
    p = wide(spark, d)
    every = [knapsack.candidate(knapsack.at_lambda(p, x), p, x, "grid") for x in GRID]
    best = far = None
    for c in every:
        if knapsack.better_feasible(c, best, p.budget):
            best = c
        if knapsack.better_infeasible(c, far, p.budget):
            far = c
    return spark.createDataFrame(
        [(k, c.lam, c.cost) for k, c in (("feasible", best), ("infeasible", far)) if c],
        "kind string, lam double, cost long"
    )


@query("SELECT CAST(536870912 AS BIGINT) AS from_gb, CAST(7 AS BIGINT) AS from_bytes")
def budgets(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(S.budget_bytes(None, 0.5), S.budget_bytes(7, 0.5))], "from_gb long, from_bytes long")


@query(f"WITH {_DV} SELECT CAST(0 AS BIGINT) AS n_pairs, CAST(0 AS BIGINT) AS pair_docs, CAST(0 AS BIGINT) AS pair_queries, CAST(0 AS BIGINT) AS overrides, count(*) AS n_docs, count(*) AS default_docs, CAST(1 AS DOUBLE) AS default_fraction FROM dv")
def coverage_without_pairs(spark: SparkSession, d: str) -> DataFrame:
    return utility.coverage(doc_vec(spark, d).select("docno"), log_pairs(spark, d).limit(0), log_means(spark, d).limit(0))


# ---- runs and measures

DEPTH = 100


def all_runs(spark: SparkSession, d: str) -> DataFrame:
    v = doc_vec(spark, d)
    dims = with_profiles(v.select("docno"), PROFILES).select("docno", "profile", "dimension")
    return dense.runs(query_vec(spark, d), v, PROFILES, assigned(spark, d).join(dims, ["docno", "profile"]), DEPTH, skip_self=True)


_RUNS = f"""{_DV}, {_PROF}, {_RES1}, {_PICK}, {_QRELS},
width AS (SELECT CASE WHEN profile = 'full' THEN 'full_run' ELSE 'profile_' || profile || '_run' END AS run, docno, dimension FROM dv, prof UNION ALL SELECT 'optimized_run', docno, dimension FROM pick),
rs AS (SELECT run, qid, docno, round(list_inner_product(qvec[1:dimension], v[1:dimension]), 9) AS score FROM width JOIN dv USING (docno), qv WHERE qid <> docno),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, docno) AS n FROM rs) WHERE n <= {DEPTH})"""
_MEASURES = """idl AS (SELECT qid, sum(CASE WHEN n <= 10 THEN label / log2(n + 1) ELSE 0 END) AS idcg, sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS r1, sum(CASE WHEN label >= 2 THEN 1 ELSE 0 END) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label DESC, docno) AS n FROM qrels) GROUP BY qid),
jj AS (SELECT rr.run, rr.qid, rr.docno, rr.n, q.label, CASE WHEN q.label >= 2 THEN 1 ELSE 0 END AS h2, sum(CASE WHEN q.label >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rr.run, rr.qid ORDER BY rr.n ROWS UNBOUNDED PRECEDING) AS c2, sum(CASE WHEN q.label >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rr.run, rr.qid ORDER BY rr.n ROWS UNBOUNDED PRECEDING) AS c1 FROM rr LEFT JOIN qrels q ON q.qid = rr.qid AND q.docno = rr.docno),
gg AS (SELECT run, qid, sum(CASE WHEN n <= 10 THEN coalesce(label, 0) / log2(n + 1) ELSE 0 END) AS dcg, sum(CASE WHEN h2 = 1 THEN c2 / n ELSE 0 END) AS ap, sum(CASE WHEN label >= 1 THEN c1 / n ELSE 0 END) AS ap1, min(CASE WHEN label >= 1 THEN n END) AS fa, min(CASE WHEN label >= 2 THEN n END) AS f2, min(CASE WHEN label >= 1 AND n <= 10 THEN n END) AS f1, sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) AS top FROM jj GROUP BY run, qid),
ev AS (SELECT run, qid, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg10, CASE WHEN r2 > 0 THEN ap / r2 ELSE 0 END AS ap_rel2, coalesce(1 / f2, 0) AS rr_rel2, coalesce(1 / f1, 0) AS rr10, CASE WHEN r1 > 0 THEN top / r1 ELSE 0 END AS recall100, CASE WHEN r1 > 0 THEN ap1 / r1 ELSE 0 END AS map, coalesce(1 / fa, 0) AS recip_rank FROM gg JOIN idl USING (qid))"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_query(all_runs(spark, d), qrels_dense(spark, d))


for _m in evaluation.MEASURES:

    def _measure(spark: SparkSession, d: str, m: str = _m) -> DataFrame:
        return measured(spark, d).select("run", "qid", F.round(m, 6).alias(m))

    _measure.__name__ = _m
    query(f"WITH {_RUNS}, {_MEASURES} SELECT run, qid, round({_m}, 6) AS {_m} FROM ev")(_measure)


@query(f"WITH {_RUNS}, {_MEASURES}, l AS (UNPIVOT ev ON ndcg10, ap_rel2, rr_rel2, rr10, recall100, map, recip_rank INTO NAME metric VALUE value), p AS (SELECT a.run, a.metric, a.value, a.value - b.value AS d FROM l a JOIN l b ON b.qid = a.qid AND b.metric = a.metric AND b.run = 'full_run') SELECT run, metric, round(avg(value), 4) AS mean, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses, CASE WHEN stddev_samp(d) > 1e-12 THEN round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) END AS t, count(*) AS n FROM p GROUP BY run, metric")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(evaluation.compare(measured(spark, d), "full_run"), "mean", digits=4), "t", digits=5)


@query(f"WITH {_RUNS}, {_MEASURES} SELECT run, {', '.join(f'round(avg({m}), 4) AS {m}' for m in evaluation.MEASURES)} FROM ev GROUP BY run")
def run_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.means(measured(spark, d))


@query(f"WITH {_DV}, {_PROF}, {_RES1}, {_PICK} SELECT CAST(sum(cost_bytes) AS BIGINT) AS total_bytes, CAST(count(*) * 60 AS BIGINT) AS budget_bytes, sum(cost_bytes) <= count(*) * 60 AS fits, CAST(greatest(sum(cost_bytes) - count(*) * 60, 0) AS BIGINT) AS missing_bytes FROM pick")
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    return dense.fits(assigned(spark, d), read(spark, d, "embeddings").count() * 60)


@query(f"WITH {_CAND}, {_PROF}, {_UN}, {_PQ}, t AS (SELECT profile, q, greatest(0.0, least(0.01, 0.005 / n) * q - 0.5 * (0.005 / n) * q) AS u FROM pq SEMI JOIN un USING (docno), nu) SELECT (SELECT n FROM nu) AS unranked, profile, round(avg(q), 6) AS mean_quality, (SELECT round(max(u), 8) FROM t) AS max_utility, (SELECT round(avg(u), 8) FROM t) AS mean_utility FROM t GROUP BY profile")
def tail_report(spark: SparkSession, d: str) -> DataFrame:
    v, tail = doc_vec(spark, d), utility.Tail("rbp_residual_interval")
    unranked = v.select("docno").join(candidates(spark, d).select("docno"), "docno", "left_anti")
    scored = kept(utility.tail_utility(unranked, v, utility.padding_quality(v, PROFILES), tail))
    r = utility.tail_report(tail, scored, unranked.count())
    rows = [
        (r["tail_unranked_docs"], p, round(q, 6), round(r["tail_utility_max"], 8), round(r["tail_utility_mean"], 8)) for p,
        q in r["tail_profile_quality_mean_by_profile"].items()
    ]
    return spark.createDataFrame(rows, "unranked long, profile string, mean_quality double, max_utility double, mean_utility double")


@query()
def run_significance(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.significance(evaluation.compare(measured(spark, d), "full_run"), "full_run")


@query(f"WITH {_RUNS}, {_MEASURES}, m AS (SELECT run, avg(ndcg10) AS ndcg10, avg(recall100) AS recall100 FROM ev GROUP BY run) SELECT metric, run, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC, run) AS n FROM (UNPIVOT m ON ndcg10, recall100 INTO NAME metric VALUE value)) WHERE n = 1")
def ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).groupBy("run").agg(
        F.round(F.avg("ndcg10"), 9).alias("ndcg10"), F.round(F.avg("recall100"), 9).alias("recall100")
    )
    return rounded(reporting.ranking_summary(reporting.to_long(m, ["run"], ["ndcg10", "recall100"]), ("run",)), "value")


@query()
def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    return dense.lsh_search(query_vec(spark, d), full_corpus(spark, d), K, skip_self=True)


@query()
def ann_ivf(spark: SparkSession, d: str) -> DataFrame:
    return dense.ivf_search(query_vec(spark, d), full_corpus(spark, d), K, skip_self=True)


@query("SELECT * FROM (VALUES ('bm25_run', 0), ('full_run', 1), ('profile_d32_run', 2), ('profile_d16_run', 3), ('profile_d8_run', 4), ('optimized_run', 5)) t(run, run_order)")
def run_order(spark: SparkSession, d: str) -> DataFrame:
    """A lexical baseline comes first, then the full width, then profiles from the widest."""
    v = doc_vec(spark, d)
    dims = with_profiles(v.select("docno"), PROFILES).select("docno", "profile", "dimension")
    runs = dense.runs(
        query_vec(spark, d), v, PROFILES, assigned(spark, d).join(dims, ["docno", "profile"]), 1, skip_self=True,
        bm25=candidates(spark, d)
    )
    return runs.select("run", "run_order").distinct()


# ---- readers and writers: a table is written to the shared folder, and read by the reader


def _tsv(spark: SparkSession, df: DataFrame) -> str:
    to = folder(spark)
    df.write.csv(to, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="")
    return to


@query("SELECT CAST(item_id AS VARCHAR) AS qid, regexp_replace(text, '\\s+', ' ', 'g') AS query FROM benchmark")
def read_topics(spark: SparkSession, d: str) -> DataFrame:
    """A topic is a line."""
    return tables.topics(spark, _tsv(spark, read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_replace("text", r"\s+", " ").alias("title"))), "title")


@query("SELECT CAST(toxic AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docno, CAST(quality AS INTEGER) AS label FROM labels WHERE doc_id % 7 <> 0")
def read_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that aren't numbers are left out."""
    rows = read(spark, d, "labels").select(
        F.col("toxic").alias("qid"), F.col("doc_id").alias("docno"),
        F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise(F.col("quality").cast("string")).alias("rel")
    )
    return tables.qrels(spark, _tsv(spark, rows), "rel")


@query("SELECT CAST(item_id AS VARCHAR) AS qid, regexp_replace(text, '\\s+', ' ', 'g') AS query FROM benchmark ORDER BY CAST(item_id AS VARCHAR) LIMIT 7")
def read_first_topics(spark: SparkSession, d: str) -> DataFrame:
    return tables.topics(
        spark,
        _tsv(spark, read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_replace("text", r"\s+", " ").alias("query"))),
        max_queries=7
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS qid, CAST(quality AS VARCHAR) AS docno, CAST(toxic AS INTEGER) AS label FROM labels SEMI JOIN benchmark ON doc_id = item_id")
def qrels_of_topics(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").alias("docno"), F.col("toxic").alias("label"))
    return tables.qrels(spark, _tsv(spark, rows), of=text_topics(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS docno, regexp_replace(concat_ws(chr(10), CASE WHEN regexp_replace(lang, '^\\s+|\\s+$', '', 'g') <> '' THEN lang END, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN text END), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def read_corpus(spark: SparkSession, d: str) -> DataFrame:
    return tables.corpus(spark, f"{d}/documents.parquet", ("lang", "text"), "doc_id")


@query("SELECT name, rows FROM (SELECT 'topics' AS name, count(*) AS rows FROM benchmark UNION ALL SELECT 'qrels', 0 UNION ALL SELECT 'corpus', count(*) FROM documents)")
def read_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A named source without judgements has none."""
    c = tables.Catalog()
    c.register("own", "topics", lambda s: text_topics(s, d))
    c.register("own", "corpus", lambda s: text_corpus(s, d))
    counted = [c.load(spark, "own", kind).agg(F.count("*").alias("rows")).select(F.lit(kind).alias("name"), "rows") for kind in ("topics", "qrels", "corpus")]
    return counted[0].union(counted[1]).union(counted[2])


@query("SELECT CAST(vec_id AS VARCHAR) AS docno, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def read_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written in files of a bounded size, scanned and checked."""
    to = folder(spark)
    sinks.save_vectors(doc_vec(spark, d), to, 1)
    v = tables.vectors(spark, to, width=64, expected=doc_vec(spark, d))
    return v.select("docno", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def read_triplets(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    read(spark, d, "conversations").write.json(to)
    return tables.triplets(spark, to).select("conv_id", "turn", "role", "text")


@query("SELECT CAST(p_partkey AS DOUBLE) AS step, CAST(p_size AS DOUBLE) AS epoch, p_retailprice AS loss, CAST(NULL AS DOUBLE) AS learning_rate, CAST(NULL AS DOUBLE) AS grad_norm FROM part")
def read_trainer_log(spark: SparkSession, d: str) -> DataFrame:
    row = F.to_json(
        F.named_struct(
            F.lit("step"), "p_partkey", F.lit("epoch"), F.col("p_size").cast("double"), F.lit("loss"),
            F.col("p_retailprice").cast("string"), F.lit("grad_norm"), F.lit("none yet")
        )
    )
    log = read(spark, d, "part").agg(
        F.concat(F.lit('{"global_step": 3, "log_history": ['), F.array_join(F.collect_list(row), ",\n"), F.lit("]}"))
    ).first()[0]  # a log is a small file
    to = f"{folder(spark)}/trainer_state.json"
    sinks.save_text(spark, log, to)
    return tables.trainer_log(spark, to)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey < 2 THEN CAST(n_regionkey AS VARCHAR) END AS n_regionkey FROM nation")
def read_result_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of different columns in folders of their own, united."""
    to = folder(spark)
    n = read(spark, d, "nation")
    sinks.save(n.where("n_regionkey < 2").select("n_nationkey", "n_name", "n_regionkey"), f"{to}/a/b/results.csv", "csv")
    sinks.save(n.where("n_regionkey >= 2").select("n_name", "n_nationkey"), f"{to}/c/results.csv", "csv")
    return tables.result_files(spark, to, "*.csv")[0].select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents UNION ALL SELECT 'parquet', lang, CAST(count(*) AS VARCHAR) FROM documents GROUP BY lang")
def write_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table written twice to one place as CSV, then as parquet, and read again."""
    to, t = folder(spark), read(spark, d, "documents").select("doc_id", "lang", "source")
    sinks.save(t.limit(1), f"{to}/t.csv", "csv")
    sinks.save(t, f"{to}/t.csv", "csv")
    sinks.save(t, f"{to}/t.parquet", rows_per_file=100)
    by = spark.read.parquet(f"{to}/t.parquet").groupBy("lang").agg(F.count("*").cast("string").alias("n")).select(
        F.lit("parquet").alias("doc_id"), "lang", "n"
    )
    return spark.read.csv(f"{to}/t.csv", header=True).union(by)


@query("SELECT 'n_docs' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'mean', round(avg(n_chars), 6) FROM documents UNION ALL SELECT 'full', 64")
def write_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary as JSON and a configuration as YAML, read again."""
    from lumenspan.sources import config

    to = folder(spark)
    r = read(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.round(F.avg("n_chars"), 6).alias("mean")).first()
    sinks.save_json(spark, r.asDict(), f"{to}/summary.json")
    raw = {
        "data": {"pyterrier_dataset": "own"},
        "profiles": [{"name": p.name, "dimension": p.dimension} for p in PROFILES],
        "optimization": {"budget_bytes": 1000}
    }
    sinks.save_config(spark, config.parse(raw), f"{to}/config_snapshot.yaml")
    again = config.parse(config.read_yaml("\n".join(x["value"] for x in spark.read.text(f"{to}/config_snapshot.yaml").collect())))
    got = spark.read.json(f"{to}/summary.json", multiLine=True).select(
        F.col("n_docs").cast("double").alias("n_docs"), "mean"
    ).unpivot([], ["n_docs", "mean"], "name", "value")
    return got.union(
        spark.createDataFrame(
            [(p.name, float(p.dimension)) for p in again.profiles if p.name == again.model.full_profile_name],
            "name string, value double"
        )
    )


@query(f"WITH {_RUNS}, {_MEASURES}, m AS (SELECT run, avg(ndcg10) AS ndcg10, avg(recall100) AS recall100 FROM ev GROUP BY run) SELECT 'wide' AS file, run, CAST(ndcg10 AS VARCHAR) IS NOT NULL AS there, round(ndcg10, 6) AS ndcg10, round(recall100, 6) AS recall100 FROM m")
def write_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The result files of a benchmark; the wide one read again."""
    to = folder(spark)
    m = measured(spark, d).groupBy("run").agg(F.avg("ndcg10").alias("ndcg10"), F.avg("recall100").alias("recall100"))
    long = reporting.to_long(
        m.withColumns({"model_id": F.col("run"), "dimension": F.lit(64)}), ["model_id", "dimension"],
        ["ndcg10", "recall100"]
    )
    sinks.save_benchmark(kept(long), ["model_id", "dimension"], ["ndcg10", "recall100"], to, {"k": DEPTH})
    wide = spark.read.csv(f"{to}/metrics_wide.csv", header=True, inferSchema=True)
    return wide.select(
        F.lit("wide").alias("file"), F.col("model_id").alias("run"), F.lit(True).alias("there"),
        F.round("ndcg10", 6).alias("ndcg10"), F.round("recall100", 6).alias("recall100")
    )


@query("SELECT CAST(item_id AS VARCHAR) AS qid, 16 AS width FROM benchmark UNION ALL SELECT store, n FROM (VALUES ('own_queries__hashing-16', 0)) t(store, n)")
def encoding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of queries in a store named after the model, made in chunks; then one chunk is lost and made again."""
    e = encoding.HashingEncoder(16)
    store = encoding.store_name("own", "queries", e.name)
    to, key, topics = f"{folder(spark)}/{store}", encoding.context(model=e.name, role="queries"), text_topics(spark, d)
    made = lambda: encoding.cached(spark, to, key, topics, lambda x: encoding.encode(x, "qid", "query", e), "qid", chunks=3)
    made()
    fs, at = encoding._folder(spark, f"{to}/{key}/chunk-0001-of-0003")
    fs.delete(at, True)
    return made().select("qid", F.size("v").alias("width")).union(spark.createDataFrame([(store, 0)], "qid string, width int"))


# ---- reporting and training data


@query("SELECT l_returnflag, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY l_returnflag")
def metrics_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("metric"), F.col("l_quantity").alias("value"))
    return reporting.to_wide(t, ["l_returnflag"], ["F", "O"])


@query("SELECT l_orderkey, l_linenumber, metric, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem) UNPIVOT (value FOR metric IN (l_quantity, l_extendedprice))")
def metrics_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return reporting.to_long(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query("SELECT l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_linestatus")
def describe_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.describe(read(spark, d, "lineitem"), "l_quantity", ["l_linestatus"]), "mean", "std", "p10", "p50", "p90")


@query("SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS VARCHAR) AS note FROM documents UNION ALL SELECT doc_id, NULL, CAST(quality AS VARCHAR), NULL FROM labels")
def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    return reporting.canonical_union(
        [
            read(spark, d, "documents").select("doc_id", "lang", "source"),
            read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), "toxic")
        ],
        ["doc_id", "lang", "quality", "note"]
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Nested training rows: what a user says, the assistant's turns after it as positives, the system's as negatives."""
    c = read(spark, d, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("query"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("text")))).alias("positive_passages"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "assistant", F.struct("text")))).alias("negative_passages")
    )
    return c.where("query IS NOT NULL")


@query("WITH q AS (SELECT conv_id, max_by(text, turn) AS anchor FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT anchor, p.text AS positive, n.text AS negative FROM q JOIN conversations p ON p.conv_id = q.conv_id AND p.role = 'assistant' JOIN conversations n ON n.conv_id = q.conv_id AND n.role <> 'assistant'")
def triplets_nested(spark: SparkSession, d: str) -> DataFrame:
    return training.nested(turns(spark, d))


@query("SELECT role AS anchor, text AS positive, CAST(conv_id AS VARCHAR) AS negative FROM conversations")
def triplet_columns(spark: SparkSession, d: str) -> DataFrame:
    return training.normalize(
        read(spark, d, "conversations").withColumn("conv_id", F.col("conv_id").cast("string")), "role", "text",
        "conv_id"
    )


@query("SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '') AS n_blank FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR regexp_replace(source, '^\\s+|\\s+$', '', 'g') = '') FROM documents")
def triplets_validate(spark: SparkSession, d: str) -> DataFrame:
    return training.blanks(read(spark, d, "documents").select("text", "source"))


@query("SELECT min(doc_id) AS doc_id, 'text' AS \"column\" FROM documents WHERE text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' HAVING count(*) > 0")
def first_blank(spark: SparkSession, d: str) -> DataFrame:
    return training.first_blank(read(spark, d, "documents").select("doc_id", "text"), "doc_id")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The smallest whole experiment: residual utilities, the optimal assignment at half of the budget, all runs, their measures. A
    row per run.
    """
    v, n = doc_vec(spark, d), read(spark, d, "embeddings").count()
    solved = knapsack.solve(residuals(spark, d), PROFILES, n * 64).assignments
    dims = with_profiles(v.select("docno"), PROFILES).select("docno", "profile", "dimension")
    runs = dense.runs(query_vec(spark, d), v, PROFILES, solved.join(dims, ["docno", "profile"]), DEPTH, skip_self=True)
    return evaluation.means(evaluation.per_query(runs, qrels_dense(spark, d)))


QUERIES["run_summary"] = run_summary
