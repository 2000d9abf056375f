"""Registered queries over the driver's tables, each with SQL that gives the same rows.

How the tables stand in: a document is a chunk (chunk_id = its doc_id) whose document is its source; embeddings belong to
the documents with vec_id = doc_id (other documents have none, and are found by their words alone); a benchmark passage
is a query. By its number modulo 3 it is asked in words as its first two tokens, as a phrase of these and its third
token, or as all its tokens; sparse weights are of all its tokens, its vector is that of vec_id = item_id. Judgements are
arithmetic on the query's number. Events play logs: their type is a state, a phase or a kind of feedback.

The corpus is indexed once for a session and folder, in the shared folder, and again where a table's files are others; all
searches read that index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS
from quillon.functions import text as T
from quillon.operators import context, lifecycle, markdown, metadata, metrics, verification
from quillon.operators.dense import dense_topk, sparse_coverage, sparse_rank
from quillon.operators.fusion import candidate_pool, document_cap, document_mmr, weighted_rrf
from quillon.plans.retrieval import Corpus, expand_queries, explain, hybrid_search, index_corpus, merge_variants, own_texts, read_corpus, rerank, run_variant
from quillon.providers import overlap_score
from quillon.runtime import shared_folder, written
from quillon.sources.log import delete, stamp
from quillon.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few input splits dealt out over all cores before costly per-row work; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", "lang")


#: By application and folder: what the tables were when the index was written, and where it is.
_CORPORA: dict[tuple[str, str], tuple[tuple, str]] = {}


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs, "chunk_id")


def _corpus(spark: SparkSession, d: str) -> Corpus:
    """The index of a folder's tables as they are now: written anew, and the old one deleted, where a file's name, size or time is another."""
    key = (spark.sparkContext.applicationId, d)
    now = tuple(stamp(spark, f"{d}/{name}.parquet") for name in ("documents", "embeddings"))
    then, root = _CORPORA.get(key, (None, None))
    if then != now:
        if root is not None:
            delete(spark, root)
        root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        index_corpus(spark, _chunks(spark, d), _vectors(spark, d), root)
        _CORPORA[key] = (now, root)
    return read_corpus(spark, root)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), T.tokens(F.col("text")).alias("t"))
    text = F.when(F.col("qid") % 3 == 0, F.array_join(F.slice("t", 1, 2), " ")).when(F.col("qid") % 3 == 1, F.concat_ws(" ", F.array_join(F.slice("t", 1, 2), "-"), F.get("t", F.lit(2)))).otherwise(F.array_join("t", " "))
    return items.select("qid", text.alias("text")).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid", "left")


def _query_sparse(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(T.tokens(F.col("text"))).alias("token"))
    return each.groupBy("qid", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _hybrid(spark: SparkSession, d: str, diversity: str = "off", **more: object) -> DataFrame:
    return hybrid_search(_corpus(spark, d), _queries(spark, d), _query_sparse(spark, d), diversity=diversity, **more)


def _en(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the filter lets through: those with an even number."""
    return _chunks(spark, d).where(F.pmod(F.substring("doc_id", 4, 9).cast("int"), F.lit(2)) == 0).select("doc_id").distinct()


_TOK = """
tok AS (SELECT doc_id AS chunk_id, source AS doc_id, lang, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents),
len AS (SELECT chunk_id, doc_id, len(t) AS n FROM tok), stat AS (SELECT count(*) AS n, avg(n) AS a FROM len),
term AS (SELECT chunk_id, unnest(t) AS w FROM tok), tf AS (SELECT chunk_id, w, count(*) AS tf FROM term GROUP BY ALL),
item AS (SELECT item_id AS qid, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
asked AS (SELECT qid, CASE qid % 3 WHEN 0 THEN t[1:2] WHEN 1 THEN t[1:3] ELSE t END AS w FROM item)"""
_BM25 = (
    _TOK
    + """,
ph AS (SELECT qid, i AS no, [w[i]] AS p FROM (SELECT qid, w, unnest(range(1, len(w) + 1)) AS i FROM asked WHERE qid % 3 <> 1)
  UNION ALL SELECT qid, 1, w[1:2] FROM asked WHERE qid % 3 = 1 AND len(w) > 0 UNION ALL SELECT qid, 2, [w[3]] FROM asked WHERE qid % 3 = 1 AND len(w) > 2),
ask AS (SELECT qid, no, len(p) AS n, count(*) OVER (PARTITION BY qid) AS m, p FROM ph), part AS (SELECT qid, no, n, m, unnest(range(0, n)) AS j, unnest(p) AS w FROM ask),
occ AS (SELECT chunk_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM tok),
place AS (SELECT qid, no, m, chunk_id, i - j AS s FROM part JOIN occ USING (w) WHERE n > 1 GROUP BY qid, no, n, m, chunk_id, s HAVING count(*) = n),
hit AS (SELECT qid, m, no, chunk_id, tf FROM part JOIN tf USING (w) WHERE n = 1 UNION ALL SELECT qid, m, no, chunk_id, count(*) FROM place GROUP BY ALL), df AS (SELECT qid, no, count(*) AS df FROM hit GROUP BY ALL),
bm AS (SELECT qid, chunk_id, len.doc_id, sum((CASE WHEN ln((stat.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((stat.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / a))) AS s
  FROM hit JOIN df USING (qid, no) JOIN len USING (chunk_id), stat GROUP BY qid, chunk_id, len.doc_id, m HAVING count(*) = m)"""
)
_DENSE = """
vec AS (SELECT vec_id AS chunk_id, source AS doc_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON vec_id = doc_id),
qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
sim AS (SELECT qid, chunk_id, doc_id, list_cosine_similarity(qv.e, vec.e) AS s FROM qv, vec)"""
_ODD = "doc_id IN (SELECT source FROM documents WHERE CAST(substr(source, 4) AS INT) % 2 = 0)"


def _ranked(name: str, source: str, score: str, k: int, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, chunk_id) AS rk FROM {source} WHERE {where}) WHERE rk <= {k})"


_K = DEFAULTS.candidate_multiplier * DEFAULTS.top_k
_FUSED = (
    f"WITH {_BM25}, {_DENSE}, {_ranked('d', 'sim', 's', _K)}, {_ranked('b', 'bm', 's', _K)}"
    """,
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS pool_pos FROM (
  SELECT coalesce(d.qid, b.qid) AS qid, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, coalesce(d.doc_id, b.doc_id) AS doc_id, d.rk AS dense_rank, b.rk AS bm25_rank FROM d FULL JOIN b ON d.qid = b.qid AND d.chunk_id = b.chunk_id)),
qs AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(t) AS w FROM item) GROUP BY ALL),
dot AS (SELECT pool.qid, pool.chunk_id, sum(CAST(qs.c AS DOUBLE) * tf.tf) AS x FROM pool JOIN qs USING (qid) JOIN tf ON tf.chunk_id = pool.chunk_id AND tf.w = qs.w GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sparse_score DESC, pool_pos) AS sparse_rank FROM (SELECT pool.*, coalesce(x, 0.0) AS sparse_score FROM pool LEFT JOIN dot USING (qid, chunk_id))),
sc AS (SELECT *, coalesce(1.0::DOUBLE / (20 + dense_rank), 0) + coalesce(1.0::DOUBLE / (20 + bm25_rank), 0) + coalesce(0.25::DOUBLE / (20 + sparse_rank), 0) AS rrf_score FROM sp),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score, 12) DESC, coalesce(dense_rank, 2147483647), coalesce(bm25_rank, 2147483647), coalesce(sparse_rank, 2147483647), chunk_id) AS rrf_rank FROM sc) WHERE rrf_rank <= 50),
adj AS (SELECT *, 0.6::DOUBLE * rrf_score / max(rrf_score) OVER (PARTITION BY qid) - 0.4::DOUBLE * CASE WHEN row_number() OVER (PARTITION BY qid, doc_id ORDER BY rrf_rank) > 1 THEN 1 ELSE 0 END AS adj FROM rr),
mmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(adj, 12) DESC, rrf_rank) AS final_pos FROM adj)"""
)
_JUDGED = ", judged AS (SELECT item_id AS qid, 'src' || CAST(item_id * 7 % 20 AS VARCHAR) AS doc_id, 3 AS grade FROM benchmark UNION ALL SELECT item_id, 'src' || CAST((item_id * 7 + 3) % 20 AS VARCHAR), 1 FROM benchmark)"


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    of = lambda shift: F.concat(F.lit("src"), F.pmod(F.col("qid") * 7 + shift, F.lit(20)).cast("string"))
    return q.select("qid", of(0).alias("doc_id"), F.lit(3).alias("grade")).union(q.select("qid", of(3).alias("doc_id"), F.lit(1).alias("grade")))


# -- lexical


@register(f"WITH {_TOK} SELECT lang, count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens, max(len(t)) AS longest FROM tok GROUP BY lang")
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    return _chunks(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("long").alias("n_tokens"), F.max(n).cast("long").alias("longest"))


@register(f"WITH {_TOK} SELECT w AS term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY w")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).lexical.terms


@register(f"WITH {_BM25}, {_ranked('r', 'bm', 's', 30)} SELECT qid, chunk_id, doc_id, round(s, 6) AS bm25_score, rk AS bm25_rank FROM r")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).lexical.search(_queries(spark, d), 30).withColumn("bm25_score", F.round("bm25_score", 6))


@register(f"WITH {_BM25}, {_ranked('r', 'bm', 's', 30, _ODD)} SELECT qid, chunk_id, doc_id, round(s, 6) AS bm25_score, rk AS bm25_rank FROM r")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).lexical.search(_queries(spark, d), 30, _en(spark, d)).withColumn("bm25_score", F.round("bm25_score", 6))


# -- dense, sparse, fusion


@register(f"WITH {_DENSE}, {_ranked('r', 'sim', 's', 20)} SELECT qid, chunk_id, doc_id, greatest(0, round(s, 6)) AS dense_score, rk AS dense_rank FROM r")
def dense_top(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(_vectors(spark, d), _queries(spark, d), 20).select("qid", "chunk_id", "doc_id", "dense_score", "dense_rank")


@register(f"WITH {_DENSE}, {_ranked('r', 'sim', 's', 20, _ODD)} SELECT qid, chunk_id, doc_id, greatest(0, round(s, 6)) AS dense_score, rk AS dense_rank FROM r")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(_vectors(spark, d), _queries(spark, d), 20, _en(spark, d)).select("qid", "chunk_id", "doc_id", "dense_score", "dense_rank")


@register(f"{_FUSED} SELECT qid, chunk_id, pool_pos, sparse_score, sparse_rank FROM sp")
def sparse_rescore(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    corpus = _corpus(spark, d)
    pool = candidate_pool(dense_topk(corpus.vectors, q, _K), corpus.lexical.search(q, _K))
    return sparse_rank(pool, _query_sparse(spark, d), corpus.sparse).select("qid", "chunk_id", "pool_pos", "sparse_score", "sparse_rank")


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, round(rrf_score, 9) AS rrf_score, rrf_rank FROM rr")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("qid", "chunk_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"), "rrf_rank")


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, rrf_rank, row_number() OVER (PARTITION BY qid ORDER BY rrf_rank) AS final_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rrf_rank) AS k FROM rr) WHERE k <= 3")
def hybrid_cap(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "cap").select("qid", "chunk_id", "doc_id", "rrf_rank", "final_pos")


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, round(rrf_score, 9) AS rrf_score, rrf_rank, round(adj, 6) AS mmr_score, final_pos, final_pos <> rrf_rank AS was_mmr_reordered FROM mmr")
def hybrid_mmr(spark: SparkSession, d: str) -> DataFrame:
    cols = ("qid", "chunk_id", "doc_id", "rrf_score", "rrf_rank", "mmr_score", "final_pos", "was_mmr_reordered")
    return _hybrid(spark, d, "mmr").withColumn("rrf_score", F.round("rrf_score", 9)).select(*cols)


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, final_pos, rrf_rank, dense_rank, bm25_rank, sparse_rank, dense_rank IS NOT NULL AS in_dense_topk, bm25_rank IS NOT NULL AS in_bm25_topk, sparse_rank IS NOT NULL AS in_sparse_topk, final_pos <> rrf_rank AS was_mmr_reordered FROM mmr")
def explain_ranks(spark: SparkSession, d: str) -> DataFrame:
    return explain(_hybrid(spark, d, "mmr"))


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, rrf_rank AS final_pos FROM (SELECT qid, chunk_id, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(1.0::DOUBLE / (20 + rk), 12) DESC, rk, chunk_id) AS rrf_rank FROM d) WHERE rrf_rank <= 50")
def variant_dense(spark: SparkSession, d: str) -> DataFrame:
    return run_variant("dense", _corpus(spark, d), _queries(spark, d)).select("qid", "chunk_id", "doc_id", "final_pos")


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, f AS final_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1.0::DOUBLE / (20 + dense_rank), 0) + coalesce(1.0::DOUBLE / (20 + bm25_rank), 0), 12) DESC, coalesce(dense_rank, 2147483647), coalesce(bm25_rank, 2147483647), chunk_id) AS f FROM pool) WHERE f <= 50")
def variant_dense_bm25(spark: SparkSession, d: str) -> DataFrame:
    return run_variant("dense_bm25", _corpus(spark, d), _queries(spark, d)).select("qid", "chunk_id", "doc_id", "final_pos")


@register("SELECT avg(CASE WHEN vec_id IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(True).alias("has"))
    return sparse_coverage(_chunks(spark, d).join(have, "chunk_id", "left"), "has")


@register(
    f"{_FUSED}, top AS (SELECT * FROM mmr WHERE final_pos <= 20), q AS (SELECT qid, list_distinct(w) AS w FROM asked), s AS (SELECT top.qid, top.chunk_id, final_pos, CASE WHEN len(w) > 0 THEN len(list_intersect(w, t)) / len(w)::DOUBLE ELSE 0 END AS s FROM top JOIN q USING (qid) JOIN tok USING (chunk_id))"
    " SELECT qid, chunk_id, round(s, 6) AS rerank_score, p AS rerank_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, final_pos) AS p FROM s) WHERE p <= 8"
)
def rerank_stage(spark: SparkSession, d: str) -> DataFrame:
    found = _hits(spark, d)
    hits = found.join(_queries(spark, d).select("qid", F.col("text").alias("question")), "qid").join(own_texts(found, _chunks(spark, d)), "chunk_id")
    out = rerank(hits, overlap_score(F.col("question"), F.col("text")), top_k=DEFAULTS.rerank_top_k)
    return out.select("qid", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_pos")


# -- metrics

_POS = ", h AS (SELECT qid, chunk_id, doc_id, final_pos AS pos, dense_rank, bm25_rank, sparse_rank FROM mmr)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all queries, written once for all measures that read them; so building such a query searches."""
    return written(_hybrid(spark, d, "mmr"), "hits").withColumn("pos", F.col("final_pos"))


@register(
    f"{_FUSED}{_JUDGED}{_POS}, rel AS (SELECT qid, count(*) AS n FROM judged GROUP BY qid), g AS (SELECT h.*, CASE WHEN row_number() OVER (PARTITION BY qid, doc_id ORDER BY pos) = 1 THEN coalesce(grade, 0) ELSE 0 END AS grade, coalesce(grade, 0) AS any_grade FROM h LEFT JOIN judged USING (qid, doc_id)),"
    " ideal AS (SELECT qid, 3 / log2(2) + 1 / log2(3) AS i FROM rel)"
    " SELECT qid, round(count(DISTINCT CASE WHEN any_grade > 0 AND pos <= 5 THEN doc_id END) / any_value(n)::DOUBLE, 6) AS recall5, round(count(DISTINCT CASE WHEN any_grade > 0 AND pos <= 10 THEN doc_id END) / any_value(n)::DOUBLE, 6) AS recall10,"
    " round(coalesce(1.0::DOUBLE / min(CASE WHEN any_grade > 0 THEN pos END), 0), 6) AS mrr, round(sum(CASE WHEN pos <= 10 THEN grade / log2(pos + 1) ELSE 0 END) / any_value(i), 6) AS ndcg10 FROM g JOIN rel USING (qid) JOIN ideal USING (qid) GROUP BY qid"
)
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    hits, judged = _hits(spark, d), _judgements(spark, d)
    r5, r10 = (metrics.recall_at(hits, judged, k).withColumnRenamed("recall", f"recall{k}") for k in (5, 10))
    out = r5.join(r10, "qid").join(metrics.reciprocal_rank(hits, judged), "qid").join(metrics.ndcg_at(metrics.grade(hits, judged), judged, 10), "qid")
    return out.select("qid", *[F.round(c, 6).alias(n) for c, n in (("recall5", "recall5"), ("recall10", "recall10"), ("mrr", "mrr"), ("ndcg", "ndcg10"))])


@register(f"{_FUSED}{_POS} SELECT qid, round(avg((dense_rank IS NOT NULL)::INT), 6) AS dense_coverage, round(avg((bm25_rank IS NOT NULL)::INT), 6) AS bm25_coverage, round(avg((sparse_rank IS NOT NULL)::INT), 6) AS sparse_coverage FROM h GROUP BY qid")
def signal_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.signal_coverage(_hits(spark, d), ["qid"])
    return out.select("qid", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register(f"{_FUSED}{_POS} SELECT qid, count(*) AS unique_docs, max(n) AS max_chunks_same_doc FROM (SELECT qid, doc_id, count(*) AS n FROM h WHERE pos <= 5 GROUP BY ALL) GROUP BY qid")
def diversity_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.diversity_stats(_hits(spark, d), 5, ["qid"])


@register("SELECT event_type, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY value), 2) AS p50, round(percentile_disc(0.95) WITHIN GROUP (ORDER BY value), 2) AS p95, round(percentile_disc(0.99) WITHIN GROUP (ORDER BY value), 2) AS p99, round(avg(value), 2) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_summary(table(spark, d, "events"), ["event_type"], "value")


@register("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, list_sort(list(value))[CAST(floor(0.5 * (count(value) - 1)) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * (count(value) - 1)) AS INT) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * (count(value) - 1)) AS INT) + 1] AS p99 FROM events GROUP BY event_type")
def timing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.timing_summary(table(spark, d, "events"), ["event_type"], "value")


@register("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def answer_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.answer_diagnostics(table(spark, d, "events"), "value", ["event_type"])
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "median", "std", "p10", "p90") else F.col(c) for c in out.columns])


@register("SELECT source AS variant, CASE WHEN grouping(lang) = 0 THEN coalesce(lang, 'unknown') END AS category, count(*) AS n_queries, round(avg(n_chars), 4) AS n_chars FROM documents GROUP BY GROUPING SETS ((source), (source, lang))")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("variant"), F.col("lang").alias("category"), "n_chars")
    return metrics.rollup(rows, ["n_chars"])


_GRID = [(i, k, 1.0, b, s) for i, (k, b, s) in enumerate((k, b, s) for k in (20, 60) for b in (0.5, 1.0) for s in (0.25, 1.0))]
_GRID_SQL = ", ".join(f"({i}, {k}, {a}::DOUBLE, {b}::DOUBLE, {s}::DOUBLE)" for i, k, a, b, s in _GRID)


@register(
    f"{_FUSED}{_JUDGED}, grid(config_id, k, wd, wb, ws) AS (VALUES {_GRID_SQL}), x AS (SELECT grid.config_id, sp.*, coalesce(wd / (k + dense_rank), 0) + coalesce(wb / (k + bm25_rank), 0) + coalesce(ws / (k + sparse_rank), 0) AS s FROM sp, grid),"
    " p AS (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY round(s, 12) DESC, coalesce(dense_rank, 2147483647), coalesce(bm25_rank, 2147483647), coalesce(sparse_rank, 2147483647), chunk_id) AS pos FROM x)"
    " SELECT config_id, round(avg(r), 6) AS mrr FROM (SELECT config_id, qid, coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 THEN pos END), 0) AS r FROM p LEFT JOIN judged USING (qid, doc_id) GROUP BY ALL) GROUP BY config_id"
)
def grid_calibration(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d)
    corpus = _corpus(spark, d)
    pool = candidate_pool(dense_topk(corpus.vectors, q, _K), corpus.lexical.search(q, _K))
    ranked = sparse_rank(pool, _query_sparse(spark, d), corpus.sparse)
    grid = spark.createDataFrame(_GRID, "config_id int, rrf_k int, dense_w double, bm25_w double, sparse_w double")
    hits = metrics.calibrate(ranked, grid)
    per = metrics.reciprocal_rank(hits, _judgements(spark, d), keys=("config_id", "qid"))
    return per.groupBy("config_id").agg(F.round(F.avg("mrr"), 6).alias("mrr"))


@register(
    "WITH lim(metric, kind, lim, level) AS (VALUES ('recall@5', 'drop', 0.02, 'FAIL'), ('recall@10', 'drop', 0.03, 'WARN'), ('recall@30', 'drop', 0.03, 'WARN'), ('ndcg@10', 'drop', 0.02, 'FAIL'), ('mrr', 'drop', 0.03, 'FAIL'), ('latency_p95', 'rise', 0.25, 'WARN'), ('latency_p99', 'rise', 0.3, 'WARN')),"
    " m AS (SELECT user_id % 2 AS side, ['recall@5', 'recall@10', 'recall@30', 'ndcg@10', 'mrr', 'latency_p95', 'latency_p99'][1 + user_id % 14 // 2] AS metric, avg(value) AS v FROM events GROUP BY ALL),"
    " b AS (SELECT metric, v FROM m WHERE side = 0), c AS (SELECT metric, v FROM m WHERE side = 1 AND metric <> 'recall@30')"
    " SELECT metric, round(b.v, 6) AS baseline, round(c.v, 6) AS current, round(x, 6) AS change, CASE WHEN c.v IS NULL THEN 'WARN' WHEN round(x, 12) > lim THEN level ELSE 'OK' END AS severity FROM (SELECT lim.*, CASE WHEN kind = 'drop' THEN b.v - c.v WHEN b.v > 0 THEN (c.v - b.v) / b.v END AS x, metric AS mm FROM lim JOIN b USING (metric) LEFT JOIN c USING (metric)) z JOIN b USING (metric) LEFT JOIN c USING (metric)"
)
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m, *_ in metrics.GATE])
    user = F.col("user_id")
    rows = table(spark, d, "events").groupBy((user % 2).alias("side"), F.element_at(names, (F.floor(user % 14 / 2) + 1).cast("int")).alias("metric")).agg(F.avg("value").alias("value"))
    out = metrics.gate(rows.where("side = 1 AND metric <> 'recall@30'"), rows.where("side = 0"))
    return out.withColumn("baseline", F.round("baseline", 6)).withColumn("current", F.round("current", 6))


# -- metadata


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, "archived").otherwise("active").alias("status"), F.concat(F.lit("/docs/"), "source", F.lit("/"), "doc_id").alias("path"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = docs.where("lang IS NOT NULL").select("doc_id", F.concat(F.lit("lang:"), "lang").alias("tag"))
    return out.union(labels.where("quality = 1").select("doc_id", F.lit("good").alias("tag"))).union(labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")))


_TAGS = "tags AS (SELECT doc_id, 'lang:' || lang AS tag FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"


@register(f"WITH {_TAGS} SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('lang:en', 'good') GROUP BY doc_id HAVING count(DISTINCT tag) = 2) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'toxic')")
def filter_resolution(spark: SparkSession, d: str) -> DataFrame:
    spec = metadata.FilterSpec(tags_include=("good",), tags_exclude=("toxic",), language="en")
    return metadata.resolve(spec, _documents(spark, d), _tags(spark, d))


@register("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 7 <> 0) AS matched FROM documents")
def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return metadata.filter_stats(docs, metadata.resolve(metadata.FilterSpec(), docs, _tags(spark, d)))


@register(f"WITH {_TAGS}, t AS (SELECT DISTINCT tag FROM tags UNION SELECT 'unused') SELECT t.tag, count(DISTINCT doc_id) AS n_documents FROM t LEFT JOIN tags ON t.tag = tags.tag GROUP BY t.tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = _tags(spark, d)
    return metadata.list_tags(tags.select("tag").union(spark.createDataFrame([("unused",)], "tag string")), tags)


@register("SELECT source AS source_id, count(*) AS n_documents FROM documents GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return metadata.list_sources(docs.select("source_id"), docs)


@register(f"WITH {_TAGS}, c AS (SELECT vec_id % (SELECT count(*) FROM documents) AS doc_id, vec_id FROM embeddings) SELECT d.doc_id, source AS source_id, CASE WHEN d.doc_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status, coalesce(t, '') AS tags, coalesce(n, 0) AS n_chunks FROM documents d LEFT JOIN (SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS t FROM tags GROUP BY doc_id) t USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT vec_id) AS n FROM c GROUP BY doc_id) c USING (doc_id)")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    chunks = table(spark, d, "embeddings").crossJoin(F.broadcast(n)).select((F.col("vec_id") % F.col("n")).alias("doc_id"), F.col("vec_id").alias("chunk_id"))  # one row
    return metadata.list_documents(docs, _tags(spark, d), chunks).drop("path")


@register(f"WITH {_TAGS} SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM documents LEFT JOIN tags USING (doc_id) GROUP BY doc_id, source HAVING lower(CAST(doc_id AS VARCHAR)) LIKE '%c1_/%' OR lower('/docs/' || source || '/' || CAST(doc_id AS VARCHAR)) LIKE '%c1_/%' OR bool_or(lower(tag) LIKE '%c1_/%')")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    return metadata.search_documents(_documents(spark, d), _tags(spark, d), "C1_/").select("doc_id", "tags")


@register("SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY md5(text)")
def new_by_content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return metadata.new_by_content(docs.where("doc_id % 10 = 0"), docs)


@register("SELECT doc_id, quality + 10 AS quality FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return metadata.upsert(rows, rows.where("doc_id % 3 = 0").withColumn("quality", F.col("quality") + 10), ["doc_id"])


@register(f"WITH {_TAGS} SELECT doc_id, tag FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return metadata.remove(_tags(spark, d), table(spark, d, "labels").where("toxic = 1").select("doc_id"))


# -- documents and text


@register("SELECT doc_id, regexp_replace(text, '!\\[.*?\\]\\(data:image/[^;]*;base64,[A-Za-z0-9+/=]+\\)', '', 'gs') AS clean, strlen(text) AS raw_bytes FROM documents")
def clean_md(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_markdown(F.col("text")).alias("clean"), F.octet_length("text").cast("long").alias("raw_bytes"))


@register(
    "WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)), e AS (SELECT *, starts_with(trim(line), '|') AS tb, lag(starts_with(trim(line), '|')) OVER (PARTITION BY doc_id ORDER BY n) AS pt FROM l)"
    " SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(trim(line), '^#{1,6}\\s+.+')) AS n_headings, count(*) FILTER (WHERE tb AND NOT coalesce(pt, false)) AS n_tables, greatest(1, (sum(length(line) + 1) - 1) // 4)::BIGINT AS n_tokens, greatest(1, greatest(1, (sum(length(line) + 1) - 1) // 4) // 800)::BIGINT AS estimated_chunks FROM e GROUP BY doc_id"
)
def inspect_documents(spark: SparkSession, d: str) -> DataFrame:
    return markdown.inspect(table(spark, d, "documents"))


@register("SELECT doc_id, sum((length(line) > 500)::INT)::BIGINT AS long_lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY doc_id")
def line_validation(spark: SparkSession, d: str) -> DataFrame:
    return markdown.line_lengths(table(spark, d, "documents"))


@register()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return markdown.chunk_documents(table(spark, d, "documents"))


@register("SELECT CAST(doc_id AS VARCHAR) AS path, 'frontmatter_missing' AS code, 'WARN' AS severity FROM documents WHERE trim(text, ' ' || chr(10)) <> '' AND NOT starts_with(text, '---')")
def documents_without_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """The one code of the report that every document can have; validate_documents has all, contract_codes each on its own."""
    report = markdown.validate(table(spark, d, "documents"), "doc_id", "text")
    return report.where("code = 'frontmatter_missing'").select("path", "code", "severity")


@register()
def validate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of every document."""
    return markdown.validate(table(spark, d, "documents"), "doc_id", "text")


@register("SELECT substr(sha1(CAST(doc_id AS VARCHAR) || ':' || '1' || ':' || left(text, 200)), 1, 16) AS chunk_id, doc_id, greatest(1, length(text) // 4)::INT AS approx, greatest(1, strlen(text))::INT AS upper_bound FROM documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "documents").select(T.chunk_id(c("doc_id").cast("string"), F.lit(1), c("text")).alias("chunk_id"), "doc_id", T.approx_tokens(c("text")).alias("approx"), T.upper_tokens(c("text")).alias("upper_bound"))


@register("SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS query_hash FROM conversations")
def query_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.query_hash(F.col("text")).alias("query_hash"))


@register("SELECT role, count(*) AS n, sum((length(trim(text)) <= 30 OR regexp_matches(text, '(?i)no information (is )?(available|found|provided)|not (found|available|present|mentioned|covered|described|listed|included|provided|specified|detailed|addressed)\\b'))::INT)::BIGINT AS abstained FROM conversations GROUP BY role")
def abstention_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.abstains(F.col("text"))).alias("abstained"))


_ANSWER = "'As said [[1] Fuente: ' || source || ' | Sección: Part ' || CAST(doc_id % 3 AS VARCHAR) || ' | Líneas: ' || CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + doc_id % 4 AS VARCHAR) || ']. And  more [[2] Fuente: none | Sección: x | Líneas: 1-2] .'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("doc_id"), lambda x: x.cast("string")
    text = F.concat(F.lit("As said [[1] Fuente: "), "source", F.lit(" | Sección: Part "), s(c % 3), F.lit(" | Líneas: "), s(c), F.lit("-"), s(c + c % 4), F.lit("]. And  more [[2] Fuente: none | Sección: x | Líneas: 1-2] ."))
    return table(spark, d, "documents").select(c.alias("qid"), text.alias("answer"), "source")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    return table(spark, d, "documents").select(
        c.alias("qid"), F.col("source").alias("doc_id"), c.alias("chunk_id"), F.concat(F.lit("Book > Part "), (c % 2).cast("string")).alias("heading_path"), F.lit(1).alias("pos"), c.alias("line_start"), (c + 1).alias("line_end"),
        ((c % 10) / 10).alias("rerank_score"),
    )


@register(f"SELECT doc_id AS qid, trim(regexp_replace(regexp_replace(regexp_replace({_ANSWER}, '\\[\\[\\d+\\][^\\]]*\\]', '', 'g'), ' +([.,;:?!])', '\\1', 'g'), ' {{2,}}', ' ', 'g')) AS bare FROM documents")
def strip_citations(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("qid", T.strip_citations(F.col("answer")).alias("bare"))


@register(
    "SELECT doc_id AS qid, 0 AS cite_no, '1' AS cite_index, CASE WHEN doc_id % 3 <> doc_id % 2 THEN 'INVALID' WHEN doc_id % 4 = 1 THEN 'VALID' ELSE 'PARTIAL' END AS status, CASE WHEN doc_id % 3 = doc_id % 2 THEN doc_id END AS chunk_id FROM documents"
    " UNION ALL SELECT doc_id, 1, '2', 'INVALID', NULL FROM documents"
)
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    return verification.classify(verification.citations(_answers(spark, d)), _evidence(spark, d)).select("qid", "cite_no", "cite_index", "status", "chunk_id")


@register(
    "SELECT doc_id AS qid, (v + 0) / 2 AS citation_score, (doc_id % 3 = doc_id % 2)::INT / 2 AS coverage_score, round(0.35 * (v / 2) + 0.3 * 1 + 0.25 * 0.5 + 0.1 * (doc_id % 3 = doc_id % 2)::INT / 2, 6) AS trust_score,"
    " CASE WHEN 0.35 * (v / 2) + 0.425 + 0.1 * (doc_id % 3 = doc_id % 2)::INT / 2 >= 0.75 THEN 'HIGH' WHEN round(0.35 * (v / 2) + 0.425 + 0.1 * (doc_id % 3 = doc_id % 2)::INT / 2, 6) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS trust_level"
    " FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> doc_id % 2 THEN 0.0 WHEN doc_id % 4 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS v FROM documents)"
)
def trust_score(spark: SparkSession, d: str) -> DataFrame:
    cited = verification.classify(verification.citations(_answers(spark, d)), _evidence(spark, d))
    answers = _answers(spark, d).withColumn("consistency", F.lit(None).cast("double"))
    return verification.trust(answers, cited, _evidence(spark, d)).select("qid", "citation_score", "coverage_score", "trust_score", "trust_level")


@register(
    """WITH RECURSIVE c AS (SELECT doc_id % 20 AS qid, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS pos, doc_id AS chunk_id, CAST(floor(greatest(1, length(text) // 4) * 1.15::DOUBLE) AS BIGINT) + 1 AS cost FROM documents),
    p(qid, pos, run, used) AS (SELECT DISTINCT qid, 0::BIGINT, 600::BIGINT, 0::BIGINT FROM c UNION ALL SELECT p.qid, c.pos, CASE WHEN run + cost <= 7424 THEN run + cost ELSE run END, CASE WHEN run + cost <= 7424 THEN used + 1 ELSE used END FROM p JOIN c ON c.qid = p.qid AND c.pos = p.pos + 1)
    SELECT qid, max_by(used, pos) AS n_used, max(pos) - max_by(used, pos) AS n_dropped, max_by(run, pos) AS prompt_tokens, least(8192, 7680 - max_by(run, pos)) AS output_tokens, 'ok' AS status FROM p GROUP BY qid"""
)
def pack_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("qid"), F.col("doc_id").alias("chunk_id"), T.approx_tokens(F.col("text")).alias("n_tokens"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")))
    out = context.pack(rows, F.lit(600))
    return out.select("qid", F.size("used").cast("long").alias("n_used"), F.size("dropped").cast("long").alias("n_dropped"), "prompt_tokens", "output_tokens", "status")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_EXPANDED = """
WITH q AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, text,
    list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(lower(text), '[¿?]', '', 'g')), '\\s+'), lambda w: trim(w, '''"(),.:;')), lambda w: w <> '' AND NOT list_contains([STOP], w)) AS k
  FROM conversations WHERE role = 'user'),
v AS (
  SELECT qid, 0 AS variant_no, 'original' AS type, text FROM q
  UNION ALL SELECT qid, 1, 'stopword', CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END FROM q
  UNION ALL SELECT qid, 2, 'last_terms', CASE WHEN len(k) > 0 THEN array_to_string(k[greatest(1, len(k) - 4):], ' ') ELSE text END FROM q)
SELECT qid, variant_no, type, text FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY variant_no) AS n FROM v) WHERE n = 1
"""


@register(_EXPANDED.replace("STOP", _STOP))
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    return expand_queries(table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text"))


@register("SELECT qid, chunk_id, variant_no, row_number() OVER (PARTITION BY qid ORDER BY variant_no, final_pos) AS merged_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY variant_no, final_pos) AS n FROM (SELECT user_id % 50 AS qid, CAST(floor(value) AS INT) AS chunk_id, user_id % 3 AS variant_no, event_id AS final_pos FROM events)) WHERE n = 1")
def merged_variants(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("qid"), F.floor("value").cast("int").alias("chunk_id"), (F.col("user_id") % 3).alias("variant_no"), F.col("event_id").alias("final_pos"))
    return merge_variants(e).select("qid", "chunk_id", "variant_no", "merged_pos")


# -- state, logs, feedback

_STATE = "CASE event_type WHEN 'signup' THEN 'IN_PROGRESS' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'ROLLED_BACK' WHEN 'view' THEN 'SKIPPED' ELSE 'COMMITTED' END"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("state", F.expr(_STATE)).withColumn("run_id", F.col("event_id")).withColumn("started_at", F.col("ts"))


@register(
    f"SELECT *, CASE WHEN failed + rolled_back = 0 THEN 'COMPLETED' WHEN committed + skipped > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (WHERE s = 'COMMITTED') AS committed, count(*) FILTER (WHERE s = 'SKIPPED') AS skipped, count(*) FILTER (WHERE s = 'FAILED') AS failed, count(*) FILTER (WHERE s = 'ROLLED_BACK') AS rolled_back FROM (SELECT *, {_STATE} AS s FROM events) GROUP BY user_id)"
)
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.batch_status(_log(spark, d).withColumn("batch_id", F.col("user_id")))


@register("SELECT event_id AS run_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale_runs(_log(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("run_id")


@register(f"SELECT batch_id, doc_id, s AS state, 1 AS retry_count FROM (SELECT user_id % 5 AS batch_id, user_id AS doc_id, {_STATE} AS s, row_number() OVER (PARTITION BY user_id % 5, user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND s IN ('FAILED', 'ROLLED_BACK')")
def resumable_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).select((F.col("user_id") % 5).alias("batch_id"), F.col("user_id").alias("doc_id"), "state", F.lit(0).alias("retry_count"), F.col("event_id").alias("updated_at"))
    return lifecycle.resumable(rows).select("batch_id", "doc_id", "state", "retry_count")


@register("SELECT event_type AS feedback, count(*) AS n, count(DISTINCT user_id) AS queries, count(DISTINCT props) AS chunks FROM events GROUP BY ROLLUP (event_type)")
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("feedback"), F.col("user_id").alias("query_hash"), F.col("props").alias("chunk_id"))
    return lifecycle.feedback_stats(e)


@register("SELECT count(*) AS n, round(100 * avg((event_type = 'purchase')::INT), 4) AS useful_percent, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS mean_useful, round(avg(value) FILTER (WHERE event_type <> 'purchase'), 6) AS mean_other FROM events")
def feedback_analysis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_type") == "purchase").alias("useful"), F.col("value").alias("final_score"))
    out = lifecycle.feedback_analysis(e)
    return out.withColumn("mean_useful", F.round("mean_useful", 6)).withColumn("mean_other", F.round("mean_other", 6))


@register("SELECT CAST(k AS VARCHAR) AS chunk_key, count(*) AS n FROM (SELECT unnest([user_id % 11, user_id % 7 + 20]) AS k FROM events) GROUP BY k ORDER BY n DESC, chunk_key LIMIT 5")
def feedback_top_chunks(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    listed = F.to_json(F.array((u % 11).cast("string"), (u % 7 + 20).cast("string")))
    return lifecycle.top_chunks(table(spark, d, "events").select(listed.alias("chunks_retrieved")))


@register(
    "WITH c AS (SELECT doc_id AS chunk_id, source AS doc_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 51 = 0 THEN 'old' ELSE 'm1' END AS mv, CASE WHEN doc_id % 60 = 0 THEN 32 WHEN doc_id % 61 = 0 THEN 0 ELSE 64 END AS dim FROM documents), v AS (SELECT vec_id AS chunk_id FROM embeddings), doc AS (SELECT DISTINCT source AS doc_id, 'EN' AS language FROM documents WHERE source <> 'src3' UNION ALL SELECT 'ghost', NULL),"
    " tg AS (SELECT DISTINCT source AS doc_id, 'lang:en' AS tag FROM documents WHERE source <> 'src4')"
    " SELECT 'vector_without_chunk' AS check_name, CAST(chunk_id AS VARCHAR) AS key FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT 'chunk_without_vector', CAST(chunk_id AS VARCHAR) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v)"
    " UNION ALL SELECT 'duplicate_fts', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 40 = 0 UNION ALL SELECT 'missing_model', CAST(chunk_id AS VARCHAR) FROM c WHERE mv = '' UNION ALL SELECT 'model_mismatch', CAST(chunk_id AS VARCHAR) FROM c WHERE mv = 'old'"
    " UNION ALL SELECT 'dim_mismatch', CAST(chunk_id AS VARCHAR) FROM c WHERE dim = 32 UNION ALL SELECT 'document_without_chunks', 'ghost' UNION ALL SELECT 'chunks_without_document', 'src3' WHERE EXISTS (SELECT 1 FROM c WHERE doc_id = 'src3') UNION ALL SELECT 'tag_orphan', 'src3' WHERE EXISTS (SELECT 1 FROM c WHERE doc_id = 'src3')"
    " UNION ALL SELECT 'missing_derived_tag', 'src4' WHERE EXISTS (SELECT 1 FROM c WHERE doc_id = 'src4') UNION ALL SELECT 'stale_run', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-14 23:30:00' UNION ALL SELECT 'failed_run', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'"
)
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    model = F.when(i % 50 == 0, "").when(i % 51 == 0, "old").otherwise("m1")
    dim = F.when(i % 60 == 0, 32).when(i % 61 == 0, 0).otherwise(64)
    chunks = docs.select(i.alias("chunk_id"), F.col("source").alias("doc_id"), model.alias("model_version"), dim.alias("embedding_dim"))
    fts = chunks.select("chunk_id", "doc_id").union(chunks.where("chunk_id % 40 = 0").select("chunk_id", "doc_id"))
    own = docs.where("source <> 'src3'").select(F.col("source").alias("doc_id"), F.lit("EN").alias("language")).distinct().union(spark.createDataFrame([("ghost", None)], "doc_id string, language string"))
    tags = docs.where("source <> 'src4'").select(F.col("source").alias("doc_id"), F.lit("lang:en").alias("tag")).distinct()
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return lifecycle.integrity(chunks, vectors, fts, own, tags, _log(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), "m1", 64)


@register("SELECT conv_id, turn, k.h IS NOT NULL AS hit FROM conversations c LEFT JOIN (SELECT DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS h FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 5 <> 0) k ON k.h = trim(regexp_replace(lower(c.text), '\\s+', ' ', 'g'))")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    asked = lifecycle.cache_keys(table(spark, d, "conversations").select("conv_id", "turn", "text"), {"top_k": DEFAULTS.top_k, "rrf_k": DEFAULTS.rrf_k})
    age = F.when(F.col("conv_id") % 5 == 0, DEFAULTS.cache_ttl_seconds).otherwise(10)
    cache = asked.where("conv_id % 3 = 0").select("cache_key", F.lit("s1").alias("corpus_fp"), (F.lit(10**9) - age).alias("created"))
    return lifecycle.cache_lookup(asked, cache, "s1", 10**9).select("conv_id", "turn", "hit")


@register(
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'INCOHERENT' WHEN doc_id % 5 = 0 THEN 'CREATE' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 'NOOP_OWNER' WHEN doc_id % 2 = 0 THEN 'REPLACE' WHEN doc_id % 3 = 0 THEN 'NOOP_EQUIVALENT_OTHER_SOURCE' ELSE 'NOT_OWNER' END AS decision FROM documents"
)
def ownership_decisions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    has = i % 5 != 0
    h = F.when(has, F.lit("h"))
    state = table(spark, d, "documents").select(
        "doc_id", has.alias("has_version"), (i % 11 == 0).alias("pending_op"), F.when(has, "COMMITTED").alias("run_state"), h.alias("documents_hash"), h.alias("version_hash"), F.when(has, F.array(F.lit("h"))).alias("committed_hashes"),
        F.when(has, F.lit("a")).alias("documents_path"), F.when(has, F.lit("a")).alias("owner_path"), F.lit(False).alias("mixed_models"), F.lit(True).alias("vectors_known"), F.lit(False).alias("vectors_differ"), F.lit(False).alias("fts_differs"),
        F.lit(False).alias("chunk_ids_differ"), F.when(has, 3).otherwise(0).alias("n_chunks"), F.when(has, 3).otherwise(0).alias("n_vectors"), F.when(has, 3).otherwise(0).alias("n_fts"), F.when(i % 2 == 0, "a").otherwise("b").alias("path"),
        (i % 3 == 0).alias("chunks_equal"), F.lit(None).cast("boolean").alias("model_equal"), F.lit(True).alias("class_equal"), (i % 7 == 0).alias("force"),
    )
    return lifecycle.decide(state).select("doc_id", "decision")


@register("SELECT source AS doc_id, doc_id AS chunk_id FROM documents WHERE doc_id % 2 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 0) AND doc_id % 3 <> 0")
def obsolete_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"))
    return lifecycle.obsolete_chunks(rows.where("chunk_id % 2 = 0"), rows.where("chunk_id % 3 = 0"))


# -- streaming jobs, as batches over the same tables


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@register("WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sessions(table(spark, d, "events"))


from quillon.plans import registry_more, registry_state  # noqa: E402,F401  (register their own)
