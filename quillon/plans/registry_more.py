"""More registered queries: operators that need made-up inputs. Where documents have no such text, it is written down here, with what must come out beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS
from quillon.functions import text as T
from quillon.operators import ann, context, graph, lifecycle, markdown, metadata, metrics, sketches, verification
from quillon.operators.dense import dense_topk, sparse_rank
from quillon.operators.fusion import candidate_pool, rrf_three
from quillon.plans import benchmark, evaluate, ingest, timing
from quillon.plans.registry import _FUSED, _JUDGED, _K, _STATE, _chunks, _corpus, _judgements, _log, _queries, _query_sparse, register, table
from quillon.plans.retrieval import run_variant
from quillon.providers import with_fallback
from quillon.runtime import written
from quillon.sources import files
from quillon.streaming import cache as stream_cache

# -- retrieval


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, r AS final_pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 1.0::DOUBLE / (20 + bm25_rank) DESC, chunk_id) AS r FROM (SELECT qid, chunk_id, doc_id, rk AS bm25_rank FROM b)) WHERE r <= 50")
def variant_bm25(spark: SparkSession, d: str) -> DataFrame:
    return run_variant("bm25", _corpus(spark, d), _queries(spark, d)).select("qid", "chunk_id", "doc_id", "final_pos")


@register(f"{_FUSED} SELECT qid, chunk_id, doc_id, rrf_rank AS final_pos FROM rr")
def variant_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return run_variant("hybrid", _corpus(spark, d), _queries(spark, d), _query_sparse(spark, d)).select("qid", "chunk_id", "doc_id", "final_pos")


_RERANKED = (
    ", q AS (SELECT qid, list_distinct(w) AS w FROM asked), sc2 AS (SELECT rr.*, CASE WHEN len(q.w) > 0 THEN len(list_intersect(q.w, tok.t)) / len(q.w)::DOUBLE ELSE 0 END AS s FROM rr JOIN q USING (qid) JOIN tok USING (chunk_id)),"
    " re AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rrf_rank) AS final_pos FROM sc2)"
)


@register(f"{_FUSED}{_RERANKED} SELECT qid, chunk_id, doc_id, round(s, 6) AS rerank_score, final_pos FROM re")
def variant_full(spark: SparkSession, d: str) -> DataFrame:
    out = run_variant("full", _corpus(spark, d), _queries(spark, d), _query_sparse(spark, d), texts=_chunks(spark, d))
    return out.select("qid", "chunk_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "final_pos")


_HYDE = _FUSED.replace(
    "qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id)",
    "qv AS (SELECT item_id AS qid, coalesce(y.embedding, o.embedding)::DOUBLE[] AS e FROM benchmark LEFT JOIN embeddings o ON o.vec_id = item_id LEFT JOIN embeddings y ON y.vec_id = 2 * item_id + 1 WHERE coalesce(y.embedding, o.embedding) IS NOT NULL)",
)


@register(f"{_HYDE}{_RERANKED} SELECT qid, chunk_id, doc_id, round(s, 6) AS rerank_score, final_pos FROM re")
def variant_full_hyde(spark: SparkSession, d: str) -> DataFrame:
    """As variant_full, asked with a hypothetical answer's vector where there is one: that of vec_id = 2 * item_id + 1 stands in."""
    answers = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("hyde_embedding"))
    asked = _queries(spark, d).join(answers, F.expr("vec_id = 2 * qid + 1"), "left").drop("vec_id")
    out = run_variant("full_hyde", _corpus(spark, d), asked, _query_sparse(spark, d), texts=_chunks(spark, d))
    return out.select("qid", "chunk_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "final_pos")


@register(f"{_FUSED} SELECT qid, chunk_id, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, coalesce(dense_rank, 2147483647), coalesce(bm25_rank, 2147483647), coalesce(sparse_rank, 2147483647), chunk_id) AS rrf_rank FROM (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS s FROM sp)")
def rrf_equal(spark: SparkSession, d: str) -> DataFrame:
    return rrf_three(_ranked(spark, d)).select("qid", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rrf_rank")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    q, corpus = _queries(spark, d), _corpus(spark, d)
    pool = candidate_pool(dense_topk(corpus.vectors, q, _K), corpus.lexical.search(q, _K))
    return sparse_rank(pool, _query_sparse(spark, d), corpus.sparse)


_GRADED = """
, rel AS (SELECT qid, count(*) AS n FROM judged GROUP BY qid), ideal AS (SELECT qid, 3 / log2(2) + 1 / log2(3) AS i FROM rel),
g AS (SELECT h.*, CASE WHEN row_number() OVER (PARTITION BY k, qid, doc_id ORDER BY pos) = 1 THEN coalesce(grade, 0) ELSE 0 END AS grade, coalesce(grade, 0) AS any_grade FROM h LEFT JOIN judged USING (qid, doc_id)),
per AS (SELECT k, qid, count(DISTINCT CASE WHEN any_grade > 0 AND pos <= 5 THEN doc_id END) / any_value(n)::DOUBLE AS r5, count(DISTINCT CASE WHEN any_grade > 0 AND pos <= 10 THEN doc_id END) / any_value(n)::DOUBLE AS r10,
  count(DISTINCT CASE WHEN any_grade > 0 AND pos <= 30 THEN doc_id END) / any_value(n)::DOUBLE AS r30, coalesce(1.0::DOUBLE / min(CASE WHEN any_grade > 0 THEN pos END), 0) AS mrr,
  sum(CASE WHEN pos <= 10 THEN grade / log2(pos + 1) ELSE 0 END) / any_value(i) AS ndcg, count(*) AS n_results FROM g JOIN rel USING (qid) JOIN ideal USING (qid) GROUP BY k, qid)"""
_RUN = f"{_FUSED}{_RERANKED}{_JUDGED}, h AS (SELECT 'full' AS k, qid, doc_id, final_pos AS pos FROM re UNION ALL SELECT 'hybrid_mmr', qid, doc_id, final_pos FROM mmr UNION ALL SELECT 'hybrid', qid, doc_id, rrf_rank FROM rr){_GRADED}"
_EVERY = ", every AS (SELECT item_id AS qid, k, 'c' || CAST(item_id % 3 AS VARCHAR) AS category FROM benchmark, (VALUES ('full'), ('hybrid_mmr'), ('hybrid')) v(k)), f AS (SELECT every.qid, every.k, category, coalesce(r5, 0) AS r5, coalesce(r10, 0) AS r10, coalesce(r30, 0) AS r30, coalesce(mrr, 0) AS mrr, coalesce(ndcg, 0) AS ndcg, coalesce(n_results, 0) AS nr FROM every LEFT JOIN per ON per.k = every.k AND per.qid = every.qid)"


def _run(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("qid") % 3).cast("string")))
    return benchmark.run(["full", "hybrid_mmr", "hybrid"], _corpus(spark, d), q, _judgements(spark, d), _query_sparse(spark, d), texts=_chunks(spark, d))


@register(f"{_RUN}{_EVERY} SELECT k AS variant, qid, category, round(r5, 6) AS recall5, round(r10, 6) AS recall10, round(r30, 6) AS recall30, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg10, CAST(nr AS DOUBLE) AS n_results FROM f")
def benchmark_run(spark: SparkSession, d: str) -> DataFrame:
    names = {"recall@5": "recall5", "recall@10": "recall10", "recall@30": "recall30", "mrr": "mrr", "ndcg@10": "ndcg10"}
    return _run(spark, d).select("variant", "qid", "category", *[F.round(F.col(f"`{m}`"), 6).alias(n) for m, n in names.items()], "n_results")


@register(f"{_RUN}{_EVERY} SELECT k AS variant, CASE WHEN grouping(category) = 0 THEN category END AS category, count(*) AS n_queries, round(avg(r5), 4) AS recall5, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg10 FROM f GROUP BY GROUPING SETS ((k), (k, category))")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    out = benchmark.summary(_run(spark, d), ("recall@5", "mrr", "ndcg@10"))
    return out.withColumnsRenamed({"recall@5": "recall5", "ndcg@10": "ndcg10"})


@register(f"{_RUN}{_EVERY} SELECT CASE WHEN r5 < 0.5 THEN 'weak' ELSE 'strong' END AS kind, category, qid, 1::BIGINT AS n_queries, round(r5, 6) AS recall5 FROM f WHERE k = 'full' AND (r5 < 0.5 OR r5 = 1) UNION ALL SELECT CASE WHEN grouping(category) = 0 THEN 'category' ELSE 'overall' END, CASE WHEN grouping(category) = 0 THEN category END, -1, count(*), round(avg(r5), 4) FROM f WHERE k = 'full' GROUP BY GROUPING SETS ((), (category))")
def benchmark_report(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.report(_run(spark, d)).select("kind", "category", F.coalesce("qid", F.lit(-1)).cast("long").alias("qid"), "n_queries", F.round(F.col("`recall@5`"), 6).alias("recall5"))


_GRID_SQL = (
    f"{_FUSED}{_JUDGED}, grid AS (SELECT (row_number() OVER (ORDER BY dk, bk, sw, bw, rk) - 1)::INT AS config_id, * FROM (VALUES (30), (50), (100)) a(dk), (VALUES (30), (50), (100)) b2(bk), (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) c(sw), (VALUES (0.5::DOUBLE), (0.75), (1.0)) d2(bw), (VALUES (20), (60), (100)) e(rk)),"
    " x0 AS (SELECT grid.*, sp.qid, sp.chunk_id, sp.doc_id, CASE WHEN dense_rank <= dk THEN dense_rank END AS dr, CASE WHEN bm25_rank <= bk THEN bm25_rank END AS br, sparse_rank FROM sp, grid),"
    " x1 AS (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY sparse_rank) AS sr FROM x0 WHERE dr IS NOT NULL OR br IS NOT NULL),"
    " x2 AS (SELECT *, coalesce(1.0::DOUBLE / (rk + dr), 0) + coalesce(bw / (rk + br), 0) + sw / (rk + sr) AS s FROM x1),"
    " h AS (SELECT config_id AS k, qid, doc_id, chunk_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY round(s, 12) DESC, coalesce(dr, 2147483647), coalesce(br, 2147483647), sr, chunk_id) AS pos FROM x2) WHERE pos <= 50)"
)
_BY_CONFIG = ", sums AS (SELECT k AS config_id, round(sum(r5) / nq, 6) AS recall5, round(sum(mrr) / nq, 6) AS mrr, round(sum(ndcg) / nq, 6) AS ndcg10 FROM per, (SELECT count(*)::DOUBLE AS nq FROM benchmark) GROUP BY k, nq), placed AS (SELECT *, row_number() OVER (ORDER BY ndcg10 DESC, mrr DESC, recall5 DESC, config_id) AS place FROM sums)"


def _calibrated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranked, grid = written(_ranked(spark, d), "ranked"), benchmark.grid_table(spark)
    return ranked, grid, benchmark.calibrate(ranked, grid, _judgements(spark, d), _queries(spark, d))


@register(f"{_GRID_SQL}{_GRADED}{_BY_CONFIG} SELECT config_id, recall5, mrr, ndcg10, place FROM placed")
def calibration_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 324 settings with their place."""
    return _calibrated(spark, d)[2].select("config_id", F.col("`recall@5`").alias("recall5"), "mrr", F.col("`ndcg@10`").alias("ndcg10"), F.col("place").cast("long").alias("place"))


@register(
    f"{_GRID_SQL}{_GRADED}{_BY_CONFIG}, q AS (SELECT qid, list_distinct(w) AS w FROM asked), top AS (SELECT h.k, h.qid, h.doc_id, row_number() OVER (PARTITION BY h.k, h.qid ORDER BY CASE WHEN len(q.w) > 0 THEN len(list_intersect(q.w, tok.t)) / len(q.w)::DOUBLE ELSE 0 END DESC, h.pos) AS pos FROM h JOIN placed ON placed.config_id = h.k AND place <= 3 JOIN q USING (qid) JOIN tok USING (chunk_id)),"
    " m AS (SELECT k, qid, coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 THEN pos END), 0) AS mrr FROM top LEFT JOIN judged USING (qid, doc_id) GROUP BY k, qid) SELECT k AS config_id, round(sum(mrr) / nq, 6) AS mrr FROM m, (SELECT count(*)::DOUBLE AS nq FROM benchmark) GROUP BY k, nq"
)
def calibration_rerank(spark: SparkSession, d: str) -> DataFrame:
    ranked, grid, calibrated = _calibrated(spark, d)
    out = benchmark.rerank_top(ranked, grid, written(calibrated, "calibrated"), _judgements(spark, d), _queries(spark, d), _chunks(spark, d))
    return out.select("config_id", "mrr")


_REST = "ndcg10 DESC, mrr DESC, recall5 DESC, p50, config_id LIMIT 1) AS config_id"


@register(
    f"{_GRID_SQL}{_GRADED}{_BY_CONFIG}, o AS (SELECT placed.*, dk / 5.0 AS p50, round((0.4::DOUBLE * ndcg10 + 0.4::DOUBLE * mrr + 0.2::DOUBLE * recall5) * CASE WHEN dk >= 100 THEN 0.9::DOUBLE ELSE 1 END, 12) AS balance FROM placed JOIN grid USING (config_id))"
    f" SELECT 'best_ndcg' AS pick, (SELECT config_id FROM o ORDER BY {_REST} UNION ALL SELECT 'best_recall', (SELECT config_id FROM o ORDER BY recall5 DESC, {_REST} UNION ALL SELECT 'balanced', (SELECT config_id FROM o ORDER BY balance DESC, {_REST}"
)
def calibration_pick(spark: SparkSession, d: str) -> DataFrame:
    """What to take of all 324 settings; a fifth of dense_k stands in for the median latency, so that the answer is the same on every machine."""
    _, grid, calibrated = _calibrated(spark, d)
    return metrics.recommend(calibrated.join(grid.select("config_id", (F.col("dense_k") / 5).alias("p50")), "config_id"))


@register(
    "WITH hits AS (SELECT user_id % 40 AS qid, 'd' || CAST(event_id % 7 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS pos FROM events), j AS (SELECT DISTINCT user_id % 40 AS qid, 'd' || CAST(user_id % 5 AS VARCHAR) AS doc_id FROM events),"
    " per AS (SELECT qid, doc_id, count(*) AS n, min(pos) AS f FROM hits WHERE pos <= 5 GROUP BY ALL), m AS (SELECT per.*, j.doc_id IS NOT NULL AS good FROM per LEFT JOIN j USING (qid, doc_id)), w AS (SELECT j.qid, list_sort(list(j.doc_id) FILTER (WHERE per.doc_id IS NULL)) AS displaced FROM j LEFT JOIN per USING (qid, doc_id) GROUP BY j.qid)"
    " SELECT qid, array_to_string(coalesce(displaced, []), ',') AS displaced, array_to_string(coalesce(list_sort(list(m.doc_id) FILTER (WHERE NOT good)), []), ',') AS intruders, array_to_string(coalesce(list_sort(list(m.doc_id) FILTER (WHERE n > 2)), []), ',') AS over_represented, (list(m.doc_id ORDER BY -n, f) FILTER (WHERE NOT good))[1] AS top_intruder FROM m LEFT JOIN w USING (qid) GROUP BY qid, displaced"
)
def query_review(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    name = lambda c, n: F.concat(F.lit("d"), (F.col(c) % n).cast("string"))
    hits = e.select((F.col("user_id") % 40).alias("qid"), name("event_id", 7).alias("doc_id"), "event_id").withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("event_id")))
    judged = e.select((F.col("user_id") % 40).alias("qid"), name("user_id", 5).alias("doc_id")).distinct().withColumn("grade", F.lit(1))
    out = metrics.query_review(hits, judged)
    return out.select("qid", *[F.array_join(c, ",").alias(c) for c in ("displaced", "intruders", "over_represented")], "top_intruder")


@register("SELECT max(CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END)::INT AS exit_code FROM events")
def gate_exit(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "click", "WARN").otherwise("OK")
    return metrics.gate_exit(table(spark, d, "events").select(level.alias("severity")))


@register("SELECT round(avg(value), 6) AS mean_all, round(avg(value) FILTER (WHERE user_id % 3 <> 1), 6) AS mean_applicable, count(*) FILTER (WHERE user_id % 3 <> 1) AS n_applicable, count(*) AS n_all FROM events")
def applicability_split(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("user_id") % 3 == 1, False).when(F.col("user_id") % 3 == 2, True)
    out = metrics.applicability(table(spark, d, "events").withColumn("f", flag), "f", "value")
    return out.withColumn("mean_all", F.round("mean_all", 6)).withColumn("mean_applicable", F.round("mean_applicable", 6))


@register("SELECT avg(CASE WHEN length(trim(text)) <= 30 THEN 1.0 ELSE 0.0 END)::DOUBLE AS correctness FROM conversations WHERE conv_id % 4 = 0")
def no_answer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 4 == 0).alias("negative"), (F.char_length(F.trim("text")) <= 30).alias("abstains"))
    return evaluate.no_answer_correctness(rows)


_CAUSE = "CASE WHEN user_id % 10 = 0 THEN 'out_of_corpus' WHEN event_id % 4000 > 2500 THEN 'too_long' WHEN event_id % 4000 < 300 THEN 'too_short' WHEN user_id % 11 > 8 THEN 'many_citations' WHEN user_id % 7 = 1 THEN 'citation_noise' WHEN value % 1 < 0.6 THEN 'off_topic' ELSE 'too_broad' END"


@register(f"SELECT {_CAUSE} AS cause, count(*) AS n FROM events GROUP BY cause")
def low_score_causes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    cause = metrics.diagnosis(c("event_id") % 4000, c("user_id") % 11, F.when(c("user_id") % 7 == 1, 0.1).otherwise(0.0), c("value") % 1, c("user_id") % 10 != 0)
    return table(spark, d, "events").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o THEN CASE WHEN user_id % 2 = 0 THEN 'PASS' ELSE 'WARN' END WHEN user_id % 13 = 0 THEN 'FAIL' WHEN nc = 0 THEN 'FAIL' WHEN nc - nv = nc THEN 'FAIL' WHEN user_id % 5 = 0 THEN 'WARN' WHEN user_id % 3 = 0 THEN CASE WHEN nv >= 1 THEN 'PASS' ELSE 'FAIL' END WHEN nv = nc THEN 'PASS' ELSE 'WARN' END AS verdict FROM (SELECT user_id, user_id % 17 = 0 AS o, event_id % 4 AS nc, least(event_id % 4, event_id % 3) AS nv FROM events)) GROUP BY verdict"
)
def answer_audit(spark: SparkSession, d: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    n, valid = e % 4, F.least(e % 4, e % 3)
    verdict = metrics.audit(u % 17 == 0, u % 2 == 0, u % 13 == 0, n, valid, n - valid, F.when(u % 5 == 0, "LOW").otherwise("HIGH"), u % 3 == 0)
    return table(spark, d, "events").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@register()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """(profile, probes, recall): how much of the exact first 50 each profile finds, over every benchmark query's vector."""
    vectors, asked = _corpus(spark, d).vectors, _queries(spark, d).where("embedding IS NOT NULL").select("qid", "embedding")
    c = ann.centres(vectors, 32)
    exact = written(dense_topk(vectors, asked, 50), "exact")
    out = None
    for name, probes in ann.PROFILES.items():
        one = evaluate.ranking_overlap(exact, ann.search(vectors, asked, c, probes)).select(F.lit(name).alias("profile"), F.lit(probes).alias("probes"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


@register()
def graph_recall(spark: SparkSession, d: str) -> DataFrame:
    """(profile, n_queries, recall, looked): how much of the exact first 50 the graph finds with each profile, and the share of all vectors that a query is compared with."""
    vectors, asked = _corpus(spark, d).vectors, written(_queries(spark, d).where("embedding IS NOT NULL").select("qid", "embedding"), "asked")
    exact = written(dense_topk(vectors, asked, 50), "exact")
    n, out = vectors.count(), None
    for name in ("fast", "balanced", "recall"):
        profile = graph.PROFILES[name]
        found = written(graph.search(graph.build(vectors, profile, n=n), vectors, asked, profile), "found")
        seen = found.groupBy("qid").agg(F.max("looked").alias("looked")).agg(F.round(F.avg("looked") / max(1, n), 4).alias("looked"), F.count(F.lit(1)).alias("n_queries"))
        one = evaluate.ranking_overlap(exact, found).select(F.lit(name).alias("profile"), "recall").join(F.broadcast(seen), F.lit(True))  # one row each
        out = one if out is None else out.unionByName(one)
    return out.select("profile", "n_queries", "recall", "looked")


# -- documents and text

_FM = "---\ndoc_id: d\ntitle: T\ndomain: a\nsource_type: b\nlanguage: en\n"
_FILL, _LINE = "word " * 60, "word " * 20 + "\n"
#: Made-up documents and every issue that the document contract has with each: severity, code, line.
CONTRACT: list[tuple[str | None, list[tuple[str, str, int | None]]]] = [
    (_FM + "---\n# T\n" + _FILL, []),
    ("", [("ERROR", "empty_file", None)]),
    ("  \n", [("ERROR", "empty_file", None)]),
    (None, [("ERROR", "encoding_error", None)]),
    (_FM + "---\n# T\nshort", [("WARN", "min_content", None)]),
    ("# T\n" + _FILL, [("WARN", "frontmatter_missing", None)]),
    ("---\ndoc_id: d\n# T\n" + _FILL, [("WARN", "frontmatter_unclosed", 1)]),
    ("---\nx: [\n---\n# T\n" + _FILL, [("ERROR", "frontmatter_invalid_yaml", 1)]),
    ("---\n- a\n---\n# T\n" + _FILL, [("ERROR", "frontmatter_not_mapping", 1)]),
    (_FM + "dataset: x\n---\n# T\n" + _FILL, [("ERROR", "frontmatter_scope_violation", 1)]),
    (_FM.replace("doc_id: d\n", "") + "---\n# T\n" + _FILL, [("ERROR", "frontmatter_missing_doc_id", 1)]),
    ("---\ndoc_id: d\n---\n# T\n" + _FILL, [("WARN", f"frontmatter_missing_{k}", 1) for k in ("title", "domain", "source_type", "language")]),
    (_FM + "tags: 5\n---\n# T\n" + _FILL, [("ERROR", "frontmatter_tags_not_list", 1)]),
    (_FM + 'tags: [3, "", " a ", b, b]\n---\n# T\n' + _FILL, [("ERROR", "frontmatter_tag_not_string", 1), ("WARN", "frontmatter_tag_empty", 1), ("WARN", "frontmatter_tag_whitespace", 1), ("WARN", "frontmatter_tag_duplicate", 1)]),
    (_FM + "---\n" + _FILL, [("WARN", "missing_title", None)]),
    (_FM + "---\n# T\n### deep\n" + _FILL, [("WARN", "heading_hierarchy_skip", 9)]),
    (_FM + "---\n# T\n" + _LINE * 70, [("WARN", "section_too_long", 8)]),
    (_FM + "---\n# T\n|a|b|\n|---|---|\n" + "|1|2|\n" * 201, [("WARN", "large_table", 9)]),
    (_FM + "---\n# T\n" + "x" * 501, [("INFO", "long_line", 9)]),
    (_FM + "---\n# T\n" + _LINE * 6500, [("WARN", "section_too_long", 8), ("WARN", "estimated_chunks_high", None)]),
]
_ISSUES = ", ".join(f"('{i}', '{s}', '{c}', {line if line is not None else 'NULL'})" for i, (_, found) in enumerate(CONTRACT) for s, c, line in found)


#: The case of each document's number: the last one, which is large, seldom.
_CASE = f"CASE WHEN doc_id % 400 = 0 THEN {len(CONTRACT) - 1} ELSE doc_id % {len(CONTRACT) - 1} END"
_ISSUED = f"documents JOIN (VALUES {_ISSUES}) v(kind, severity, code, line) ON kind = CAST({_CASE} AS VARCHAR)"


@register(f"SELECT CAST(doc_id AS VARCHAR) AS path, severity, code, coalesce(CAST(line AS INT), 0) AS line_number FROM {_ISSUED}")
def contract_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of a made-up document for each document's number; line 0 stands for the whole document."""
    cases = spark.createDataFrame([(i, t, t is not None) for i, (t, _) in enumerate(CONTRACT)], "kind int, text string, readable boolean")
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(_CASE).cast("int").alias("kind"))
    return markdown.validate(ids.join(cases, "kind").drop("kind"), "path", "text", "readable").fillna(0, ["line_number"])


@register(f"SELECT CAST(doc_id AS VARCHAR) AS path FROM {_ISSUED} WHERE severity IN ('ERROR', 'WARN') GROUP BY doc_id")
def contract_blocked(spark: SparkSession, d: str) -> DataFrame:
    return markdown.blocked(contract_codes(spark, d), strict=True)


@register("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN 'T' || CAST(doc_id AS VARCHAR) ELSE 'H' || CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 2 = 0 THEN 'b,a' ELSE '' END AS tags, CASE WHEN doc_id % 2 = 0 THEN 'a,b,domain:stats,lang:en' ELSE '' END AS all_tags, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'missing' END AS front_state FROM documents")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: T"), i, F.lit("\ndomain: Stats\nlanguage: EN\ntags: [b, ' a ', b]\n---\n# H"), i, F.lit("\nx"))).otherwise(F.concat(F.lit("intro\n# H"), i, F.lit("\nx")))
    out = markdown.parse_front_matter(table(spark, d, "documents").select(i.alias("path"), text.alias("text")))
    return out.select("path", "title", F.array_join("tags", ",").alias("tags"), F.array_join("all_tags", ",").alias("all_tags"), "front_state")


@register("SELECT doc_id, lang || ',' || source AS tags, CASE WHEN lang IS NULL THEN 'domain:' || source ELSE 'domain:' || source || ',lang:' || lower(lang) END || ',version:V1' AS derived FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, source, 'domain:' || source || ',version:V1' FROM documents WHERE lang IS NULL")
def tag_expressions(spark: SparkSession, d: str) -> DataFrame:
    tags = metadata.normal_tags(F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""), "source"))
    derived = metadata.derived_tags(F.col("source"), F.lit(" "), F.upper("lang"), F.lit(" V1 "))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"), F.array_join(derived, ",").alias("derived"))


_LEVELS = "[1 + doc_id % 2, 1 + doc_id % 3, 2 + doc_id % 4, 1 + doc_id % 5, 3]"


@register(
    f"""WITH RECURSIVE h AS (SELECT doc_id, unnest(range(1, 6))::INT AS line, unnest({_LEVELS})::INT AS level FROM documents), p AS (SELECT a.doc_id, a.line, a.level, max(b.line) AS parent FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.line < a.line AND b.level < a.level GROUP BY ALL),
    t AS (SELECT doc_id, line, level, 'h' || CAST(line AS VARCHAR) AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.doc_id, p.line, p.level, t.path || ' > h' || CAST(p.line AS VARCHAR) FROM p JOIN t ON t.doc_id = p.doc_id AND t.line = p.parent) SELECT doc_id, line, level, path FROM t"""
)
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    levels = [1 + i % 2, 1 + i % 3, 2 + i % 4, 1 + i % 5, F.lit(3)]
    text = F.concat_ws("\n", *[F.concat(F.repeat(F.lit("#"), n.cast("int")), F.lit(f" h{k}")) for k, n in enumerate(levels, 1)])
    return markdown.heading_tree(table(spark, d, "documents").select("doc_id", text.alias("text")))


_IMAGE = "![x](data:image/png;base64,QUJDRA==)"


@register(f"SELECT doc_id, strlen(text) AS before, CASE WHEN strlen(text) = 0 THEN 0.0::DOUBLE ELSE round((1 - strlen(text) / (strlen(text) + {len(_IMAGE)})::DOUBLE) * 100, 6) END AS size_reduction FROM documents WHERE text IS NOT NULL")
def size_reduction(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    image = F.when(F.octet_length("text") > 0, F.concat("text", F.lit(_IMAGE))).otherwise(F.col("text"))
    out = files.cleaned(docs.select("doc_id", F.octet_length("text").cast("long").alias("before"), image.alias("text")))
    return out.select("doc_id", "before", F.round("size_reduction", 6).alias("size_reduction"))


@register("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS hash, CASE WHEN doc_id % 3 = 0 THEN 'p2' ELSE 'p1' END AS path FROM documents")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    old = docs.where(i % 5 != 0).select(i.cast("string").alias("doc_id"), F.lit("old").alias("hash"), F.lit("p1").alias("path"))
    new = docs.where((i % 3 == 0) | (i % 2 == 0) | (i % 5 == 0)).select(i.cast("string").alias("doc_id"), F.when(i % 3 == 0, "new").otherwise("old").alias("hash"), F.when((i % 3 != 0) & (i % 5 == 0), "p1").otherwise("p2").alias("path"))
    return files.upsert_manifest(old, new).select("doc_id", "hash", "path")


@register("SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'a' || CAST(item_id AS VARCHAR) || ',b' ELSE 'a' || CAST(item_id AS VARCHAR) END AS expected FROM benchmark WHERE item_id % 3 <> 1 AND item_id % 5 <> 2")
def eval_samples(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    grades = F.map_from_arrays(F.array(F.lit("b"), F.concat(F.lit("a"), i.cast("string")), F.lit("z")), F.array(F.when(i % 2 == 0, 2).otherwise(1), F.lit(3), F.lit(0)))
    suite = table(spark, d, "benchmark").select(i.cast("string").alias("id"), F.when(i % 3 == 1, "negative").when(i % 3 == 2, "official").alias("suite"), F.when(i % 5 == 2, False).when(i % 5 == 1, True).alias("validated"), grades.alias("doc_relevance"))
    return files.eval_samples(suite).select("id", F.array_join("expected_doc_ids", ",").alias("expected"))


@register("SELECT doc_id, count(*) AS n FROM (SELECT source AS doc_id FROM documents WHERE doc_id IN (SELECT DISTINCT user_id FROM events)) GROUP BY doc_id")
def chunks_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("user_id").alias("chunk_id"))
    return metadata.by_ids(_chunks(spark, d), ids).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'Document: ' || source || chr(10) END || CASE WHEN doc_id % 4 = 2 THEN '' ELSE 'Section: ' || trim(left(repeat('s', (doc_id % 300)::INT) || 'p', 200)) || chr(10) END || chr(10) || coalesce(text, '') END AS shown FROM documents")
def reranker_texts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    doc = F.when((i % 4 != 0) & (i % 4 != 3), F.col("source"))
    head = F.when((i % 4 != 0) & (i % 4 != 2), F.concat(F.repeat(F.lit("s"), (i % 300).cast("int")), F.lit("p ")))
    return table(spark, d, "documents").select("doc_id", T.reranker_text(doc, head, F.col("text")).alias("shown"))


_LONG = "This is the draft of an answer that is long enough to be taken for one"


@register(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'said' WHEN 1 THEN '{_LONG} ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN '{_LONG}' ELSE 'only thoughts' END AS answer FROM documents")
def answers_from_reasoning(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    content = F.when(i % 4 == 0, " said ").when(i % 4 == 1, "  ")
    reasoning = (
        F.when(i % 4 == 1, F.concat(F.lit(f"1. think\nFinal Answer (v2):\n{_LONG} "), i.cast("string"), F.lit("\n2. **Check** all")))
        .when(i % 4 == 2, F.lit(f"3. **Draft the text**:\n{_LONG}\n4. **Polish**")).otherwise(F.lit(" only thoughts "))
    )
    return table(spark, d, "documents").select("doc_id", T.answer_from(content, reasoning).alias("answer"))


@register("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'better' ELSE text END AS asked FROM conversations")
def rewritten_queries(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("conv_id") % 3 == 0, " better ").when(F.col("conv_id") % 3 == 1, "  ")
    rows = table(spark, d, "conversations").withColumn("made", made)
    return with_fallback(rows, "made", "text", "asked").select("conv_id", "turn", "asked")


@register("SELECT doc_id, '[' || CAST(doc_id % 9 AS VARCHAR) || '] Fuente: ' || source || ' | Sección: ' || coalesce(lang, 'Sin encabezado') || ' | Líneas: ' || CAST(doc_id AS VARCHAR) || '-N/A' || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) AS shown FROM documents")
def rendered_chunks(spark: SparkSession, d: str) -> DataFrame:
    shown = context.render_chunk(F.col("doc_id") % 9, F.col("source"), F.col("lang"), F.col("doc_id"), F.lit(None), F.col("text"))
    return table(spark, d, "documents").select("doc_id", shown.alias("shown"))


@register("SELECT doc_id AS qid, CASE WHEN base > 7424 THEN 'base_too_large' ELSE 'ok' END AS status, CASE WHEN base + cost <= 7424 THEN 1 ELSE 0 END AS n_used, base + CASE WHEN base + cost <= 7424 THEN cost ELSE 0 END AS prompt_tokens FROM (SELECT doc_id, (doc_id * 37 % 9000) AS base, CAST(floor((doc_id % 4000) * 1.15::DOUBLE) AS BIGINT) + 1 AS cost FROM documents)")
def pack_overflow(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("qid"), i.alias("chunk_id"), F.lit(1).alias("pos"), (i % 4000).alias("n_tokens"), (i * 37 % 9000).alias("base0"))
    return context.pack(rows, F.col("base0")).select("qid", "status", F.size("used").alias("n_used"), "prompt_tokens")


@register("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS consistency FROM documents")
def consistency_replies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    say = lambda when: F.when(when, "sí").otherwise("NO")
    reply = F.concat(F.lit("HALLUCINATIONS: NO\nunsupported: "), say(i % 2 == 0), F.lit("\nContradictions : no\n"), F.when(i % 7 == 0, "HALLUCINATIONS: perhaps").otherwise(F.concat(F.lit("HALLUCINATIONS: "), say(i % 3 == 0))))
    return table(spark, d, "documents").select("doc_id", verification.consistency(reply).alias("consistency"))


@register("SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) WHEN value IS NOT NULL THEN 1 END, 6) AS scaled FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))")
def scaled_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("user_id", "qid").select("event_id", F.round(verification.min_max("value"), 6).alias("scaled"))


@register("SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'no_citations' END, CASE WHEN event_id % 4 > 1 THEN 'invalid_citations' END, CASE WHEN event_id % 5 = 0 THEN 'hallucination' END, CASE WHEN event_id % 7 = 0 THEN 'unsupported' END, CASE WHEN event_id % 11 = 0 THEN 'degraded' END, CASE WHEN event_id % 2 = 0 THEN 'low_spread' END], lambda x: x IS NOT NULL), ',') AS codes FROM events")
def answer_warnings(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    codes = verification.warnings(e % 3, F.greatest(e % 4 - 1, F.lit(0)), e % 5 == 0, e % 7 == 0, e % 11 == 0, F.when(e % 2 == 0, 0.4).otherwise(0.5))
    return table(spark, d, "events").select("event_id", F.array_join(codes, ",").alias("codes"))


# -- state


@register("SELECT path, doc_id, ok, CASE WHEN ok THEN row_number() OVER (PARTITION BY doc_id, ok ORDER BY path) > 1 ELSE false END AS duplicate FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, source AS doc_id, doc_id % 4 <> 0 AS ok FROM documents)")
def first_in_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("source").alias("doc_id"), (F.col("doc_id") % 4 != 0).alias("ok"), F.lit(0).alias("batch_id"))
    return lifecycle.first_in_batch(rows).drop("batch_id")


@register(f"SELECT event_id AS batch_id FROM (SELECT *, {_STATE} AS s FROM events) WHERE s IN ('IN_PROGRESS', 'FAILED') ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_incomplete(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).select(F.col("event_id").alias("batch_id"), F.col("state").alias("status"), "started_at")
    return lifecycle.latest_incomplete(rows).select("batch_id")


@register("SELECT CAST(n AS VARCHAR) || ':' || CAST(r AS VARCHAR) || ':7' AS corpus_fp FROM (SELECT count(*) AS n FROM documents), (SELECT max(event_id) AS r FROM events)")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.corpus_fingerprint(table(spark, d, "documents"), table(spark, d, "events"), 7, "event_id")


@register("SELECT count(*) AS entries, sum(event_id % 5)::BIGINT AS hits, count(*) FILTER (WHERE event_id % 10 = 0) AS expired, count(DISTINCT event_type) AS fingerprints FROM events")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cache_stats(_cache(spark, d), 10**9)


def _cache(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("cache_key"), F.col("event_type").alias("corpus_fp"), (F.lit(10**9) - F.when(e % 10 == 0, DEFAULTS.cache_ttl_seconds).otherwise(5)).alias("created"), (e % 5).alias("hits"), F.lit(0).alias("last_access"))


@register("SELECT event_id AS cache_key FROM events WHERE event_type = 'view' AND event_id % 10 <> 0")
def cache_vacuum(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cache_vacuum(_cache(spark, d), "view", 10**9).select("cache_key")


@register("SELECT event_id AS cache_key, event_id % 5 + CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS hits, CASE WHEN event_id % 4 = 0 THEN 77 ELSE 0 END AS last_access FROM events")
def cache_touch(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "events").select(F.col("event_id").alias("cache_key"), (F.col("event_id") % 4 == 0).alias("hit"))
    return lifecycle.cache_touch(_cache(spark, d), keys.unionByName(keys), 77).select("cache_key", "hits", "last_access")


@register("SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations WHERE conv_id % 2 = 0) AS n, (SELECT max(event_id) FROM events) + (SELECT count(*) FROM conversations WHERE conv_id % 2 = 0) AS last_id")
def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """The log after a batch: unknown kinds are not added, ids go on."""
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("query_text"), F.lit("c").alias("chunk_id"), F.lit("useful").alias("feedback"))
    kind = F.when(F.col("conv_id") % 2 == 0, "relevant").otherwise("nonsense")
    new = table(spark, d, "conversations").select(F.col("text").alias("query_text"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), kind.alias("feedback"))
    out = lifecycle.feedback_add(log, new, {"top_k": 50})
    return out.agg(F.count_distinct("id").alias("n"), F.max("id").alias("last_id"))


@register("SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 100")
def feedback_listing(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.feedback_list(table(spark, d, "events").withColumnRenamed("event_id", "id"), F.col("event_type") == "view").select("id")


@register("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS token, CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 3 END::DOUBLE AS weight FROM documents")
def sparse_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    have = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("a").alias("token"), F.lit(0.5).alias("weight"))
    return ingest.backfill_sparse(docs.select(F.col("doc_id").alias("chunk_id"), F.lit("B, b! b").alias("text")), have).select(F.col("chunk_id").alias("doc_id"), "token", "weight")


@register("SELECT DISTINCT source AS doc_id, CASE WHEN source = 'src1' THEN 'T' ELSE 'p' || CAST(min(doc_id) OVER (PARTITION BY source) AS VARCHAR) END AS title FROM documents UNION SELECT 'src1', 'T'")
def documents_made_up(spark: SparkSession, d: str) -> DataFrame:
    have = spark.createDataFrame([("src1", "T")], "doc_id string, title string")
    chunks = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("line_start"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("heading_path"))
    return ingest.documents_from_chunks(have, chunks).select("doc_id", "title")


def _stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").select(i.alias("chunk_id"), F.col("source").alias("doc_id"), (i % 500).alias("line_start"), (i % 500 + 1).alias("line_end"), F.when(i % 9 == 0, "").otherwise("m1").alias("model_version"), F.lit(64).alias("embedding_dim"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return chunks, vectors, chunks.where("chunk_id % 50 <> 0").select("chunk_id", "doc_id"), chunks.where("chunk_id % 3 <> 0").select("chunk_id")


@register(
    "SELECT 'config' AS check_name, 'OK' AS status UNION ALL SELECT 'docstore', 'OK' UNION ALL SELECT 'vectors', 'OK' UNION ALL SELECT 'fts', 'WARN' UNION ALL SELECT 'coverage', 'WARN' UNION ALL SELECT 'reconcile', CASE WHEN (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) + (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) > 0 THEN 'FAIL' ELSE 'OK' END"
    " UNION ALL SELECT 'ingest', CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-14 23:30:00') > 0 THEN 'FAIL' WHEN (SELECT count(*) FROM events WHERE event_type = 'error') > 0 THEN 'WARN' ELSE 'OK' END UNION ALL SELECT 'test_query', 'OK'"
)
def doctor_checks(spark: SparkSession, d: str) -> DataFrame:
    chunks, vectors, fts, sparse = _stores(spark, d)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    docs = chunks.select("doc_id", F.lit(None).cast("string").alias("language")).distinct()
    found = lifecycle.integrity(chunks, vectors, fts, docs, docs.select("doc_id", F.lit("x").alias("tag")), _log(spark, d), now, "m1", 64)
    return lifecycle.doctor(lifecycle.health_counts(chunks, vectors, fts, sparse, _log(spark, d), found, now), n_hits=1)


@register(
    "SELECT 'document' AS section, source AS key, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n, count(*) AS total FROM documents GROUP BY source UNION ALL SELECT 'shared_span', source || ':' || CAST(doc_id % 500 AS VARCHAR) || ':' || CAST(doc_id % 500 + 1 AS VARCHAR), count(*), -1 FROM documents GROUP BY source, doc_id % 500 HAVING count(*) > 1"
    " UNION ALL SELECT 'model', CASE WHEN doc_id % 9 = 0 THEN '(unknown)' ELSE 'm1' END, count(*), -1 FROM documents GROUP BY 2 UNION ALL SELECT 'store', 'chunks', count(*), -1 FROM documents UNION ALL SELECT 'store', 'fts', count(*), -1 FROM documents WHERE doc_id % 50 <> 0 UNION ALL SELECT 'store', 'vectors', count(*), -1 FROM embeddings"
)
def diagnosis_report(spark: SparkSession, d: str) -> DataFrame:
    chunks, vectors, fts, sparse = _stores(spark, d)
    return lifecycle.diagnose(chunks, sparse, fts, vectors).fillna(-1, ["total"])


@register("SELECT min(total) AS least, list_sort(list(total))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1] AS p50, list_sort(list(total))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS p95, max(total) AS most, count(*) AS n FROM (SELECT round(sum(value), 4) AS total FROM events GROUP BY user_id)")
def timing_log(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return timing.log_summary(log).select("least", "p50", "p95", "most", "n")


# -- the cache as state, and sketches

_REPLAY = "CASE WHEN event_id % 5 = 0 THEN 'set' WHEN event_id % 5 = 4 THEN 'invalidate' ELSE 'get' END"


def _cache_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a cache's log: fifty keys, a clear each week, what a set holds is the event itself."""
    found = F.array(F.struct(F.col("event_id").alias("chunk_id"), F.col("value").cast("double").alias("score")))
    kind = F.expr(_REPLAY)
    return table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 50).cast("string").alias("cache_key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("epoch"), F.when(kind == "set", found).alias("found"),
    )


@register(
    f"WITH e AS (SELECT event_id, CAST(user_id % 50 AS VARCHAR) AS cache_key, ts, {_REPLAY} AS kind, (dayofmonth(ts) - 1) // 7 AS epoch FROM events),"
    " l AS (SELECT *, last_value(CASE WHEN kind <> 'get' THEN event_id END IGNORE NULLS) OVER (PARTITION BY cache_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)"
    " SELECT l.event_id, l.cache_key, coalesce(o.kind = 'set' AND o.epoch = l.epoch AND epoch_us(l.ts) - epoch_us(o.ts) < 21600000000, false) AS hit, CASE WHEN o.kind = 'set' AND o.epoch = l.epoch AND epoch_us(l.ts) - epoch_us(o.ts) < 21600000000 THEN o.event_id END AS chunk_id FROM l LEFT JOIN e o ON o.event_id = l.last WHERE l.kind = 'get'"
)
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """What a cache with a life of six hours serves to every get of a log with sets, invalidations and clears."""
    return stream_cache.replay(_cache_events(spark, d), 6 * 3600).select("event_id", "cache_key", "hit", F.get("found", F.lit(0))["chunk_id"].alias("chunk_id"))


@register("SELECT event_type, count(value) AS n, true AS p50_ok, true AS p95_ok, true AS p99_ok, true AS users_ok FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def sketch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of seventeen days' hours, merged, against the exact values of the same range: ranks within 2 in 100, users within 5 in 100."""
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")
    states = sketches.hourly(events, ["event_type"]).where("hour >= TIMESTAMP '2024-01-03' AND hour < TIMESTAMP '2024-01-20'")
    found = sketches.summary(states, ["event_type"])
    own = events.where("ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'").join(F.broadcast(found), "event_type")  # a row per event type
    share = [F.avg(F.when(F.col("value") <= F.col(c), 1.0).otherwise(0.0)).alias(c) for c in ("p50", "p95", "p99")]
    exact = own.groupBy("event_type").agg(F.max("n").alias("n"), *share, F.max("n_users").alias("about"), F.count_distinct("user_id").alias("users"))
    ok = [(F.abs(F.col(c) - r) < 0.02).alias(f"{c}_ok") for c, r in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return exact.select("event_type", "n", *ok, (F.abs(F.col("about") / F.col("users") - 1) < 0.05).alias("users_ok"))
