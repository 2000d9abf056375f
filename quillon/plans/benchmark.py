"""Variants and fusion settings against judged queries: one plan over (variant or configuration, query)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings
from quillon.operators import metrics
from quillon.plans.retrieval import Corpus, fused_search, own_texts, run_variant, searched_as
from quillon.plans.timing import PhaseTimer, observed
from quillon.providers import overlap_score
from quillon.runtime import written

METRICS = ("recall@5", "recall@10", "recall@30", "mrr", "ndcg@10", "dense_coverage", "bm25_coverage", "sparse_coverage", "unique_docs@5", "max_chunks_same_doc@5", "n_results")


def scores(hits: DataFrame, judged: DataFrame, every: DataFrame, key: str, chunk_grades: DataFrame | None = None) -> DataFrame:
    """(key, qid, METRICS) of hits (key, qid, chunk_id, doc_id, pos and ranks); ``every`` has the (key, qid) that must be there: without hits all are 0."""
    keys = (key, "qid")
    per = [metrics.recall_at(hits, judged, k, keys).withColumnRenamed("recall", f"recall@{k}") for k in (5, 10, 30)]
    per.append(metrics.reciprocal_rank(hits, judged, chunk_grades, keys))
    per.append(metrics.ndcg_at(metrics.grade(hits, judged, chunk_grades, keys), judged, 10, chunk_grades, keys).withColumnRenamed("ndcg", "ndcg@10"))
    per.append(metrics.signal_coverage(hits, list(keys)))
    per.append(metrics.diversity_stats(hits, 5, list(keys)).withColumnsRenamed({"unique_docs": "unique_docs@5", "max_chunks_same_doc": "max_chunks_same_doc@5"}))
    per.append(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_results")))
    out = every.select(*keys).distinct()
    for p in per:
        out = out.join(p, list(keys), "left")
    return out.fillna(0, list(METRICS)).select(*keys, *[F.col(f"`{m}`").cast("double").alias(m) for m in METRICS])


def run(
    names: list[str], corpus: Corpus, queries: DataFrame, judged: DataFrame, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, texts: DataFrame | None = None, chunk_grades: DataFrame | None = None,
) -> DataFrame:
    """(variant, qid, category, METRICS) for every variant and query; the hits of all variants are written once and scored together. Variants that differ in diversity or reranking alone share one search.

    ``queries``: qid, text, embedding, category (null: unknown). A query without hits scores 0.
    """
    hits, searched = None, {}
    wide = ("qid", "chunk_id", "doc_id", "dense_rank", "bm25_rank", "sparse_rank")
    for name in names:
        signals, hyde = as_ = searched_as(name, queries)
        if as_ not in searched:
            asked = queries.withColumn("embedding", F.coalesce("hyde_embedding", "embedding")) if hyde else queries
            searched[as_] = written(fused_search(corpus, asked, query_sparse, settings, signals=signals), "fused")
        own = run_variant(name, corpus, queries, query_sparse, settings, texts=texts, fused=searched[as_]).select("variant", *wide, F.col("final_pos").alias("pos"))
        hits = own if hits is None else hits.unionByName(own)
    spark = queries.sparkSession
    every = queries.select("qid").crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "variant string")))  # eight rows at most
    return scores(written(hits, "benchmark-hits"), judged, every, "variant", chunk_grades).join(queries.select("qid", "category"), "qid")


def summary(per_query: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(variant, category, n_queries, means): overall (category null) and by category."""
    return metrics.rollup(per_query, list(names))


LATENCY = "variant string, repeat int, plan_ms double, search_ms double, total_ms double, n_hits long, n_queries long"


def latencies(names: list[str], corpus: Corpus, queries: DataFrame, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, texts: DataFrame | None = None, repeats: int = 3) -> DataFrame:
    """LATENCY: milliseconds a query of every variant and repeat, building the plan (with what that writes) and running it, and what was observed in the run: hits, and queries with any.

    Measured over the whole batch and divided by its queries, since a batch is what runs. The driver gets one row per variant and repeat.
    """
    n, rows = max(queries.count(), 1), []
    for name in names:
        for repeat in range(repeats):
            with PhaseTimer() as timer:
                timer.start("plan")
                hits = run_variant(name, corpus, queries, query_sparse, settings, texts=texts)
            seen, seconds = observed(hits, n_hits=F.count(F.lit(1)), n_queries=F.count_if(F.col("final_pos") == 1))
            plan = 1000 * timer.seconds["plan"] / n
            rows.append((name, repeat, plan, 1000 * seconds / n, plan + 1000 * seconds / n, seen["n_hits"], seen["n_queries"]))
    return queries.sparkSession.createDataFrame(rows, LATENCY)


def latency_by_variant(measured: DataFrame) -> DataFrame:
    """(variant, p50, p95, p99, mean): milliseconds a query over a variant's repeats."""
    return metrics.latency_summary(measured, ["variant"], "total_ms")


def report(per_query: DataFrame, variant: str = "full", measured: DataFrame | None = None) -> DataFrame:
    """(kind, category, qid, n_queries, recall@5, mrr, ndcg@10) of one variant: overall, each category, and the weak (recall@5 under a half) and strong (1) queries.

    With ``measured`` (LATENCY) also p50, p95 and p99 of the variant, in the overall row; null where it wasn't measured.
    """
    own = per_query.where(F.col("variant") == variant)
    shown = ("recall@5", "mrr", "ndcg@10")
    sums = summary(own, shown).select(F.when(F.col("category").isNull(), "overall").otherwise("category").alias("kind"), "category", F.lit(None).cast(own.schema["qid"].dataType).alias("qid"), "n_queries", *[f"`{m}`" for m in shown])
    kind = F.when(F.col("`recall@5`") < 0.5, "weak").when(F.col("`recall@5`") == 1.0, "strong")
    single = own.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", F.coalesce("category", F.lit("unknown")).alias("category"), "qid", F.lit(1).cast("long").alias("n_queries"), *[f"`{m}`" for m in shown])
    out = sums.unionByName(single)
    if measured is None:
        return out
    took = latency_by_variant(measured.where(F.col("variant") == variant)).select(F.lit("overall").alias("kind"), "p50", "p95", "p99")
    return out.join(F.broadcast(took), "kind", "left").select(*out.columns, "p50", "p95", "p99")  # one row


# -- calibration

#: The grid of fusion settings.
GRID = {"dense_k": (30, 50, 100), "bm25_k": (30, 50, 100), "sparse_w": (0.25, 0.5, 0.75, 1.0), "bm25_w": (0.5, 0.75, 1.0), "rrf_k": (20, 60, 100)}


def grid_table(spark: SparkSession, grid: dict[str, tuple] = GRID) -> DataFrame:
    """(config_id, dense_k, bm25_k, sparse_w, bm25_w, rrf_k, dense_w): every combination, numbered in order."""
    rows = [(i, dk, bk, float(sw), float(bw), rk, 1.0) for i, (dk, bk, sw, bw, rk) in enumerate(product(grid["dense_k"], grid["bm25_k"], grid["sparse_w"], grid["bm25_w"], grid["rrf_k"]))]
    return spark.createDataFrame(rows, "config_id int, dense_k int, bm25_k int, sparse_w double, bm25_w double, rrf_k int, dense_w double")


def fuse(ranked: DataFrame, grid: DataFrame, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """Hits under every configuration from rankings that are computed once.

    A configuration sees the first dense_k and bm25_k of the two rankings; sparse ranks are counted anew among what is left.
    """
    every = ranked.crossJoin(F.broadcast(grid))  # some hundred rows
    for s in ("dense", "bm25"):
        every = every.withColumn(f"{s}_rank", F.when(F.col(f"{s}_rank") <= F.col(f"{s}_k"), F.col(f"{s}_rank")))
    every = every.where("dense_rank IS NOT NULL OR bm25_rank IS NOT NULL")
    again = Window.partitionBy("config_id", "qid").orderBy("sparse_rank")
    every = every.withColumn("sparse_rank", F.row_number().over(again))
    share = lambda rank, w: F.coalesce(F.col(w) / (F.col("rrf_k") + F.col(rank)), F.lit(0.0))
    every = every.withColumn("rrf_score", share("dense_rank", "dense_w") + share("bm25_rank", "bm25_w") + share("sparse_rank", "sparse_w"))
    far = F.lit((1 << 31) - 1)
    ties = [F.coalesce(c, far) for c in ("dense_rank", "bm25_rank", "sparse_rank")]
    order = Window.partitionBy("config_id", "qid").orderBy(F.round("rrf_score", 12).desc(), *ties, "chunk_id")
    return every.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top_k).select("config_id", "qid", "chunk_id", "doc_id", "dense_rank", "bm25_rank", "sparse_rank", "pos")


def grid_latencies(ranked: DataFrame, grid: DataFrame, n_queries: int, repeats: int = 3, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """(config_id, p50): median milliseconds a query that fusing takes under each configuration, run by itself; a job per configuration and repeat."""
    rows = []
    for c in grid.collect():  # some hundred rows
        own = grid.where(F.col("config_id") == c.config_id)
        rows += [(c.config_id, 1000 * observed(fuse(ranked, own, top_k), n=F.count(F.lit(1)))[1] / max(n_queries, 1)) for _ in range(repeats)]
    return metrics.latency_summary(grid.sparkSession.createDataFrame(rows, "config_id int, ms double"), ["config_id"], "ms").select("config_id", "p50")


def calibrate(ranked: DataFrame, grid: DataFrame, judged: DataFrame, queries: DataFrame, top_k: int = DEFAULTS.top_k, took: DataFrame | None = None) -> DataFrame:
    """(config_id, means of METRICS, place): configurations in order of nDCG, MRR and recall@5, then number; ``ranked`` should be a written table.

    With ``took`` (config_id, p50) the faster of equal ones comes first, and p50 is a column; one that wasn't measured comes last.
    """
    every = queries.select("qid").crossJoin(F.broadcast(grid.select("config_id")))  # some hundred rows
    per = scores(fuse(ranked, grid, top_k), judged, every, "config_id")
    out = per.groupBy("config_id").agg(*[F.round(F.avg(F.col(f"`{m}`")), 6).alias(m) for m in METRICS])
    fast = []
    if took is not None:
        out, fast = out.join(took.select("config_id", "p50"), "config_id", "left"), [F.col("p50").asc_nulls_last()]
    order = Window.orderBy(F.col("`ndcg@10`").desc(), F.col("mrr").desc(), F.col("`recall@5`").desc(), *fast, "config_id")  # some hundred rows
    return out.withColumn("place", F.row_number().over(order))


def rerank_top(
    ranked: DataFrame, grid: DataFrame, calibrated: DataFrame, judged: DataFrame, queries: DataFrame, texts: DataFrame, n: int = 3, scorer: Callable[[Column, Column], Column] = overlap_score, top_k: int = DEFAULTS.top_k,
) -> DataFrame:
    """The n best configurations again, with everything that each found put in a reranker's order."""
    best = grid.join(F.broadcast(calibrated.where(F.col("place") <= n).select("config_id")), "config_id")
    hits = written(fuse(ranked, best, top_k), "to-rerank")
    asked = hits.join(queries.select("qid", F.col("text").alias("question")), "qid").join(own_texts(hits, texts), "chunk_id")
    scored = asked.withColumn("rerank_score", scorer(F.col("question"), F.col("text"))).drop("question", "text")
    order = Window.partitionBy("config_id", "qid").orderBy(F.col("rerank_score").desc_nulls_last(), "pos")
    again = scored.withColumn("pos", F.row_number().over(order))
    every = queries.select("qid").crossJoin(F.broadcast(best.select("config_id")))
    per = scores(again, judged, every, "config_id")
    out = per.groupBy("config_id").agg(*[F.round(F.avg(F.col(f"`{m}`")), 6).alias(m) for m in METRICS])
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("`ndcg@10`").desc(), F.col("mrr").desc(), F.col("`recall@5`").desc(), "config_id")))
