"""Fusing rankings and spreading results over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FAR = (1 << 31) - 1


def _share(rank: str, weight: float, k: int) -> Column:
    return F.coalesce(F.lit(float(weight)) / (F.lit(k) + F.col(rank)), F.lit(0.0))


def candidate_pool(dense: DataFrame, bm25: DataFrame) -> DataFrame:
    """(qid, chunk_id, doc_id, dense_rank, bm25_rank, pool_pos): the distinct candidates, dense first, then BM25."""
    d = dense.select("qid", "chunk_id", F.col("doc_id").alias("d_doc"), "dense_rank")
    b = bm25.select("qid", "chunk_id", F.col("doc_id").alias("b_doc"), "bm25_rank")
    both = d.join(b, ["qid", "chunk_id"], "full_outer").withColumn("doc_id", F.coalesce("d_doc", "b_doc")).drop("d_doc", "b_doc")
    order = Window.partitionBy("qid").orderBy(F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "chunk_id")
    return both.withColumn("pool_pos", F.row_number().over(order))


def weighted_rrf(ranked: DataFrame, k: int = 60, dense: float = 1.0, bm25: float = 1.0, sparse: float = 1.0, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of the columns dense_rank, bm25_rank and sparse_rank (null: not in that ranking).

    Adds the three contributions, their sum rrf_score and rrf_rank. A weight of zero leaves rows listed with a
    contribution of zero. Equal scores go in the order dense, BM25, sparse rank.
    """
    for name in ("dense_rank", "bm25_rank", "sparse_rank"):
        if name not in ranked.columns:
            ranked = ranked.withColumn(name, F.lit(None).cast("int"))
    fused = ranked.withColumn("dense_part", _share("dense_rank", dense, k)).withColumn("bm25_part", _share("bm25_rank", bm25, k)).withColumn("sparse_part", _share("sparse_rank", sparse, k))
    fused = fused.withColumn("rrf_score", F.col("dense_part") + F.col("bm25_part") + F.col("sparse_part"))
    ties = [F.coalesce(c, F.lit(_FAR)) for c in ("dense_rank", "bm25_rank", "sparse_rank")]
    order = Window.partitionBy("qid").orderBy(F.round("rrf_score", 12).desc(), *ties, "chunk_id")
    fused = fused.withColumn("rrf_rank", F.row_number().over(order))
    return fused if top_k is None else fused.where(F.col("rrf_rank") <= top_k)


def rrf_three(ranked: DataFrame) -> DataFrame:
    """Equal weights, constant 60."""
    return weighted_rrf(ranked)


def document_cap(ranked: DataFrame, n: int = 3, pos: str = "rrf_rank", by: str = "doc_id") -> DataFrame:
    """At most n rows of a document per query, in order; adds final_pos."""
    if n < 1:
        raise ValueError("the cap is one row at least")
    own = Window.partitionBy("qid", by).orderBy(pos)
    kept = ranked.withColumn("in_doc", F.row_number().over(own)).where(F.col("in_doc") <= n).drop("in_doc")
    return kept.withColumn("final_pos", F.row_number().over(Window.partitionBy("qid").orderBy(pos)))


def document_mmr(ranked: DataFrame, weight: float = 0.7, pos: str = "rrf_rank", score: str = "rrf_score", by: str = "doc_id") -> DataFrame:
    """Maximal marginal relevance with one penalty per document already shown; adds mmr_score, final_pos, was_mmr_reordered.

    The greedy choice has a closed form: a document's first row always comes before its others and scores no less, so
    one sort by the penalised score gives the greedy order. Lists whose scores are all zero stay as they are.
    """
    own = Window.partitionBy("qid", by).orderBy(pos)
    top = F.max(score).over(Window.partitionBy("qid"))
    repeated = F.when(F.row_number().over(own) > 1, 1.0).otherwise(0.0)
    out = ranked.withColumn("top", top).withColumn("adjusted", F.when(F.col("top") > 0, F.lit(weight) * F.col(score) / F.col("top") - (1 - weight) * repeated).otherwise(F.lit(0.0)))
    order = Window.partitionBy("qid").orderBy(F.round("adjusted", 12).desc(), pos)
    out = out.withColumn("final_pos", F.row_number().over(order)).withColumn("mmr_score", F.round("adjusted", 6))
    return out.withColumn("was_mmr_reordered", F.col("final_pos") != F.col(pos)).drop("top", "adjusted")
