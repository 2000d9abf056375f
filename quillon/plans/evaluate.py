"""From a suite to verified, scored answers: one job over all queries; failures are a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings
from quillon.functions.text import abstains, approx_tokens, strip_citations
from quillon.operators import context, verification
from quillon.providers import overlap_score
from quillon.plans.retrieval import rerank


def contexts(hits: DataFrame, questions: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """qid, pos, chunk and score of what a prompt would hold: reranked hits that fit the window, in order."""
    rows = hits.join(questions.select("qid", F.col("text").alias("question")), "qid").join(chunks.drop("doc_id"), "chunk_id")
    best = rerank(rows, overlap_score(F.col("question"), F.col("text")), pool=settings.rerank_pool, top_k=settings.rerank_top_k).withColumn("pos", F.col("rerank_pos"))
    shown = context.render_chunk(F.col("pos"), F.col("doc_id"), F.col("heading_path"), F.col("line_start"), F.col("line_end"), F.col("text"))
    sized = best.withColumn("n_tokens", approx_tokens(shown)).withColumn("base", approx_tokens(F.col("question")) + 200)
    packed = context.pack(sized, F.col("base"), settings).select("qid", "used", "status")
    kept = sized.join(packed, "qid").where(F.array_contains("used", F.col("chunk_id")))
    order = Window.partitionBy("qid").orderBy("pos")
    return kept.withColumn("prompt_index", F.row_number().over(order)).select("qid", "pos", "prompt_index", "chunk_id", "doc_id", "heading_path", "line_start", "line_end", "text", "rerank_score")


def evaluate(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(qid, answer_for_eval, abstains, trust_score, trust_level, error) of answers (qid, answer, consistency) against what their prompts showed."""
    cited = verification.classify(verification.citations(answers), shown)
    scores = verification.trust(answers, cited, shown)
    error = F.when(F.col("answer").isNull(), "no_answer").otherwise("")
    out = answers.join(scores.select("qid", "trust_score", "trust_level"), "qid")
    return out.select("qid", strip_citations(F.coalesce("answer", F.lit(""))).alias("answer_for_eval"), abstains(F.col("answer"), F.col("trust_score")).alias("abstains"), "trust_score", "trust_level", error.alias("error"))


def no_answer_correctness(rows: DataFrame, negative: str = "negative") -> DataFrame:
    """(correctness): the share of negative questions that were declined; null without any."""
    return rows.where(F.col(negative)).agg(F.avg(F.col("abstains").cast("double")).alias("correctness"))


def ranking_overlap(exact: DataFrame, other: DataFrame, k: int = 50) -> DataFrame:
    """(recall): the mean share of the exact first k that another index's first k has, per query."""
    top = lambda df: df.where(F.col("dense_rank") <= k).select("qid", "chunk_id")
    per = top(exact).join(top(other).withColumn("hit", F.lit(1)), ["qid", "chunk_id"], "left").groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("r"))
    return per.agg(F.avg("r").alias("recall"))
