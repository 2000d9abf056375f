"""A search session: what a user has set, and the search under these settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings
from quillon.errors import CommandUnknown
from quillon.operators.metadata import post_filter
from quillon.plans.retrieval import Corpus, hybrid_search, merge_variants, rerank
from quillon.providers import overlap_score

MODES = ("fast", "standard", "hyde")


@dataclass(frozen=True)
class Session:
    """``docs`` None: all documents. The fast mode leaves out the reranker, hyde asks with a hypothetical answer's vector."""

    docs: tuple[str, ...] | None = None
    mode: str = "standard"
    temperature: float = 0.1
    top_k: int = DEFAULTS.top_k
    hyde: bool = False
    rewrite: bool = False
    feedback: bool = False

    def command(self, name: str, value: str | None = None) -> Session:
        """The session after a setting command (docs, mode, temp, topk, hyde, rewrite, feedback); without a value it stays as it is. Else ValueError."""
        name = name.lower().lstrip("/")
        if name not in ("docs", "mode", "temp", "topk", "hyde", "rewrite", "feedback"):
            raise CommandUnknown(f"unknown command: {name}")
        if value is None:
            return self
        if name == "docs":
            return replace(self, docs=None if value.lower() == "all" else tuple(x.strip() for x in value.split(",")))
        if name == "mode":
            if value.lower() not in MODES:
                raise CommandUnknown(f"mode is one of {', '.join(MODES)}")
            return replace(self, mode=value.lower(), hyde={"hyde": True, "standard": False}.get(value.lower(), self.hyde))
        if name == "temp":
            return replace(self, temperature=float(value))
        if name == "topk":
            return replace(self, top_k=int(value))
        if value.lower() not in ("on", "off"):
            raise CommandUnknown(f"{name} is on or off")
        return replace(self, **{name: value.lower() == "on"})


def search(
    corpus: Corpus, variants: DataFrame, texts: DataFrame, session: Session, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """(qid, chunk_id, doc_id, merged_pos, rerank_score, pos): the hits of all variants of a question under a session.

    ``variants``: qid, variant_no, text (the question itself for every variant: words are always asked as they were) and
    embedding. Of a chunk that several variants find, the first counts; the first rerank_pool are reranked and
    rerank_top_k of them stay, in the fast mode by their order alone.
    """
    spark = variants.sparkSession
    docs = None if session.docs is None else spark.createDataFrame([(x,) for x in session.docs], "doc_id string")
    key = F.concat_ws("-", F.col("qid").cast("string"), F.col("variant_no").cast("string"))
    asked = variants.select(key.alias("key"), F.col("qid").alias("own"), "variant_no", "text", "embedding")
    sparse = None if query_sparse is None else query_sparse.join(asked.select("key", F.col("own").alias("qid")), "qid").select(F.col("key").alias("qid"), "token", "weight")
    hits = hybrid_search(corpus, asked.select(F.col("key").alias("qid"), "text", "embedding"), sparse, replace(settings, top_k=session.top_k), docs)
    hits = post_filter(hits.withColumnRenamed("qid", "key"), docs).join(asked.select("key", F.col("own").alias("qid"), "variant_no"), "key")
    merged = merge_variants(hits.select("qid", "variant_no", "chunk_id", "doc_id", "final_pos"))
    question = variants.groupBy("qid").agg(F.min_by("text", "variant_no").alias("question"))
    shown = merged.join(question, "qid").join(texts.select("chunk_id", "text"), "chunk_id")
    score = None if session.mode == "fast" else scorer(F.col("question"), F.col("text"))
    out = rerank(shown, score, "merged_pos", settings.rerank_pool, settings.rerank_top_k)
    return out.select("qid", "chunk_id", "doc_id", "merged_pos", "rerank_score", F.col("rerank_pos").alias("pos"))
