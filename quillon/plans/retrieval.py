"""Query plans: hybrid search over a batch of queries, its presets, and what follows up to the reranked list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings
from quillon.functions.text import last_terms, without_stop_words
from quillon.operators.dense import dense_topk, sparse_coverage, sparse_rank
from quillon.operators.fusion import candidate_pool, document_cap, document_mmr, weighted_rrf
from quillon.operators.lexical import LexicalIndex
from quillon.providers import overlap_score
from quillon.runtime import held, written
from quillon.sources.log import names_in
from quillon.sources.segments import IndexView, SegmentIndex

#: Presets: signals used, and diversity (off, cap or mmr).
VARIANTS = {
    "dense": (("dense",), "off"),
    "bm25": (("bm25",), "off"),
    "dense_bm25": (("dense", "bm25"), "off"),
    "hybrid": (("dense", "bm25", "sparse"), "off"),
    "hybrid_cap": (("dense", "bm25", "sparse"), "cap"),
    "hybrid_mmr": (("dense", "bm25", "sparse"), "mmr"),
    "full": (("dense", "bm25", "sparse"), "off"),
    "full_hyde": (("dense", "bm25", "sparse"), "off"),
}
#: Presets whose whole list is put in a reranker's order.
RERANKED = ("full", "full_hyde")


@dataclass
class Corpus:
    """What a search reads: vectors(chunk_id, doc_id, embedding), the lexical index, sparse(chunk_id, token, weight), and by which column diversity counts."""

    vectors: DataFrame
    lexical: LexicalIndex | IndexView
    sparse: DataFrame | None = None
    coverage: DataFrame | None = None  # (coverage), one row: the share of chunks with sparse weights, where it is known

    def sparse_share(self) -> float:
        """Share of chunks that have sparse weights."""
        if self.coverage is not None:
            return self.coverage.first()[0] or 0.0
        have = self.sparse.select("chunk_id").distinct().withColumn("has", F.lit(True))
        return sparse_coverage(self.lexical.lengths.join(have, "chunk_id", "left"), "has").first()[0]


def diversity_mode(mode: str | None, settings: Settings) -> str:
    """None: the settings decide, the cap before MMR."""
    if mode is not None:
        return mode
    return "cap" if settings.cap_on else "mmr" if settings.mmr_on else "off"


def diversify(ranked: DataFrame, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    if mode == "cap":
        return document_cap(ranked, settings.cap_n)
    if mode == "mmr":
        return document_mmr(ranked, settings.mmr_lambda)
    if mode != "off":
        raise ValueError(f"unknown diversity mode: {mode}")
    return ranked.withColumn("final_pos", F.col("rrf_rank"))


def hybrid_search(
    corpus: Corpus, queries: DataFrame, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, docs: DataFrame | None = None, diversity: str | None = None,
    signals: tuple[str, ...] = ("dense", "bm25", "sparse"),
) -> DataFrame:
    """Rank chunks for every query (qid, text, embedding): per-signal candidates, pool, sparse re-scoring, fusion, diversity.

    ``docs`` (doc_id): only these; an empty table gives no rows, None no filter. Each signal contributes
    candidate_multiplier x top_k candidates; the sparse stage is left out if fewer than ``sparse_coverage`` of the
    chunks have weights. Ids alone go through the windows; text is joined to what is left by the caller.
    """
    return diversify(fused_search(corpus, queries, query_sparse, settings, docs, signals), diversity_mode(diversity, settings), settings)


def fused_search(
    corpus: Corpus, queries: DataFrame, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, docs: DataFrame | None = None, signals: tuple[str, ...] = ("dense", "bm25", "sparse")
) -> DataFrame:
    """:func:`hybrid_search` up to the fused list, on which presets differ in diversity and reranking alone."""
    k = settings.candidate_multiplier * settings.top_k
    nothing = queries.where("false")
    dense = dense_topk(corpus.vectors, queries if "dense" in signals else nothing, k, docs)
    lexical = corpus.lexical.search(queries if "bm25" in signals else nothing, k, docs)
    pool = candidate_pool(dense, lexical)
    if "sparse" in signals and corpus.sparse is not None and query_sparse is not None:
        if corpus.sparse_share() >= settings.sparse_coverage:
            pool = sparse_rank(pool, query_sparse, corpus.sparse)
    return weighted_rrf(pool, settings.rrf_k, settings.dense_weight, settings.bm25_weight, settings.sparse_weight, settings.top_k)


def own_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(chunk_id, text) of the chunks that ``hits`` (a written table) name: texts are cut where they are read, before they are shuffled to the hits."""
    return texts.select("chunk_id", "text").join(held(hits).select("chunk_id").distinct(), "chunk_id", "left_semi")


def searched_as(name: str, queries: DataFrame) -> tuple[tuple[str, ...], bool]:
    """What a preset's fused list depends on: its signals, and whether it asks with the hypothetical answer's vector."""
    return VARIANTS[name][0], name == "full_hyde" and "hyde_embedding" in queries.columns


def run_variant(
    name: str, corpus: Corpus, queries: DataFrame, query_sparse: DataFrame | None = None, settings: Settings = DEFAULTS, docs: DataFrame | None = None, texts: DataFrame | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_score, fused: DataFrame | None = None,
) -> DataFrame:
    """One preset; ``full`` and ``full_hyde`` then put all that they found in the order of a reranker.

    ``scorer`` gives a score from the query's and the chunk's text (``texts``: chunk_id, text); without texts there is
    no reranker, and the order stays. ``full_hyde`` takes the hypothetical answer's vector from a column hyde_embedding
    where there is one. ``fused``: the list that :func:`fused_search` gave already for a preset with the same :func:`searched_as`.
    """
    signals, hyde = searched_as(name, queries)
    if fused is None:
        if hyde:
            queries = queries.withColumn("embedding", F.coalesce("hyde_embedding", "embedding"))
        fused = fused_search(corpus, queries, query_sparse, settings, docs, signals)
    hits = diversify(fused, VARIANTS[name][1], settings)
    if name in RERANKED and texts is not None:
        hits = written(hits, "to-rerank")
        asked = queries.select("qid", F.col("text").alias("question"))
        ranked = rerank(hits.join(asked, "qid").join(own_texts(hits, texts), "chunk_id"), scorer(F.col("question"), F.col("text")), pool=settings.top_k)
        hits = ranked.drop("question", "text").withColumn("final_pos", F.col("rerank_pos"))
    return hits.withColumn("variant", F.lit(name))


def explain(ranked: DataFrame) -> DataFrame:
    """Which signals found each hit, at which ranks, and whether diversity moved it."""
    flags = [F.col(f"{s}_rank").isNotNull().alias(f"in_{s}_topk") for s in ("dense", "bm25", "sparse") if f"{s}_rank" in ranked.columns]
    moved = F.col("was_mmr_reordered") if "was_mmr_reordered" in ranked.columns else F.lit(False)
    return ranked.select("qid", "chunk_id", "doc_id", "final_pos", "rrf_rank", *[c for c in ("dense_rank", "bm25_rank", "sparse_rank") if c in ranked.columns], *flags, moved.alias("was_mmr_reordered"))


def expand_queries(queries: DataFrame) -> DataFrame:
    """(qid, variant_no, type, text): the query, its key terms, its last five key terms; equal texts once."""
    every = queries.select(
        "qid",
        F.posexplode(F.array(
            F.struct(F.lit("original").alias("type"), F.col("text").alias("t")), F.struct(F.lit("stopword").alias("type"), without_stop_words(F.col("text")).alias("t")),
            F.struct(F.lit("last_terms").alias("type"), last_terms(F.col("text")).alias("t")),
        )).alias("variant_no", "v"),
    )
    every = every.select("qid", "variant_no", "v.type", F.col("v.t").alias("text"))
    first = Window.partitionBy("qid", "text").orderBy("variant_no")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def merge_variants(hits: DataFrame) -> DataFrame:
    """One row per (qid, chunk_id) of several variants' hits: the first by (variant_no, final_pos); adds merged_pos."""
    first = Window.partitionBy("qid", "chunk_id").orderBy("variant_no", "final_pos")
    kept = hits.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return kept.withColumn("merged_pos", F.row_number().over(Window.partitionBy("qid").orderBy("variant_no", "final_pos")))


def rerank(hits: DataFrame, score: Column | None, pos: str = "final_pos", pool: int = DEFAULTS.rerank_pool, top_k: int | None = None) -> DataFrame:
    """The first ``pool`` hits by a scorer's column, stable on ties; without a scorer the order stays and the score is null."""
    kept = hits.where(F.col(pos) <= pool).withColumn("rerank_score", F.lit(None).cast("double") if score is None else score.cast("double"))
    order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc_nulls_last(), pos)
    out = kept.withColumn("rerank_pos", F.row_number().over(order)).withColumn("rerank_status", F.lit("skipped" if score is None else "scored"))
    return out if top_k is None else out.where(F.col("rerank_pos") <= top_k)


def presets(**changes: object) -> Settings:
    return replace(DEFAULTS, **changes)


def write_corpus(corpus: Corpus, root: str) -> None:
    """Write the plain tables of a corpus once for many searches. A search over them reads all postings; :func:`index_corpus` writes an index that is read by address."""
    root = root.rstrip("/")
    corpus.vectors.write.mode("overwrite").parquet(f"{root}/vectors")
    corpus.lexical.postings.sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{root}/postings")
    corpus.lexical.lengths.write.mode("overwrite").parquet(f"{root}/lengths")
    corpus.lexical.terms.write.mode("overwrite").parquet(f"{root}/terms")
    corpus.lexical.stats.write.mode("overwrite").parquet(f"{root}/stats")
    if corpus.sparse is not None:
        corpus.sparse.repartition("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(f"{root}/sparse")


def index_corpus(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, root: str) -> None:
    """Write the index of ``chunks`` (chunk_id, doc_id, text) as a first segment, to which later ones may be added; the texts are read and tokenized once.

    Sparse weights are the postings' term counts, so no table of their own is written.
    """
    root = root.rstrip("/")
    SegmentIndex(spark, f"{root}/lexical").add(chunks)
    vectors.write.mode("overwrite").parquet(f"{root}/vectors")


def read_corpus(spark: SparkSession, root: str, sparse: bool = True) -> Corpus:
    """A written index; where it has no table of sparse weights, term counts stand in."""
    root = root.rstrip("/")
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    there = names_in(spark, root)
    if "lexical" in there:
        lexical = SegmentIndex(spark, f"{root}/lexical").view()
    else:
        lexical = LexicalIndex(read("postings"), read("terms"), read("lengths"), read("stats"))
    if not sparse:
        return Corpus(read("vectors"), lexical)
    if "sparse" in there:
        return Corpus(read("vectors"), lexical, read("sparse"))
    weights = lexical.counts.select("chunk_id", F.col("term").alias("token"), F.col("tf").cast("double").alias("weight"))
    return Corpus(read("vectors"), lexical, weights, sparse_coverage(lexical.lengths, "len > 0"))
