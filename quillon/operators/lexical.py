"""Lexical index and BM25 ranking over plain tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillon.functions.text import phrases, tokens
from quillon.runtime import held, ship_package, written

#: BM25 constants, and the weight of a phrase that more than half of the chunks have.
K1, B, FLOOR_IDF = 1.2, 0.75, 1e-6


@dataclass
class LexicalIndex:
    """postings(term, chunk_id, doc_id, len, tf, positions), terms(term, df, cf), lengths(chunk_id, doc_id, len) and stats(n, avg_len), one row.

    A posting carries its chunk's length and document, so that scoring needs no join with the table of all chunks.
    """

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame

    @property
    def counts(self) -> DataFrame:
        """(term, chunk_id, tf) of every posting."""
        return self.postings.select("term", "chunk_id", "tf")

    def search(self, queries: DataFrame, k: int = 30, docs: DataFrame | None = None, qid: str = "qid", text_col: str = "text") -> DataFrame:
        return bm25(self, queries, k, docs, qid, text_col)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token lists to postings: one sort of a batch's tokens by term and chunk, stable, so that positions ascend; rows of one term stand together, which packs well."""
    for batch in batches:
        tokens_of = batch.column(2)
        size = pc.fill_null(pc.list_value_length(tokens_of), 0).to_numpy().astype(np.int64)
        coded = tokens_of.flatten().dictionary_encode()
        n = max(1, len(size))
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        key = coded.indices.to_numpy().astype(np.int64) * n + row
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(heads, len(key)).astype(np.int32)
        own = pa.array(key[heads] % n)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(key[heads] // n)), batch.column(0).take(own), batch.column(1).take(own), pa.array(size[key[heads] % n].astype(np.int32)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))],
            ["term", "chunk_id", "doc_id", "len", "tf", "positions"],
        )


def post(chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional postings of all chunks, positions ascending. Tokens are built-in expressions; a chunk's are grouped where they are, in Arrow batches: nothing is shuffled.

    Chunk ids are taken to be unique; null texts have no postings.
    """
    ship_package(chunks.sparkSession)
    base = chunks.select(F.col(id_col).alias("chunk_id"), F.col(doc_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    ids = base.select("chunk_id", "doc_id").schema
    schema = StructType([StructField("term", StringType()), *ids.fields]).add("len", "integer").add("tf", "integer").add("positions", ArrayType(IntegerType()))
    return base.mapInArrow(_group, schema)


def index_of(postings: DataFrame, chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id") -> LexicalIndex:
    """The other tables of an index from its postings (read twice, so better a written table) and the ids of all chunks."""
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    own = postings.groupBy("chunk_id").agg(F.max("len").alias("len"))
    every = chunks.select(F.col(id_col).alias("chunk_id"), F.col(doc_col).alias("doc_id"))
    lengths = every.join(own, "chunk_id", "left").select("chunk_id", "doc_id", F.coalesce("len", F.lit(0)).alias("len"))
    return LexicalIndex(postings, terms, lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of all chunks as a plan; :func:`quillon.plans.retrieval.write_corpus` writes it once for many searches."""
    return index_of(post(chunks, id_col, doc_col, text_col), chunks, id_col, doc_col)


def phrase_matches(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, doc_id, len, tf) of phrases, as if each were a term: its words stand one after the other, tf times.

    ``asked``: term (the phrase's name), words; a written table, whose size tells Spark whether to broadcast it. Postings
    of its words alone are read with their positions and meet by (phrase, chunk), so a common word makes no key hot.
    """
    words = asked.select("term", F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
    here = postings.select(F.col("term").alias("word"), "chunk_id", "doc_id", "len", "positions")
    found = here.join(words, "word").withColumn("starts", F.transform("positions", lambda p: p - F.col("j")))
    whole = found.groupBy("term", "chunk_id", "doc_id", "len", "n").agg(F.collect_list("starts").alias("lists")).where(F.size("lists") == F.col("n"))
    tf = F.size(F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b)))
    return whole.select("term", "chunk_id", "doc_id", "len", tf.alias("tf")).where("tf > 0")


def bm25(index: LexicalIndex, queries: DataFrame, k: int = 30, docs: DataFrame | None = None, qid: str = "qid", text_col: str = "text") -> DataFrame:
    """(qid, chunk_id, doc_id, bm25_score, bm25_rank): the k best chunks that have every phrase of the query.

    Phrase weights come from all chunks, also under a document filter ``docs`` (doc_id). Equal scores go by chunk_id. Of
    rows with one chunk id each term counts once, with its best score.

    What is asked, with frequencies, is written once (its size then tells Spark whether to broadcast it). Of each query
    the rarest phrase's chunks are the candidates; the other phrases are looked up there alone, by (term, chunk).
    """
    parsed = queries.select(F.col(qid).alias("qid"), phrases(F.col(text_col)).alias("p"))
    parts = parsed.select("qid", F.explode("p").alias("words")).withColumn("term", F.array_join("words", " "))
    asks = written(parts.groupBy("qid", "term").agg(F.count(F.lit(1)).cast("int").alias("times"), F.first("words").alias("words")), "asked")
    lists = index.postings.select("term", "chunk_id", "doc_id", "len", "tf")
    terms = index.terms.select("term", "df")
    long = asks.where(F.size("words") > 1).select("term", "words").dropDuplicates(["term"])
    if not long.isEmpty():
        found = written(phrase_matches(index.postings, long), "phrases")
        lists = lists.unionByName(found)
        terms = terms.unionByName(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    every = Window.partitionBy("qid")
    known = asks.join(terms, "term", "left").withColumn("n_terms", F.count(F.lit(1)).over(every)).withColumn("have", F.count("df").over(every))
    known = known.where("have = n_terms").withColumn("k", F.row_number().over(every.orderBy("df", "term")))
    known = held(written(known.select("qid", "term", "times", "df", "n_terms", "k"), "weighed"))
    candidates = lists.join(known.where("k = 1").select("qid", "term"), "term").select("qid", "chunk_id", "doc_id")
    if docs is not None:
        candidates = candidates.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = candidates.select("qid", "chunk_id").distinct().join(known.select("qid", "term", "times", "df", "n_terms"), "qid")
    asked = lists.join(known.select("term").distinct(), "term", "left_semi")
    scored = pairs.join(asked, ["term", "chunk_id"]).crossJoin(F.broadcast(index.stats))  # one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(FLOOR_IDF)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    each = scored.withColumn("part", part).repartition("qid", "chunk_id").groupBy("qid", "chunk_id", "term", "n_terms").agg(F.max("part").alias("part"), F.min("doc_id").alias("doc_id"))
    total = each.groupBy("qid", "chunk_id", "n_terms").agg(F.sum("part").alias("bm25_score"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("have")).where("have = n_terms")
    order = Window.partitionBy("qid").orderBy(F.round("bm25_score", 9).desc(), "chunk_id")
    return total.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= k).select("qid", "chunk_id", "doc_id", "bm25_score", "bm25_rank")
