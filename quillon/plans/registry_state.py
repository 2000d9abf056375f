"""Registered queries of the ingest machine, bitmap filters, batch inference and observed measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import inference
from quillon.operators import bitmaps, lifecycle
from quillon.operators.dense import dense_topk
from quillon.operators.metadata import FilterSpec
from quillon.plans.registry import _BM25, _DENSE, _TAGS, _TOK, _chunks, _corpus, _documents, _queries, _ranked, _tags, register, table
from quillon.plans.timing import observed
from quillon.streaming import machine

# -- the ingest machine: events as changes of state, users as documents of seven batches, twelve hours of silence

_SILENCE = 720
_MACHINE = f"""WITH e AS (SELECT event_id, 'b' || CAST(user_id % 7 AS VARCHAR) AS batch_id, 'u' || CAST(user_id AS VARCHAR) AS doc_id, epoch_us(ts) AS micros,
  [{", ".join(f"'{s}'" for s in machine.STEPS)}][1 + event_id % 10] AS state, {list(machine.STEPS.values())}[1 + event_id % 10] AS step FROM events),
t AS (SELECT *, count(*) FILTER (WHERE state = 'PENDING') OVER (PARTITION BY doc_id ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING) AS tries, coalesce(lead(micros) OVER (PARTITION BY doc_id ORDER BY micros, event_id), epoch_us(TIMESTAMP '2024-02-01')) AS later FROM e),
g AS (SELECT *, coalesce(micros - lag(micros) OVER (PARTITION BY doc_id, tries ORDER BY micros, event_id) > {_SILENCE * 60_000_000}, false) AS gap, coalesce(max(step) OVER (PARTITION BY doc_id, tries ORDER BY micros, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS above FROM t),
r AS (SELECT *, greatest(above, CASE WHEN bool_or(gap) OVER (PARTITION BY doc_id, tries ORDER BY micros, event_id ROWS UNBOUNDED PRECEDING) THEN 6 ELSE -1 END) AS reached FROM g),
m AS (SELECT batch_id, doc_id, event_id, micros, state, CAST(greatest(tries - 1, 0) AS INT) AS retry_count, CASE WHEN step > reached THEN 'moved' ELSE 'refused' END AS outcome FROM r
  UNION ALL SELECT batch_id, doc_id, NULL, micros + {_SILENCE * 60_000_000}, 'FAILED', CAST(greatest(tries - 1, 0) AS INT), 'stale' FROM r WHERE greatest(step, reached) < 6 AND later - micros > {_SILENCE * 60_000_000})"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in machine.STEPS]), (F.col("event_id") % 10 + 1).cast("int"))
    log = table(spark, d, "events").select("event_id", F.concat(F.lit("b"), F.col("user_id") % 7).alias("batch_id"), F.concat(F.lit("u"), "user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"))
    return machine.changes(log, F.lit("2024-02-01").cast("timestamp"), _SILENCE)


@register(f"{_MACHINE} SELECT * FROM m")
def ingest_machine(spark: SparkSession, d: str) -> DataFrame:
    """Every change of state: moved, refused, or a try that fell silent."""
    return _changes(spark, d).select("batch_id", "doc_id", "event_id", F.unix_micros("ts").alias("micros"), "state", "retry_count", "outcome")


@register(
    f"{_MACHINE}, l AS (SELECT batch_id, state FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY micros DESC, event_id DESC NULLS LAST) AS n FROM m WHERE outcome <> 'refused') WHERE n = 1),"
    " c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE state = 'COMMITTED') AS committed, count(*) FILTER (WHERE state = 'SKIPPED') AS skipped, count(*) FILTER (WHERE state = 'FAILED') AS failed, count(*) FILTER (WHERE state = 'ROLLED_BACK') AS rolled_back FROM l GROUP BY batch_id)"
    " SELECT *, CASE WHEN failed + rolled_back = 0 THEN 'COMPLETED' WHEN committed + skipped > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM c"
)
def machine_batches(spark: SparkSession, d: str) -> DataFrame:
    """Where the documents of each batch stand after all changes."""
    return lifecycle.batch_status(machine.current(_changes(spark, d)))


# -- bitmap filters


@register(f"WITH {_TAGS} SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('lang:en', 'good') GROUP BY doc_id HAVING count(DISTINCT tag) = 2) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'toxic')")
def bitmap_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter of ``filter_resolution`` by bitmaps."""
    spec = FilterSpec(tags_include=("good",), tags_exclude=("toxic",), language="en")
    return bitmaps.resolve(spec, bitmaps.build(_documents(spark, d), _tags(spark, d)))


@register(f"WITH {_TAGS} SELECT count(*) AS matched FROM documents WHERE (doc_id % 7 = 0 OR doc_id IN (SELECT doc_id FROM tags WHERE tag = 'good')) AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('lang:en', 'lang:de')) AND doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'toxic')")
def bitmap_count(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are archived or good, in one of two languages, and not toxic, counted from the bitmaps alone."""
    index = bitmaps.build(_documents(spark, d), _tags(spark, d))
    return bitmaps.count(bitmaps.combined(index, [["status:archived", "tag:good"], ["tag:lang:en", "tag:lang:de"]], ("tag:toxic",)))


_SOURCE_NO = "CAST(substr(doc_id, 4) AS INT)"
_LET = f"{_SOURCE_NO} % 2 = 0 AND {_SOURCE_NO} % 3 <> 0"


@register(f"WITH {_BM25}, {_DENSE}, {_ranked('d', 'sim', 's', 10, _LET)}, {_ranked('b', 'bm', 's', 10, _LET)} SELECT qid, chunk_id, 'dense' AS signal, rk AS place FROM d UNION ALL SELECT qid, chunk_id, 'bm25', rk FROM b")
def bitmap_search(spark: SparkSession, d: str) -> DataFrame:
    """Both searches limited by a bitmap over the sources: those with an even number that three doesn't divide."""
    docs = table(spark, d, "documents").select(F.col("source").alias("doc_id")).distinct().withColumns({"status": F.lit("active"), "source_id": F.lit(None).cast("string")})
    number = F.substring("doc_id", 4, 9).cast("int")
    tags = docs.where(number % 2 == 0).select("doc_id", F.lit("two").alias("tag")).union(docs.where(number % 3 == 0).select("doc_id", F.lit("three")))
    found = bitmaps.resolve(FilterSpec(tags_include=("two",), tags_exclude=("three",)), bitmaps.build(docs, tags))
    corpus, asked = _corpus(spark, d), _queries(spark, d)
    dense = dense_topk(corpus.vectors, asked, 10, found).select("qid", "chunk_id", F.lit("dense").alias("signal"), F.col("dense_rank").alias("place"))
    return dense.unionByName(corpus.lexical.search(asked, 10, found).select("qid", "chunk_id", F.lit("bm25").alias("signal"), F.col("bm25_rank").alias("place")))


# -- from raw text to neighbours


@register(
    f"WITH {_TOK}, hd AS (SELECT chunk_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM term), hq AS (SELECT qid, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT qid, unnest(t) AS w FROM item)),"
    " vd AS (SELECT chunk_id, h // 2 % 256 AS i, CAST(sum(1 - 2 * (h % 2)) AS DOUBLE) AS x FROM hd GROUP BY ALL), vq AS (SELECT qid, h // 2 % 256 AS i, CAST(sum(1 - 2 * (h % 2)) AS DOUBLE) AS x FROM hq GROUP BY ALL),"
    " nd AS (SELECT chunk_id, sqrt(sum(x * x)) AS n FROM vd GROUP BY ALL), nq AS (SELECT qid, sqrt(sum(x * x)) AS n FROM vq GROUP BY ALL),"
    " s AS (SELECT qid, chunk_id, sum(vd.x * vq.x) AS dot FROM vd JOIN vq USING (i) GROUP BY ALL), r AS (SELECT qid, chunk_id, dot / (nd.n * nq.n) AS s FROM s JOIN nd USING (chunk_id) JOIN nq USING (qid) WHERE nd.n > 0 AND nq.n > 0)"
    " SELECT qid, chunk_id, round(s, 6) AS similarity, k AS dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, chunk_id) AS k FROM r) WHERE k <= 10"
)
def encoded_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten documents nearest to every passage, both encoded from their whole texts."""
    docs = inference.hashed(_chunks(spark, d)).drop("text")
    asked = inference.hashed(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    return dense_topk(docs, asked, 10).select("qid", "chunk_id", F.round("similarity", 6).alias("similarity"), "dense_rank")


# -- observed measures


@register(f"WITH {_BM25}, {_ranked('b', 'bm', 's', 30)} SELECT count(*) AS n_hits, count(*) FILTER (WHERE rk = 1) AS n_queries, max(rk) AS deepest FROM b")
def observed_hits(spark: SparkSession, d: str) -> DataFrame:
    """What is observed while a search runs: hits, queries with any, and the longest list."""
    seen, _ = observed(_corpus(spark, d).lexical.search(_queries(spark, d), 30), n_hits=F.count(F.lit(1)), n_queries=F.count_if(F.col("bm25_rank") == 1), deepest=F.max("bm25_rank"))
    return spark.createDataFrame([(seen["n_hits"], seen["n_queries"], seen["deepest"])], "n_hits long, n_queries long, deepest int")
