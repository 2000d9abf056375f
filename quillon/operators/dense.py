"""Exact dense and sparse vector ranking for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.runtime import BROADCAST_ROWS, ship_package, written

#: Query vectors that go to the workers at once, rows that they meet in one product, and blocks that the driver holds before it writes a block's result first.
QUERY_BLOCK, ROW_BLOCK, HELD_BLOCKS = 1024, 1024, 8


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(asked: DataFrame) -> Iterator[list]:
    """Query rows in blocks whose vectors have one length."""
    for rows in batched(asked.toLocalIterator(), QUERY_BLOCK):
        for size in sorted({len(r.embedding) for r in rows}):
            yield [r for r in rows if len(r.embedding) == size]


def _first(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query (q), in order; of equal ones the smallest ids, so that a vector that many rows share adds k rows at most."""
    found = found.combine_chunks()
    q = found["q"].to_numpy()
    order = np.lexsort((pc.rank(found["chunk_id"]).to_numpy(), -np.round(found["similarity"].to_numpy(), 9), q))
    q = q[order]
    return found.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k])).combine_chunks()


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, docs: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, doc_id, similarity, dense_score, dense_rank): the k nearest chunks by cosine.

    ``vectors``: chunk_id, doc_id, embedding; ``queries``: qid, embedding; ``docs`` (doc_id) filters before ranking.
    The stated queries go against all vectors in blocks of QUERY_BLOCK: one pass and one matrix product per block, of
    which each task keeps its own k best per query, so a query's shuffle is k rows per task. Rows without a vector, or
    with one of another length than the query's, are passed over. The driver streams the queries and holds HELD_BLOCKS
    blocks; the results of further blocks are written to the shared folder before the next block is read. Equal
    similarities (9 places) go by chunk_id.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    base = vectors.where("embedding IS NOT NULL").select("chunk_id", "doc_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if docs is not None:
        base = base.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id", "doc_id", "embedding")
    asked = queries.where("embedding IS NOT NULL").select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = base.select("chunk_id", "doc_id").schema
    schema = type(schema)([queries.select("qid").schema[0], *schema.fields]).add("similarity", "double")
    qid_type = to_arrow_type(schema[0].dataType)
    out = None
    for number, block in enumerate(_blocks(asked)):
        ids = [r.qid for r in block]
        wanted = np.array([r.embedding for r in block], np.float64)
        wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, wanted=wanted) -> Iterator[pa.RecordBatch]:
            held, floor = None, np.full(len(wanted), -np.inf)
            for batch in batches:
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(2)), wanted.shape[1]))
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    some = batch.slice(at, ROW_BLOCK)
                    have = _matrix(some.column(2))
                    have /= np.maximum(np.linalg.norm(have, axis=1, keepdims=True), 1e-300)
                    similar = wanted @ have.T
                    near = np.round(similar, 9)
                    n = min(k, some.num_rows)
                    least = np.maximum(floor, np.partition(near, -n, axis=1)[:, -n])
                    q, c = np.nonzero(near >= least[:, None])
                    if not len(q):
                        continue
                    order = np.lexsort((pc.rank(some.column(0)).to_numpy()[c], -near[q, c], q))
                    q, c = q[order], c[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < n
                    q, c = q[first], c[first]
                    new = pa.table([pa.array(q), some.column(0).take(pa.array(c)), some.column(1).take(pa.array(c)), pa.array(similar[q, c])], ["q", "chunk_id", "doc_id", "similarity"])
                    held = _first(new if held is None else pa.concat_tables([held, new]), k)
                    q, s = held["q"].to_numpy(), np.round(held["similarity"].to_numpy(), 9)
                    last = np.searchsorted(q, np.arange(len(wanted))) + k - 1
                    full = last < np.searchsorted(q, np.arange(len(wanted)), "right")
                    floor[full] = s[last[full]]
            if held is not None:
                for out in held.to_batches(max_chunksize=10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in out.column(0).to_pylist()], qid_type), *out.columns[1:]], ["qid", "chunk_id", "doc_id", "similarity"])

        part = base.mapInArrow(best, schema)
        if number >= HELD_BLOCKS:
            part = written(part, "dense-block")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("qid").orderBy(F.round("similarity", 9).desc(), "chunk_id")
    ranked = out.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k)
    return ranked.withColumn("dense_score", F.greatest(F.lit(0.0), F.round("similarity", 6)))


def sparse_coverage(chunks: DataFrame, has: str) -> DataFrame:
    """(coverage): the share of rows for which the SQL predicate ``has`` holds; no rows: 0."""
    return chunks.agg(F.coalesce(F.avg(F.when(F.expr(has), 1.0).otherwise(0.0)), F.lit(0.0)).alias("coverage"))


def sparse_rank(pool: DataFrame, query_terms: DataFrame, chunk_terms: DataFrame) -> DataFrame:
    """Rank the pool (qid, chunk_id, pool_pos) by the dot product of sparse weights.

    ``query_terms``: qid, token, weight; ``chunk_terms``: chunk_id, token, weight. Every pool row is ranked, one without a
    common token with 0; equal scores keep the pool's order.

    Pool and query terms are written once. Up to BROADCAST_ROWS of each go to where the weights are, so that these aren't
    shuffled; of more queries, the weights are cut to the pool's chunks before the join.
    """
    pool, query_terms = written(pool, "pool"), written(query_terms.select("qid", "token", "weight"), "query-terms")
    weights = chunk_terms.select("chunk_id", "token", F.col("weight").alias("w"))
    if max(pool.count(), query_terms.count()) <= BROADCAST_ROWS:
        pairs = weights.join(F.broadcast(pool.select("qid", "chunk_id")), "chunk_id").join(F.broadcast(query_terms), ["qid", "token"])
    else:
        near = weights.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi")
        pairs = pool.select("qid", "chunk_id").join(query_terms, "qid").join(near, ["chunk_id", "token"])
    dots = pairs.groupBy("qid", "chunk_id").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = pool.join(dots, ["qid", "chunk_id"], "left").withColumn("sparse_score", F.coalesce("dot", F.lit(0.0))).drop("dot")
    order = Window.partitionBy("qid").orderBy(F.round("sparse_score", 9).desc(), "pool_pos")
    return scored.withColumn("sparse_rank", F.row_number().over(order))
