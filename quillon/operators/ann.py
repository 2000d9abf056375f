"""An approximate vector index by cells, with its recall measured against the exact search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import ship_package

#: Vectors that the cells' centres are fitted on, at most; rounds of fitting.
FIT_VECTORS, ROUNDS = 20_000, 8
#: Profiles: cells that a query is looked up in, of all cells.
PROFILES = {"fast": 4, "balanced": 8, "recall": 24}


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def centres(vectors: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means over FIT_VECTORS vectors at most, those with the smallest id hashes."""
    own = vectors.where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = own.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT_VECTORS).select("e").toPandas()["e"]
    if not len(rows):
        return np.zeros((0, 0))
    x = unit(np.stack([r for r in rows if len(r) == len(rows[0])]))
    at = np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)
    c = x[np.sort(at)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = unit(np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c))
    return c


def assign(vectors: DataFrame, c: np.ndarray, n: int = 1, id_col: str = "chunk_id") -> DataFrame:
    """``id_col`` and cell: the n nearest cells of every vector, in Arrow batches. Vectors of another length than the centres', or null, have none."""
    ship_package(vectors.sparkSession)
    own = vectors.where("embedding IS NOT NULL").select(id_col, F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(c):
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), c.shape[1]))
            if not batch.num_rows or not len(c):
                continue
            x = unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            k = min(n, len(c))
            cell = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k].reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), k))), pa.array(cell.astype(np.int32))], [id_col, "cell"])

    return own.mapInArrow(run, own.select(id_col).schema.add("cell", "integer"))


def search(vectors: DataFrame, queries: DataFrame, c: np.ndarray, probes: int, k: int = 50) -> DataFrame:
    """(qid, chunk_id, dense_rank): the k nearest by cosine among the vectors of each query's ``probes`` nearest cells.

    Every vector is in one cell; a query meets a cell's vectors by an equi-join on the cell, whose size Spark checks.
    """
    listed = vectors.join(assign(vectors, c), "chunk_id").select("cell", "chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.join(assign(queries, c, probes, "qid"), "qid").select("cell", "qid", F.col("embedding").cast("array<double>").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = listed.join(asked, "cell").withColumn("s", dot(F.col("q"), F.col("v")) / F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("v"), F.col("v"))))
    order = Window.partitionBy("qid").orderBy(F.round("s", 9).desc(), "chunk_id")
    return both.withColumn("dense_rank", F.row_number().over(order)).where(F.col("dense_rank") <= k).select("qid", "chunk_id", "dense_rank")
