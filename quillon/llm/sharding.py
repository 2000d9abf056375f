"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.store import materialize

#: Groups are hashed to so many cells, so that what the differencing sees has a fixed bound at any input size.
CELLS = 65_536
#: Each shard's rows are numbered in so many independent parts.
PARTS = 256
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def differencing(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each load: k-way Karmarkar-Karp.

    The two partial partitions with the largest spread are combined again and again, the fullest part of one with the
    emptiest of the other. Ties go by position, so the result depends on the loads alone. No loads give no shards.
    """
    n = len(loads)
    out = np.zeros(n, np.int32)
    if n == 0 or shards == 1:
        return out
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, load in enumerate(loads.tolist()):
        row = np.zeros(shards, np.int64)
        row[0] = load  # descending: the load first
        sums[i] = row
        heap.append((-load, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-joint, kind="stable")
        joint = joint[order]
        node = n + len(merges)
        merges.append((a, b, order.astype(np.uint8 if shards <= 256 else np.int32)))
        sums[node] = joint
        heapq.heappush(heap, (int(joint[-1] - joint[0]), node))
    label = {heap[0][1]: np.arange(shards, dtype=np.int32)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        top = label.pop(n + k)
        placed = np.empty(shards, np.int32)
        placed[order] = top
        for node, part in ((a, placed), (b, placed[::-1])):
            if node < n:
                out[node] = part[0]
            else:
                label[node] = part
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal and equal texts stay together.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard). A null text counts as empty (16 bytes,
    CRC 0); repeated rows and null ids are placed like any other row; an empty table gives no rows; other columns are
    ignored. A group of equal texts that exceeds a fair share of bytes fills a shard alone, since it can't be divided.

    Plan: one scan to a narrow table; partial sums per hash cell (at most ``CELLS`` rows, the only thing the driver
    sees); the cell-to-shard map is broadcast (``CELLS`` rows at most); slots are numbered within (shard, part) and
    shifted by the preceding parts' counts (shards x ``PARTS`` rows), so no task holds a whole shard or a whole group.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    rows = materialize(rows, "shard-rows")
    loads = rows.groupBy("cell").agg(F.sum("size").alias("load")).orderBy("cell").toPandas()  # CELLS rows at most
    loads["shard"] = differencing(loads["load"].to_numpy(np.int64), shards)
    cell_shard = spark.createDataFrame(loads[["cell", "shard"]], "cell int, shard int")
    placed = rows.join(F.broadcast(cell_shard), "cell")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(within) - 1).alias("slot")
    )
