"""Streaming front ends: incremental ingest, feedback windows, sessions and stale runs. Batch twins give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.config import DEFAULTS

#: How late an event may be.
LATENESS = f"{DEFAULTS.stale_minutes} minutes"


def read_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(kind)
    return (r.option("pathGlobFilter", glob) if glob else r).load(folder)


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts and sums by event time; with ``slide`` windows overlap."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", LATENESS).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, finish, n): a user's events less than the gap apart."""
    out = events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    if events.isStreaming:
        return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def stale_from_log(log: DataFrame, minutes: int = DEFAULTS.stale_minutes) -> DataFrame:
    """(run_id, started_at) of runs without an end within ``minutes`` of event time: windows per run close when the watermark passes."""
    out = log.withWatermark("ts", "0 seconds").groupBy(F.session_window("ts", f"{minutes} minutes"), "run_id").agg(F.min("ts").alias("started_at"), F.max(F.col("state") != "IN_PROGRESS").alias("ended"))
    return out.where(~F.col("ended")).select("run_id", "started_at")


def ingest(files: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Publish each micro-batch of new documents; ``publish`` gets the batch number, so that a repeat changes nothing."""
    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming query over all there is now, into Parquet, and wait."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
