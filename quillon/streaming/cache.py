"""The result cache as keyed state: set, get, invalidate, and clear by epoch; a stream of events and its batch twin.

Events: event_id (long), cache_key, ts, kind (set, get or invalidate), epoch (int; a clear begins a new one), found (the
results of a set: array of struct(chunk_id, score)). A get hits if the last other event of its key before it, by (ts,
event_id), is a set of the same epoch that is younger than the time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.config import DEFAULTS

EVENTS = "event_id long, cache_key string, ts timestamp, kind string, epoch int, found array<struct<chunk_id: long, score: double>>"
SERVED = "event_id long, cache_key string, hit boolean, found array<struct<chunk_id: long, score: double>>"


def replay(events: DataFrame, ttl_seconds: int = DEFAULTS.cache_ttl_seconds) -> DataFrame:
    """SERVED rows of every get: the batch twin. One window per key."""
    before = Window.partitionBy("cache_key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("kind") != "get", F.struct("kind", "ts", "epoch", "found"))
    last = events.withColumn("last", F.last(other, ignorenulls=True).over(before)).where("kind = 'get'")
    young = F.col("ts").cast("double") - F.col("last.ts").cast("double") < ttl_seconds
    hit = F.coalesce((F.col("last.kind") == "set") & F.col("epoch").eqNullSafe(F.col("last.epoch")) & young, F.lit(False))
    return last.select("event_id", "cache_key", hit.alias("hit"), F.when(hit, F.col("last.found")).alias("found"))


class _Cache(StatefulProcessor):
    """A key's events wait until the watermark has passed them, so that late ones are served in order; then the entry is read or changed."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, at double, kind string, epoch int, chunks array<long>, scores array<double>")
        self.entry = handle.getValueState("entry", "at double, epoch int, chunks array<long>, scores array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                found = r.found if r.found is not None else []
                epoch = None if pd.isna(r.epoch) else int(r.epoch)
                at = r.ts.timestamp()
                self.waiting.appendValue((int(r.event_id), at, r.kind, epoch, [int(x["chunk_id"]) for x in found], [float(x["score"]) for x in found]))
                self.handle.registerTimer(int(at * 1000) + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[1], x[0]))
        due, later = [x for x in rows if x[1] < now], [x for x in rows if x[1] >= now]
        if not due:
            if self.entry.exists() and now - self.entry.get()[0] >= self.ttl:
                self.entry.clear()
            yield pd.DataFrame()
            return
        out, entry = [], tuple(self.entry.get()) if self.entry.exists() else None
        for i, at, kind, epoch, chunks, scores in due:
            if kind == "get":
                hit = entry is not None and entry[1] == epoch and at - entry[0] < self.ttl
                out.append((i, key[0], hit, [{"chunk_id": int(c), "score": float(s)} for c, s in zip(entry[2], entry[3])] if hit else None))
            else:
                entry = (at, epoch, list(chunks), list(scores)) if kind == "set" else None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
            self.handle.registerTimer(int((entry[0] + self.ttl) * 1000) + 1)  # state doesn't outlive what it may serve
        yield pd.DataFrame(out, columns=["event_id", "cache_key", "hit", "found"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def served(events: DataFrame, ttl_seconds: int = DEFAULTS.cache_ttl_seconds, lateness: str = "10 minutes") -> DataFrame:
    """SERVED rows of a stream's gets, each once the watermark has passed it; needs the RocksDB state store."""
    keyed = events.withWatermark("ts", lateness).groupBy("cache_key")
    return keyed.transformWithStateInPandas(_Cache(ttl_seconds), outputStructType=SERVED, outputMode="append", timeMode="EventTime")
