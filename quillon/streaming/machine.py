"""The states of a document in an ingest batch as a machine over event time: a stream of state changes and its batch twin.

Events: event_id (long), batch_id, doc_id, ts, state. They count in order of (ts, event_id). PENDING begins a try, the first
one or a retry. Within a try states only go up; COMMITTED, SKIPPED and FAILED end it, ROLLED_BACK may still follow these.
Every other change is refused, but is a sign of life. A try that isn't at its end and hears nothing for over ``minutes``
fails by itself at that time; what is late for it is refused. An event with a null or unknown state, batch, document or
time is no change at all and gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.config import DEFAULTS

EVENTS = "event_id long, batch_id string, doc_id string, ts timestamp, state string"
CHANGES = "batch_id string, doc_id string, event_id long, ts timestamp, state string, retry_count int, outcome string"

#: The ten states, and how far each is.
STEPS = {
    "PENDING": 0, "VALIDATING": 1, "VALIDATED": 2, "CHUNKING": 3, "EMBEDDING": 4,
    "WRITING": 5, "COMMITTED": 6, "FAILED": 6, "ROLLED_BACK": 7, "SKIPPED": 6,
}
END = 6


def _valid(events: DataFrame) -> DataFrame:
    return events.where(F.col("state").isin(*STEPS)).dropna(subset=["batch_id", "doc_id", "ts"])


def _step(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(n)) for s, n in STEPS.items()])


def changes(events: DataFrame, now: Column, minutes: int = DEFAULTS.stale_minutes) -> DataFrame:
    """CHANGES of a whole log as of ``now``: the batch twin. Running windows over a document's events, which spill and never gather them.

    outcome: moved, refused, or stale (the row that a silent try ends with; it has no event_id).
    """
    own = Window.partitionBy("batch_id", "doc_id").orderBy("ts", "event_id")
    rows = _valid(events).select("batch_id", "doc_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "state")
    rows = rows.withColumn("step", _step(F.col("state"))).withColumn("tries", F.count_if(F.col("state") == "PENDING").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.coalesce(F.lead("ts").over(own), now))
    one = Window.partitionBy("batch_id", "doc_id", "tries").orderBy("ts", "event_id")
    silent = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier) > minutes * 60_000_000
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap", F.coalesce(silent(F.col("ts"), F.lag("ts").over(one)), F.lit(False)))
    reached = F.coalesce(F.max("step").over(before), F.lit(-1))
    late = F.max("gap").over(one.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("reached", F.greatest(reached, F.when(late, END).otherwise(-1)))
    # only what is above counts; a silent try stands at its end from then on
    rows = rows.withColumn("moved", F.col("step") > F.col("reached")).withColumn("stands", F.greatest("step", "reached"))
    retry = F.greatest(F.col("tries") - 1, F.lit(0)).cast("int").alias("retry_count")
    seen = rows.select("batch_id", "doc_id", "event_id", "ts", "state", retry, F.when(F.col("moved"), "moved").otherwise("refused").alias("outcome"))
    over = rows.where((F.col("stands") < END) & silent(F.col("next"), F.col("ts")))
    stale = over.select("batch_id", "doc_id", F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("ts"), F.lit("FAILED").alias("state"), retry, F.lit("stale").alias("outcome"))
    return seen.unionByName(stale)


def current(done: DataFrame) -> DataFrame:
    """(batch_id, doc_id, state, retry_count, updated_at): where every document stands, for :func:`quillon.operators.lifecycle.batch_status` and ``resumable``. An aggregation, so combined before it is shuffled."""
    last = F.max(F.struct("ts", "event_id", "state", "retry_count"))
    out = done.where("outcome <> 'refused'").groupBy("batch_id", "doc_id").agg(last.alias("last"))
    return out.select("batch_id", "doc_id", "last.state", "last.retry_count", F.col("last.ts").alias("updated_at"))


class _Machine(StatefulProcessor):
    """Events wait until the watermark has passed them; a timer ends a try that stays silent."""

    def __init__(self, minutes: int) -> None:
        self.limit = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, state string")
        self.place = handle.getValueState("place", "stands int, tries int, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = pd.Timestamp(r.ts).value // 1000
                self.waiting.appendValue((at, int(r.event_id), r.state))
                self.handle.registerTimer(at // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in rows if x[0] < now], [x for x in rows if x[0] >= now]
        stands, tries, at = tuple(self.place.get()) if self.place.exists() else (-1, 0, None)
        out = []

        def fall_silent(until: int) -> int:
            if at is None or stands >= END or until - at <= self.limit:
                return stands
            out.append((*key, None, at + self.limit, "FAILED", max(tries - 1, 0), "stale"))
            return END

        for when, event_id, state in due:
            stands = fall_silent(when)
            if state == "PENDING":
                stands, tries = -1, tries + 1
            moved = STEPS[state] > stands
            stands, at = max(stands, STEPS[state]), when
            out.append((*key, event_id, when, state, max(tries - 1, 0), "moved" if moved else "refused"))
        stands = fall_silent(now)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if at is not None:
            self.place.update((stands, tries, at))
            if stands < END:
                self.handle.registerTimer((at + self.limit) // 1000 + 1)
        if not out:
            yield pd.DataFrame()
            return
        found = pd.DataFrame(out, columns=["batch_id", "doc_id", "event_id", "ts", "state", "retry_count", "outcome"])
        yield found.assign(event_id=found.event_id.astype("Int64"), ts=pd.to_datetime(found.ts, unit="us"))

    def close(self) -> None:
        pass


def watched(events: DataFrame, minutes: int = DEFAULTS.stale_minutes, lateness: str = "10 minutes") -> DataFrame:
    """CHANGES of a stream, each once the watermark has passed it; needs the RocksDB state store. State: what waits, and one small row per document of a batch."""
    keyed = _valid(events).withWatermark("ts", lateness).groupBy("batch_id", "doc_id")
    return keyed.transformWithStateInPandas(_Machine(minutes), outputStructType=CHANGES, outputMode="append", timeMode="EventTime")
