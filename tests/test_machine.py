"""The ingest machine: rules by example, the batch twin against a loop, and the stream against the batch twin."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillon.operators import lifecycle
from quillon.streaming import jobs, machine

START = datetime(2024, 1, 1)
END = START + timedelta(days=9)


def at(minutes):
    return START + timedelta(minutes=minutes)


def told(df):
    return sorted(((r.batch_id, r.doc_id, r.ts, r.event_id if r.event_id is not None else -1, r.state, r.retry_count, r.outcome) for r in df.collect()))


def run(spark, rows, now=END, minutes=30):
    return told(machine.changes(spark.createDataFrame(rows, machine.EVENTS), F.lit(now), minutes))


def log(n=240, seed=5):
    rng = random.Random(seed)
    states = list(machine.STEPS)
    return [(i, f"b{rng.randrange(2)}", f"d{rng.randrange(4)}", at(rng.choice([2, 3, 5]) * i), rng.choice(["PENDING", *states])) for i in range(n)]


def by_loop(rows, now, minutes):
    """A plain walk over each document's events."""
    limit, out = timedelta(minutes=minutes), []
    for key in sorted({r[1:3] for r in rows}):
        stands, tries, last = -1, 0, None
        for i, _, _, when, state in [*sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[3], r[0])), (None, *key, now, None)]:
            if last is not None and stands < 6 and when - last > limit:
                out.append((*key, last + limit, -1, "FAILED", max(tries - 1, 0), "stale"))
                stands = 6
            if state is None:
                continue
            if state == "PENDING":
                stands, tries = -1, tries + 1
            out.append((*key, when, i, state, max(tries - 1, 0), "moved" if machine.STEPS[state] > stands else "refused"))
            stands, last = max(stands, machine.STEPS[state]), when
    return sorted(out)


def test_rules(spark):
    way = ["PENDING", "VALIDATING", "VALIDATED", "CHUNKING", "EMBEDDING", "WRITING", "COMMITTED", "ROLLED_BACK"]
    assert [r[6] for r in run(spark, [(i, "b", "d", at(i), s) for i, s in enumerate(way)])] == ["moved"] * 8
    back = run(spark, [(1, "b", "d", at(1), "PENDING"), (2, "b", "d", at(2), "EMBEDDING"), (3, "b", "d", at(3), "VALIDATING"), (4, "b", "d", at(4), "FAILED"), (5, "b", "d", at(5), "COMMITTED"), (6, "b", "d", at(6), "PENDING"), (7, "b", "d", at(7), "SKIPPED")])
    assert [(r[4], r[5], r[6]) for r in back] == [("PENDING", 0, "moved"), ("EMBEDDING", 0, "moved"), ("VALIDATING", 0, "refused"), ("FAILED", 0, "moved"), ("COMMITTED", 0, "refused"), ("PENDING", 1, "moved"), ("SKIPPED", 1, "moved")]


def test_silence_ends_a_try_sharply(spark):
    one = lambda minutes: [(r[4], r[6]) for r in run(spark, [(1, "b", "d", at(0), "PENDING"), (2, "b", "d", at(minutes), "WRITING")], now=at(minutes))]
    assert one(30) == [("PENDING", "moved"), ("WRITING", "moved")]
    assert one(31) == [("PENDING", "moved"), ("FAILED", "stale"), ("WRITING", "refused")]
    assert run(spark, [(1, "b", "d", at(0), "CHUNKING")], now=at(30))[-1][6] == "moved"
    assert run(spark, [(1, "b", "d", at(0), "CHUNKING")], now=at(31))[-1][2:] == (at(30), -1, "FAILED", 0, "stale")
    assert len(run(spark, [(1, "b", "d", at(0), "COMMITTED")])) == 1


def test_what_is_no_change(spark):
    rows = [(1, "b", "d", None, "PENDING"), (2, None, "d", at(1), "PENDING"), (3, "b", None, at(1), "PENDING"), (4, "b", "d", at(1), None), (5, "b", "d", at(1), "RUNNING")]
    assert run(spark, rows) == [] and run(spark, spark.createDataFrame([], machine.EVENTS).collect()) == []
    twice = [(1, "b", "d", at(0), "COMMITTED"), (1, "b", "d", at(0), "COMMITTED")]
    assert [r[6] for r in run(spark, twice)] == ["moved", "refused"]


def test_batch_equals_a_loop(spark):
    rows = log()
    got = run(spark, rows, minutes=20)
    assert got == by_loop(rows, END, 20) and {r[6] for r in got} == {"moved", "refused", "stale"}


def test_stream_equals_batch(spark, tmp_path):
    """Events out of order over several batches; the last one of another document moves the watermark."""
    rows = log()
    shuffled = sorted(rows, key=lambda r: (r[3] + timedelta(minutes=3 * ((r[0] * 7) % 3)), r[0]))  # late by six minutes at most
    folder = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (shuffled[:90], shuffled[90:160], shuffled[160:], [(9999, "z", "z", END, "COMMITTED")]):
            spark.createDataFrame(part, machine.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
            jobs.drain(machine.watched(jobs.read_stream(spark, str(folder), machine.EVENTS), 20), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert told(spark.read.schema(machine.CHANGES).parquet(str(tmp_path / "out"))) == by_loop(rows, END, 20)


def test_where_documents_stand(spark):
    rows = [(1, "b", "d1", at(0), "PENDING"), (2, "b", "d1", at(1), "COMMITTED"), (3, "b", "d2", at(0), "PENDING"), (4, "b", "d3", at(0), "FAILED"), (5, "b", "d3", at(2), "PENDING"), (6, "b", "d3", at(3), "FAILED"), (7, "b", "d3", at(3), "PENDING"), (8, "b", "d3", at(3), "SKIPPED")]
    stand = machine.current(machine.changes(spark.createDataFrame(rows, machine.EVENTS), F.lit(END)))
    assert sorted((r.doc_id, r.state, r.retry_count) for r in stand.collect()) == [("d1", "COMMITTED", 0), ("d2", "FAILED", 0), ("d3", "SKIPPED", 1)]
    assert lifecycle.batch_status(stand).first().status == "PARTIAL"
    assert [(r.doc_id, r.retry_count) for r in lifecycle.resumable(stand).collect()] == [("d2", 1)]
