"""The cache as state against its batch twin, cache tables, sketches, and the chunker as a table function."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.functions import tables
from quillon.operators import lifecycle, markdown, sketches
from quillon.streaming import cache, jobs

START = datetime(2024, 1, 1)


def log(n=160, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["set", "get", "get", "invalidate"] if i % 3 else ["set", "get"])
        at = START + timedelta(seconds=rng.choice([30, 60]) * i)
        out.append((i, f"k{rng.randrange(4)}", at, kind, i // 60, [(i, i / 2), (i + 1, 0.5)] if kind == "set" else None))
    return out


def served(df):
    return sorted((r.event_id, r.cache_key, r.hit, [(x.chunk_id, x.score) for x in r.found] if r.found is not None else None) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    """Events out of order over several batches; what the watermark hasn't passed isn't served yet."""
    rows = log()
    shuffled = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=200 * ((r[0] * 7) % 3)), r[0]))  # late by 400 seconds at most
    last = (9999, "none", START + timedelta(days=9), "get", 0, None)
    folder = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate((shuffled[:50], shuffled[50:110], shuffled[110:], [last])):
            spark.createDataFrame(part, cache.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
            jobs.drain(cache.served(jobs.read_stream(spark, str(folder), cache.EVENTS), 300), str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = served(cache.replay(spark.createDataFrame(rows, cache.EVENTS), 300))
    got = served(spark.read.schema(cache.SERVED).parquet(str(tmp_path / "out")))
    assert got == want and {True, False} == {r[2] for r in want}


@pytest.mark.parametrize("age, hit", [(299, True), (300, False), (301, False)])
def test_time_to_live_ends_sharply(spark, age, hit):
    rows = [(1, "k", START, "set", 0, [(1, 1.0)]), (2, "k", START + timedelta(seconds=age), "get", 0, None), (3, "k", START + timedelta(seconds=5), "get", 1, None), (4, "other", START, "get", 0, None)]
    assert [(r[0], r[2]) for r in served(cache.replay(spark.createDataFrame(rows, cache.EVENTS), 300))] == [(2, hit), (3, False), (4, False)]


def test_cache_tables(spark):
    schema = "cache_key string, corpus_fp string, created long, hits int, last_access long"
    have = spark.createDataFrame([("a", "f", 1, 3, 1), ("b", "f", 1, 0, 1)], schema)
    new = spark.createDataFrame([("a", "g", 5, 0, 0), ("a", "h", 7, 0, 0), ("c", "g", 5, 0, 0)], schema)
    after = lifecycle.cache_set(have, new)
    assert sorted((r.cache_key, r.corpus_fp, r.hits) for r in after.collect()) == [("a", "h", 0), ("b", "f", 0), ("c", "g", 0)] and after.columns == have.columns
    left = lifecycle.cache_invalidate(after, spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "cache_key string"))
    assert sorted(r.cache_key for r in left.collect()) == ["b", "c"]
    gone = lifecycle.cache_clear(after)
    assert gone.count() == 0 and gone.schema == after.schema


def test_sketches_merge(spark):
    rows = spark.range(20000).selectExpr("id % 3 AS k", "timestamp_seconds(id * 40) AS ts", "CAST(pow(id * 7919 % 10007, 2) AS DOUBLE) AS value", "id % 700 AS user_id")
    states = sketches.hourly(rows, ["k"])
    one, two = states.where("hour < TIMESTAMP '1970-01-05'"), states.where("hour >= TIMESTAMP '1970-01-05'")
    both = sketches.merged(one, ["k"]).unionByName(sketches.merged(two, ["k"]))  # states of states
    for r in sketches.summary(both, ["k"]).collect():
        own = sorted(x.value for x in rows.where(F.col("k") == r.k).collect())
        rank = lambda v: sum(x <= v for x in own) / len(own)  # noqa: B023, E731
        assert r.n == len(own) and abs(r.mean - sum(own) / len(own)) < 1e-3 and abs(r.n_users / 700 - 1) < 0.05
        assert all(abs(rank(v) - q) < 0.02 for v, q in ((r.p50, 0.5), (r.p95, 0.95), (r.p99, 0.99)))
    empty = sketches.summary(sketches.hourly(spark.createDataFrame([(1, None, START, None)], "k int, value double, ts timestamp, user_id long"), ["k"]), ["k"]).first()
    assert (empty.n, empty.p50, empty.n_users) == (0, None, 0)


def test_chunks_by_lateral_join(spark):
    text = "# A\n\n" + "word " * 300 + "\n\n## B\n\n|a|b|\n|---|---|\n|1|2|\n\n" + "more " * 900
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", " "), ("d", "plain text " * 40)], "doc_id string, text string")
    tables.register(spark)
    docs.createOrReplaceTempView("docs_to_chunk")
    got = spark.sql("SELECT c.* FROM docs_to_chunk d, LATERAL quillon_chunks(d.doc_id, d.text) c")
    want = markdown.chunk_documents(docs)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 3
    small = spark.sql("SELECT c.* FROM docs_to_chunk d, LATERAL quillon_chunks(d.doc_id, d.text, 100, 10) c")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, markdown.chunk_documents(docs, most=100, overlap=10).collect()))
