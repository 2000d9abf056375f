"""Observed runs, latencies of variants and settings, and what reads them."""

from pyspark.sql import functions as F

from quillon.operators.lexical import build_index
from quillon.plans import benchmark, timing
from quillon.plans.retrieval import Corpus

WIDE = "config_id int, qid long, chunk_id string, doc_id string, dense_rank int, bm25_rank int, sparse_rank int"


def test_observed_counts_what_passes(spark):
    seen, seconds = timing.observed(spark.range(100).where("id % 4 = 0"), n=F.count(F.lit(1)), most=F.max("id"))
    assert seen == {"n": 25, "most": 96} and seconds > 0
    assert timing.observed(spark.range(0), n=F.count(F.lit(1)))[0] == {"n": 0}


def test_variants_are_measured(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 3}", "trade data" if i % 2 else "price index", [float(i), 1.0]) for i in range(8)], "chunk_id string, doc_id string, text string, embedding array<double>")
    corpus = Corpus(chunks.select("chunk_id", "doc_id", "embedding"), build_index(chunks))
    asked = spark.createDataFrame([(1, "trade", [1.0, 0.0]), (2, "absent", [0.0, 1.0])], "qid long, text string, embedding array<double>")
    measured = benchmark.latencies(["dense", "bm25"], corpus, asked, repeats=2)
    rows = {(r.variant, r.repeat): r for r in measured.collect()}
    assert rows.keys() == {(v, i) for v in ("dense", "bm25") for i in (0, 1)}
    assert all(r.total_ms == r.plan_ms + r.search_ms > 0 for r in rows.values())
    assert (rows["dense", 0].n_hits, rows["dense", 0].n_queries) == (16, 2) and (rows["bm25", 1].n_hits, rows["bm25", 1].n_queries) == (4, 1)
    summed = {r.variant: r for r in benchmark.latency_by_variant(measured).collect()}
    assert summed.keys() == {"dense", "bm25"} and all(0 < r.p50 <= r.p95 <= r.p99 for r in summed.values())

    per = spark.createDataFrame([("dense", 1, "a"), ("dense", 2, None)], "variant string, qid long, category string").withColumns({m: F.lit(1.0) for m in benchmark.METRICS})
    plain, told = benchmark.report(per, "dense"), benchmark.report(per, "dense", measured)
    assert told.columns == [*plain.columns, "p50", "p95", "p99"] and told.count() == plain.count()
    assert [(r.kind, r.p50) for r in told.where("p50 IS NOT NULL").collect()] == [("overall", summed["dense"].p50)]
    assert benchmark.report(per, "dense", measured.where("variant = 'bm25'")).where("p50 IS NOT NULL").count() == 0


def test_the_faster_of_equal_settings_comes_first(spark):
    ranked = spark.createDataFrame([(1, f"c{i}", f"d{i}", i, i, i) for i in range(1, 6)], WIDE.split(", ", 1)[1])
    grid = benchmark.grid_table(spark, {"dense_k": (30, 50), "bm25_k": (30,), "sparse_w": (0.5,), "bm25_w": (1.0,), "rrf_k": (20, 60)})
    judged = spark.createDataFrame([(1, "d1", 3)], "qid long, doc_id string, grade int")
    asked = ranked.select("qid").distinct()
    places = lambda took: [r.config_id for r in benchmark.calibrate(ranked, grid, judged, asked, took=took).orderBy("place").collect()]
    assert places(None) == [0, 1, 2, 3]
    assert places(spark.createDataFrame([(0, 9.0), (1, 2.0), (3, 1.0)], "config_id int, p50 double")) == [3, 1, 0, 2]
    took = benchmark.grid_latencies(ranked, grid.where("config_id < 2"), 1, repeats=2)
    assert sorted(r.config_id for r in took.collect()) == [0, 1] and took.where("p50 <= 0").count() == 0
