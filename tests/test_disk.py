"""What a search and an index leave out of shuffles and off the disk."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import dense
from quillon.plans import registry_more, retrieval
from quillon.runtime import shared_folder, written
from quillon.sources import segments
from quillon.sources.log import names_in
from quillon.sources.segments import SegmentIndex

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Spark broadcasts nothing by itself, as with tables over its limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_weights_are_not_shuffled(spark, no_broadcast, monkeypatch):
    pool = spark.createDataFrame([(q, c, c + 1) for q in (1, 2) for c in range(6)] + [(3, 99, 1)], "qid int, chunk_id int, pool_pos int")
    asked = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "c", 3.0), (3, "a", 1.0)], "qid int, token string, weight double")
    weights = written(spark.createDataFrame([(c, t, float(1 + (c * n) % 4)) for c in range(20) for n, t in enumerate("abcd")], "chunk_id int, token string, weight double"), "weights")
    got = dense.sparse_rank(pool, asked, weights)
    assert plan(got).count("SortMergeJoin") == 1 and plan(got).count("BroadcastHashJoin") == 2  # what is shuffled are sums
    monkeypatch.setattr(dense, "BROADCAST_ROWS", 0)
    large = dense.sparse_rank(pool, asked, weights)
    assert "BroadcastHashJoin" not in plan(large)
    rows = lambda df: sorted(map(tuple, df.select("qid", "chunk_id", "sparse_score", "sparse_rank").collect()))
    assert rows(got) == rows(large) and len(rows(got)) == 13
    assert [r[2] for r in rows(got) if r[:2] == (1, 3)] == [2.0 * 1 + 1.0 * 4] and rows(got)[-1] == (3, 99, 0.0, 1)


def test_variants_share_a_search(spark, monkeypatch):
    """Presets that differ in diversity or reranking alone search once."""
    asked = []
    real = retrieval.dense_topk
    monkeypatch.setattr(retrieval, "dense_topk", lambda *a, **b: asked.append(1) or real(*a, **b))
    per = registry_more._run(spark, SF)
    assert len(asked) == 1 and per.count() == 3 * 40


def test_texts_are_cut_before_they_are_shuffled(spark, no_broadcast):
    texts = written(spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("words "), "id").alias("text")), "texts")
    hits = written(spark.createDataFrame([(1, 7), (1, 9), (2, 7)], "qid int, chunk_id long"), "found")
    cut = retrieval.own_texts(hits, texts)
    assert "BroadcastHashJoin" in plan(cut) and sorted(map(tuple, cut.collect())) == [(7, "words 7"), (9, "words 9")]


def test_an_index_leaves_no_second_copy(spark, tmp_path):
    """What a segment is written from goes when it is written."""
    left = lambda: {n for n in names_in(spark, shared_folder(spark)) if n.startswith(("new-", "merged-"))}
    before = left()
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    for i in range(3):
        index.add(spark.createDataFrame([(f"c{i}", f"d{i}", f"word w{i} word")], "chunk_id string, doc_id string, text string"))
    index.merge(fanout=2)
    assert left() == before
    rows = index.postings().where("term = 'word'").select("chunk_id", "len", "tf", "positions").collect()
    assert sorted((r.chunk_id, r.len, r.tf, r.positions) for r in rows) == [(f"c{i}", 3, 2, [0, 2]) for i in range(3)]


def test_a_report_searches_once(spark, monkeypatch):
    """The postings of all phrases are met once for the whole report."""
    asked = []
    real = segments.SegmentIndex.search
    monkeypatch.setattr(segments.SegmentIndex, "search", lambda *a, **b: asked.append(1) or real(*a, **b))
    assert registry_more.benchmark_report(spark, SF).where("kind = 'overall'").first().n_queries == 40
    assert len(asked) == 1
