"""The vector graph against the exact ranking: recall and what a query looks at, on groups and on random vectors."""

import numpy as np

from quillon.operators import ann, graph
from quillon.operators.dense import dense_topk
from quillon.plans.evaluate import ranking_overlap

ROWS = "chunk_id int, doc_id string, embedding array<float>"


def grouped(n, seed, groups=80, dim=24):
    middle = np.random.default_rng(1).normal(size=(groups, dim))
    rng = np.random.default_rng(seed)
    return middle[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dim))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, f"d{i % 7}", [float(v) for v in r]) for i, r in enumerate(x)], ROWS)


def test_recall_on_groups(spark):
    vectors = frame(spark, grouped(6000, 2))
    asked = frame(spark, grouped(40, 3)).selectExpr("chunk_id AS qid", "embedding")
    profile = graph.PROFILES["fast"]
    found = graph.search(graph.build(vectors, profile), vectors, asked, profile, 20).cache()
    assert ranking_overlap(dense_topk(vectors, asked, 20), found, 20).first().recall >= 0.95
    assert found.groupBy("qid").max("looked").agg({"max(looked)": "avg"}).first()[0] < 600  # a tenth
    assert found.groupBy("qid").count().where("count <> 20").count() == 0 and found.select("qid", "chunk_id").distinct().count() == 800


def test_parts_are_merged(spark):
    """Several parts, of vectors without any order: a wide beam finds nearly all."""
    rng = np.random.default_rng(5)
    vectors = frame(spark, rng.normal(size=(900, 12)))
    asked = frame(spark, rng.normal(size=(15, 12))).selectExpr("chunk_id AS qid", "embedding")
    profile = graph.PROFILES["recall"]
    index = graph.build(vectors, profile, part=200)
    assert index.count() == 5 and index.agg({"size": "sum"}).first()[0] == 900
    found = graph.search(index, vectors, asked, profile, 10)
    assert ranking_overlap(dense_topk(vectors, asked, 10), found, 10).first().recall >= 0.97


def test_what_takes_no_part(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", None), (4, "b", [float("nan"), 1.0]), (5, "b", [1.0, None]), (6, "b", [1.0, 0.0, 0.0]), (7, "c", []), (8, "c", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, ROWS)
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0])], "qid int, embedding array<float>")
    profile = graph.PROFILES["fast"]
    got = [(r.qid, r.chunk_id, r.dense_rank) for r in graph.search(graph.build(vectors, profile), vectors, asked, profile, 5).orderBy("qid", "dense_rank").collect()]
    assert got == [(1, 1, 1), (1, 8, 2), (1, 2, 3)]
    assert graph.search(graph.build(vectors.limit(0), profile), vectors, asked, profile).count() == 0
    c = ann.centres(vectors.where("chunk_id IN (1, 2, 6, 8)"), 2)
    assert {r.chunk_id for r in ann.assign(vectors.where("chunk_id NOT IN (4, 5)"), c).collect()} == {1, 2, 8}
