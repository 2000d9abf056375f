"""Bitmap filters against the filter by joins, by themselves and inside both searches."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import bitmaps, metadata
from quillon.operators.dense import dense_topk
from quillon.operators.lexical import bm25, build_index
from quillon.operators.metadata import FilterSpec

N = 70_000  # more than two buckets


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.range(N).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("doc_id"), F.when(F.col("id") % 7 == 0, "archived").otherwise("active").alias("status"), (F.col("id") % 5).alias("source_id"), "id")
    some = lambda every, tag: docs.where(F.col("id") % every == 0).select("doc_id", F.lit(tag).alias("tag"))
    tags = some(2, "even").union(some(3, "three")).union(some(11, "lang:en")).union(some(3, "three")).union(docs.where("id < 40").select("doc_id", F.lit("early").alias("tag")))
    return docs.drop("id"), tags, bitmaps.build(docs, tags)


SPECS = {
    "default": FilterSpec(),
    "nothing": FilterSpec(status=None),
    "all of": FilterSpec(tags_include=("even", "three"), language="en"),
    "none of": FilterSpec(tags_exclude=("even", "three")),
    "one bucket": FilterSpec(tags_include=("early",), tags_exclude=("even",), source_id=1),
    "unknown tag": FilterSpec(tags_include=("even", "no such")),
    "unknown exclusion": FilterSpec(tags_include=("early",), tags_exclude=("no such",)),
    "same twice": FilterSpec(tags_include=("early",), tags_exclude=("early",)),
    "listed": FilterSpec(doc_ids=("d000001", "d000001", "d069999", "zz"), status=None),
    "empty list": FilterSpec(doc_ids=()),
    "archived of a source": FilterSpec(status="archived", source_id=0),
}


@pytest.mark.parametrize("name", SPECS)
def test_equals_the_filter_by_joins(tables, name):
    docs, tags, index = tables
    got, want = bitmaps.resolve(SPECS[name], index), metadata.resolve(SPECS[name], docs, tags)
    assert (got is None) == (want is None) == (name == "nothing")
    if got is not None:
        got, want = [sorted(df.toArrow().column(0).to_pylist()) for df in (got, want.distinct())]
        assert got == want and (not want) == (name in ("empty list", "unknown tag", "same twice"))


def test_any_of_and_count(tables):
    _, _, index = tables
    found = bitmaps.combined(index, [["tag:early", "tag:lang:en"], ["status:active"]], ("tag:even",))
    want = {f"d{i:06d}" for i in range(N) if (i < 40 or i % 11 == 0) and i % 7 and i % 2}
    assert {r.doc_id for r in bitmaps.keep(index.numbers, found).collect()} == want and bitmaps.count(found).first().matched == len(want)
    assert bitmaps.count(bitmaps.combined(index, [])).first().matched == N
    assert bitmaps.count(bitmaps.combined(index, [["tag:no such"]])).first().matched == 0
    assert bitmaps.count(bitmaps.combined(index, [[], ["tag:early"]])).first().matched == 0


def test_numbers_are_dense_and_stay(spark):
    have = spark.createDataFrame([(x,) for x in ("c", "a", "b", "a", None)], "doc_id string")
    first = bitmaps.numbered(have)
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    more = bitmaps.numbered(spark.createDataFrame([("aa",), ("c",), ("0",)], "doc_id string"), first)
    assert sorted(map(tuple, more.collect())) == [("0", 4), ("a", 1), ("aa", 5), ("b", 2), ("c", 3)]
    empty = have.where("false")
    assert bitmaps.numbered(empty).count() == 0
    none = bitmaps.build(empty.withColumns({"status": F.lit("active"), "source_id": F.lit(1)}), spark.createDataFrame([], "doc_id string, tag string"))
    assert bitmaps.resolve(FilterSpec(), none).count() == 0


def test_one_join_whatever_the_tags(tables):
    _, _, index = tables
    spec = FilterSpec(tags_include=tuple(f"t{i}" for i in range(30)), tags_exclude=("x", "y"))
    plan = bitmaps.resolve(spec, index)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Relation [") <= 3


def test_inside_both_searches(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(f"d{i}", "active", i % 3) for i in range(40)], "doc_id string, status string, source_id long")
    tags = spark.createDataFrame([(f"d{i}", "t") for i in range(0, 40, 4)], "doc_id string, tag string")
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 40}", "trade data " + "x " * (i % 5), [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)], "chunk_id string, doc_id string, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "trade", [1.0, 0.0, 0.5, 0.2])], "qid long, text string, embedding array<double>")
    index, own = bitmaps.build(docs, tags), build_index(chunks)
    for spec in (FilterSpec(tags_include=("t",)), FilterSpec(tags_exclude=("t",), source_id=2), FilterSpec(doc_ids=()), FilterSpec(status=None)):
        got, want = bitmaps.resolve(spec, index), metadata.resolve(spec, docs, tags)
        for search in (lambda f: dense_topk(chunks, asked, 9, f).select("chunk_id", "dense_rank"), lambda f: bm25(own, asked, 9, f).select("chunk_id", "bm25_rank")):
            found = sorted(map(tuple, search(got).collect()))
            assert found == sorted(map(tuple, search(want).collect())) and (not found) == (spec.doc_ids == ())
