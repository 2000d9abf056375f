"""The index kept as a log: after any changes a search equals one over an index built anew; what it reads follows what is asked."""

import json
from threading import Thread

import pytest
from pyspark.sql import functions as F

from quillon.errors import CommitConflict, GenerationUnavailable
from quillon.operators.lexical import bm25, build_index
from quillon.sources import segments
from quillon.sources.log import CommitLog
from quillon.sources.segments import SegmentIndex

SCHEMA = "chunk_id string, doc_id string, text string"
ASKED = [(1, "trade"), (2, "trade data"), (3, "trade-data set"), (4, "nothing"), (5, "the the data"), (6, ""), (7, "data-trade-data"), (8, "absent trade"), (9, "the")]


def texts(spark, docs):
    return spark.createDataFrame([(f"{d}-{i}", d, t) for d, parts in docs.items() for i, t in enumerate(parts)], SCHEMA)


def corpus(n):
    words = "trade data set index the survey price of nothing else".split()
    return {f"d{i}": [" ".join(words[(i * 7 + j * j + i * j) % (10 if i % 3 else 5)] for j in range(4 + i % 9)) for _ in range(1 + i % 3)] + ([None] if i % 5 == 0 else []) for i in range(n)}


def hits(df):
    return sorted((r.qid, r.bm25_rank, r.chunk_id, r.doc_id, round(r.bm25_score, 9)) for r in df.collect())


def same(spark, index, docs, k=7, snap=None, only=None):
    """Asked word by word by address, and as a batch that reads all."""
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    snap = snap or index.snapshot()
    whole = texts(spark, docs)
    want = hits(bm25(build_index(whole), asked, k, only))
    assert hits(index.search(asked, k, only, snap)) == want and (want or not docs)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(segments, "LITERALS", 2)
        assert hits(index.search(asked, k, only, snap)) == want
    assert sorted(map(tuple, index.terms(snap).collect())) == sorted(map(tuple, build_index(whole).terms.select("term", "df", "cf").collect()))
    assert snap.chunks == whole.count()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(segments, "ONE_BUCKET", 40)


def test_changes_equal_a_rebuild(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    assert index.search(spark.createDataFrame(ASKED, "qid int, text string")).count() == 0
    docs = corpus(30)
    first = index.add(texts(spark, docs))
    same(spark, index, docs, only=spark.createDataFrame([(f"d{i}",) for i in range(0, 30, 2)], "doc_id string"))
    changed = {"d3": ["trade data set anew"], "d7": ["the the data", "trade"], "new": ["data trade data set"]}
    second = index.add(texts(spark, changed))
    docs2 = docs | changed
    third = index.remove(spark.createDataFrame([("d0",), ("d7",), ("zz",), (None,)], "doc_id string"))
    docs3 = {d: t for d, t in docs2.items() if d not in ("d0", "d7")}
    same(spark, index, docs3)
    same(spark, index, docs3, only=spark.createDataFrame([("d3",), ("d9",)], "doc_id string"))
    same(spark, index, docs, snap=index.snapshot(first))  # an older snapshot reads what it read
    index.merge(fanout=2)
    assert len(index.snapshot().segments) == 1 and not index.snapshot().dead
    assert index.merge(fanout=2) is None
    index.roll_back(second)
    assert index.snapshot().segments == index.snapshot(second).segments
    index.roll_back(third)
    index.merge(fanout=2)
    same(spark, index, docs3)
    gone = index.vacuum(keep=1)
    assert any(x.startswith("postings/") for x in gone) and any(x.startswith("log/") for x in gone)
    with pytest.raises(GenerationUnavailable):
        index.snapshot(first)
    index.remove(texts(spark, docs3).select("doc_id"))
    assert index.snapshot().segments == () and index.snapshot().chunks == 0


def test_empty_and_null_texts(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    index.add(texts(spark, {}))
    assert index.snapshot().segments == ()
    index.add(texts(spark, {"a": [None, "", "?!"]}))
    assert index.snapshot().chunks == 3 and index.search(spark.createDataFrame(ASKED, "qid int, text string")).count() == 0
    index.add(texts(spark, {"b": ["trade"]}))
    assert [r.chunk_id for r in index.search(spark.createDataFrame(ASKED, "qid int, text string")).where("qid = 1").collect()] == ["b-0"]


def test_two_writers(spark, tmp_path):
    """Both commits count, whoever comes first; the log's entries are put once."""
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    parts = [{f"w{i}": [f"trade data {i}"], "both": [f"set {i}"]} for i in range(3)]
    threads = [Thread(target=index.add, args=(texts(spark, p),)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    snap = index.snapshot()
    assert snap.number == 3 and snap.chunks == 4
    assert {r.doc_id for r in index.lengths(snap).collect()} == {"w0", "w1", "w2", "both"}
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.put(1, {"a": 1})
    with pytest.raises(CommitConflict):
        log.put(1, {"a": 2})
    (tmp_path / "log" / "000000000002.json").write_text('{"a": ')  # its writer died in it
    assert log.last() == (2, {"a": 1}) and log.put(3, {"a": 3}) == 3 and log.last() == (3, {"a": 3})


def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch):
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    docs = corpus(12)
    index.add(texts(spark, docs))

    def die(*_):
        raise RuntimeError("lost")

    for point in ("_write", "_bury"):
        with monkeypatch.context() as m:
            m.setattr(SegmentIndex, point, die)
            with pytest.raises(RuntimeError):
                index.add(texts(spark, {"d1": ["other"]}))
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "put", die)
        with pytest.raises(RuntimeError):
            index.add(texts(spark, {"d1": ["other"]}))
    index.vacuum()
    same(spark, index, docs)


def read_bytes(df):
    """Bytes of files that the plan's scans have read, by its own metrics."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        if p.metrics().contains("filesSize"):
            total += p.metrics().apply("filesSize").value()
    return total


def test_a_search_reads_what_it_asks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "ONE_BUCKET", 1000)
    docs = spark.range(3000).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), F.expr("id div 3")).alias("doc_id"),
        F.concat_ws(" ", F.lit("common"), *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2000))) for i in range(20)]).alias("text"),
    )
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    snap = index.snapshot()
    one = index.directory(None, snap, ["w7"])
    assert one.count() == 1
    blocks = index.blocks(index.all_slices(one), snap, index._address(one))
    whole = read_bytes(index._read("postings", snap.segments))
    assert 0 < read_bytes(blocks) < whole / 7
    # the commonest term stands in many blocks, spread over the buckets
    common = index._read("postings", snap.segments).where("term = 'common'").groupBy("slice", "bucket").count().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("b"), F.max("count").alias("most")).first()
    assert common.n >= 256 and common.b > 8 and common.most < 40
    asked = spark.createDataFrame([(1, "w7"), (2, "common"), (3, "common w11"), (4, "common-w5")], "qid int, text string")
    assert hits(index.search(asked, 10)) == hits(bm25(build_index(docs), asked, 10))


def test_blocks_that_cannot_reach_the_best_are_left(spark, tmp_path, monkeypatch):
    """One word, scores far apart: only the blocks with the long counts are opened."""
    docs = texts(spark, {f"d{i}": ["x " * (40 if i < 9 else 1) + "y " * 30] for i in range(400)})
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    index.add(docs)
    opened = []
    real = SegmentIndex.entries
    monkeypatch.setattr(SegmentIndex, "entries", lambda self, blocks, *a, **b: opened.append(blocks.select("term", "slice").distinct().count()) or real(self, blocks, *a, **b))
    asked = spark.createDataFrame([(1, "x")], "qid int, text string")
    got = hits(index.search(asked, 3))
    blocks = index._read("postings", index.snapshot().segments).where("term = 'x'").select("slice").distinct().count()
    assert got == hits(bm25(build_index(docs), asked, 3)) and blocks >= 32 and sum(opened) < blocks / 2


def test_log_entries_are_json(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/i")
    index.add(texts(spark, {"a": ["trade"]}))
    entry = json.loads((tmp_path / "i" / "log" / "000000000001.json").read_text())
    assert [s["chunks"] for s in entry["segments"]] == [1] and entry["dead"] == []


def test_the_registered_index_follows_its_folder(spark, tmp_path):
    """Tables written anew are indexed anew, and the old index goes."""
    from quillon.plans import registry

    d, seen = f"file://{tmp_path}", []
    for n in (5, 40):
        spark.range(n).selectExpr("id AS doc_id", "concat('common word', id) AS text", "'en' AS lang", "'src1' AS source", "5 AS n_chars").coalesce(1).write.mode("overwrite").parquet(f"{d}/documents.parquet")
        spark.range(n).selectExpr("id AS vec_id", "array(1.0F) AS embedding", "1 AS label").coalesce(1).write.mode("overwrite").parquet(f"{d}/embeddings.parquet")
        assert registry.postings_df(spark, d).count() == n + 1
        seen.append(registry._CORPORA[(spark.sparkContext.applicationId, d)][1])
        registry.postings_df(spark, d)
        assert registry._CORPORA[(spark.sparkContext.applicationId, d)][1] == seen[-1]
    from quillon.sources.log import names_in

    assert seen[0] != seen[1] and names_in(spark, seen[0]) == [] != names_in(spark, seen[1])


def test_common_terms_are_broadcast(spark, tmp_path):
    """Writing a segment shuffles its postings once, also where Spark broadcasts nothing by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        SegmentIndex(spark, f"file://{tmp_path}/once").add(spark.createDataFrame([(str(i), f"d{i}", f"word w{i % 50}") for i in range(2500)], "chunk_id string, doc_id string, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    writes = [p for p in plans if f"{tmp_path}/once/postings/seg=" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert writes and not any("SortMergeJoin" in p for p in writes)
