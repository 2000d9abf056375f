"""Metadata, lifecycle, verification, context and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.operators import context, lifecycle, metadata, metrics, verification
from quillon.sources import files
from quillon.sources.versions import VersionedStore


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("a", "active", 1), ("b", "active", None), ("c", "archived", 1), ("d", "active", 2)], "doc_id string, status string, source_id int")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([("a", "glossary"), ("a", "guide"), ("b", "guide"), ("d", "guide"), ("d", "test")], "doc_id string, tag string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_filters(documents, tags):
    spec = metadata.FilterSpec
    assert not spec().is_empty and spec(status=None).is_empty and not spec(status=None, doc_ids=()).is_empty
    assert ids(metadata.resolve(spec(), documents, tags)) == ["a", "b", "d"]
    assert ids(metadata.resolve(spec(tags_include=("guide", "glossary")), documents, tags)) == ["a"]
    assert ids(metadata.resolve(spec(tags_include=("guide",), tags_exclude=("test",)), documents, tags)) == ["a", "b"]
    assert ids(metadata.resolve(spec(doc_ids=("a", "c", "zz")), documents, tags)) == ["a"]
    assert ids(metadata.resolve(spec(doc_ids=()), documents, tags)) == []
    assert ids(metadata.resolve(spec(source_id=1, status=None), documents, tags)) == ["a", "c"]
    assert metadata.resolve(spec(status=None), documents, tags) is None
    assert ids(metadata.resolve(spec(doc_ids=("q",)), None, tags)) == ["q"]
    assert spec(domain="X", language="EN", version="2").effective_tags == ("domain:x", "lang:en", "version:2")


def test_tag_expressions(spark):
    row = spark.range(1).select(metadata.normal_tags(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit(None))).alias("t"), metadata.derived_tags(F.lit("D"), F.lit(None).cast("string"), F.lit(" En "), F.lit("V1")).alias("d")).first()
    assert row.t == ["a"] and row.d == ["domain:d", "lang:en", "version:V1"]


def test_crud(spark, tags):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, metadata.upsert(t, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert metadata.assign_tags(tags, spark.createDataFrame([("a", "guide"), ("b", "new")], "doc_id string, tag string")).count() == 6
    assert metadata.rename_tag(tags, "glossary", "guide").count() == 4
    assert ids(metadata.remove(tags, spark.createDataFrame([("d",), (None,)], "doc_id string"))) == ["a", "a", "b"]


def state(spark, **changes):
    base = dict(has_version=True, pending_op=False, run_state="COMMITTED", documents_hash="h", version_hash="h", committed_hashes=["h"], documents_path="p", owner_path="p", mixed_models=False, vectors_known=True, vectors_differ=False, fts_differs=False, chunk_ids_differ=False, n_chunks=2, n_vectors=2, n_fts=2, path="p", chunks_equal=True, model_equal=None, class_equal=True, force=False)
    row = base | changes
    schema = "has_version boolean, pending_op boolean, run_state string, documents_hash string, version_hash string, committed_hashes array<string>, documents_path string, owner_path string, mixed_models boolean, vectors_known boolean, vectors_differ boolean, fts_differs boolean, chunk_ids_differ boolean, n_chunks int, n_vectors int, n_fts int, path string, chunks_equal boolean, model_equal boolean, class_equal boolean, force boolean"
    return lifecycle.decide(spark.createDataFrame([tuple(row.values())], schema)).first().decision


LEGACY = dict(has_version=False, run_state=None, version_hash=None)
FRESH = LEGACY | dict(documents_hash=None, committed_hashes=None, documents_path=None, owner_path=None, n_chunks=0, n_vectors=0, n_fts=0)


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, "NOOP_OWNER"), ({"force": True}, "REPLACE"), ({"chunks_equal": False}, "REPLACE"), ({"model_equal": False}, "REPLACE"), ({"path": "q"}, "NOOP_EQUIVALENT_OTHER_SOURCE"),
        ({"path": "q", "force": True}, "NOOP_EQUIVALENT_OTHER_SOURCE"), ({"path": "q", "chunks_equal": False}, "NOT_OWNER"), ({"pending_op": True}, "INCOHERENT"), ({"run_state": "FAILED"}, "INCOHERENT"),
        ({"version_hash": None}, "INCOHERENT"), ({"documents_hash": "x"}, "INCOHERENT"), ({"committed_hashes": ["h", "g"]}, "INCOHERENT"), ({"documents_path": "q"}, "INCOHERENT"), ({"mixed_models": True}, "INCOHERENT"),
        ({"vectors_known": False}, "INCOHERENT"), ({"fts_differs": True}, "INCOHERENT"), ({"chunk_ids_differ": True}, "INCOHERENT"), (FRESH, "CREATE"), (FRESH | {"n_fts": 1}, "INCOHERENT"),
        (LEGACY, "NOOP_OWNER"), (LEGACY | {"force": True}, "NOOP_OWNER"), (LEGACY | {"owner_path": None}, "INSUFFICIENT_EVIDENCE"), (LEGACY | {"chunks_equal": False}, "REPLACE"),
        (LEGACY | {"path": "q"}, "NOOP_EQUIVALENT_OTHER_SOURCE"), (LEGACY | {"path": "q", "chunks_equal": False}, "INSUFFICIENT_EVIDENCE"), (LEGACY | {"vectors_differ": True}, "INCOHERENT"),
    ],
)
def test_ownership(spark, changes, want):
    assert state(spark, **changes) == want


def test_store_diff_and_recovery(spark):
    a = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y"), ("e", "3", "z")], "doc_id string, chunk_id string, text_sha string")
    b = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y"), ("e", "3", "z"), ("e", "3", "z")], "doc_id string, chunk_id string, text_sha string")
    assert {r.doc_id: r.equal for r in lifecycle.store_diff(a, b).collect()} == {"d": True, "e": False}
    ops = spark.createDataFrame([("1", "WRITING"), ("2", "COMMITTING"), ("3", "DONE"), ("4", "RESTORING")], "op string, phase string")
    assert {r.op: r.action for r in lifecycle.recovery(ops).collect()} == {"1": "RESTORE", "2": "RECOMMIT", "4": "RESTORE"}


def test_consistency_reply(spark):
    reply = "UNSUPPORTED: NO\nCONTRADICTIONS: sí\nhallucinations : no"
    rows = spark.createDataFrame([(reply,), (reply.replace("sí", "no"),), (reply + "\nHALLUCINATIONS: SI",), ("UNSUPPORTED: maybe",), (None,)], "t string")
    assert [r[0] for r in rows.select(verification.consistency(F.col("t"))).collect()] == [0.5, 1.0, 0.0, None, None]


def test_first_fitting_chunk_decides(spark):
    chunks = spark.createDataFrame([(1, "d", "c1", "A > B", 1, 5, 9), (1, "d", "c2", "A > B", 2, 1, 2)], "qid int, doc_id string, chunk_id string, heading_path string, pos int, line_start int, line_end int")
    text = "x [[1] Fuente: d | Sección: a > b | Líneas: 1-2] y [[2] Fuente: d | Sección: B | Líneas: 5-2] z [[3] Fuente: d | Sección: C | Líneas: 5-9]"
    cited = verification.citations(spark.createDataFrame([(1, text)], "qid int, answer string"))
    got = verification.classify(cited, chunks).orderBy("cite_no").collect()
    assert [(r.status, r.chunk_id) for r in got] == [("INVALID", "c1"), ("PARTIAL", "c1"), ("INVALID", None)]
    assert verification.evidence_map(verification.classify(cited, chunks)).first().evidence["2"].status == "PARTIAL"


def test_packing_skips_and_goes_on(spark):
    s = Settings(context_window=1000, context_margin=100, min_output_tokens=100)
    hits = spark.createDataFrame([(1, 1, "a", 300), (1, 2, "b", 500), (1, 3, "c", 200), (2, 1, "z", 10)], "qid int, pos int, chunk_id string, n_tokens int")
    got = {r.qid: r for r in context.pack(hits, F.when(F.col("qid") == 1, 100).otherwise(801), s).collect()}
    assert (got[1].used, got[1].dropped, got[1].prompt_tokens, got[1].status) == (["a", "c"], ["b"], 100 + int(300 * 1.15) + 1 + int(200 * 1.15) + 1, "ok")
    assert got[2].status == "base_too_large"


def test_chunk_grade_blocks_later_document_grade(spark):
    hits = spark.createDataFrame([(1, "c1", "d1", 1), (1, "c2", "d1", 2), (1, "c3", "d2", 3)], "qid int, chunk_id string, doc_id string, pos int")
    docs = spark.createDataFrame([(1, "d1", 2), (1, "d2", 1)], "qid int, doc_id string, grade int")
    own = spark.createDataFrame([(1, "c1", 0)], "qid int, chunk_id string, grade int")
    assert [r.grade for r in metrics.grade(hits, docs, own).orderBy("pos").collect()] == [0, 0, 1]
    assert [r.grade for r in metrics.grade(hits, docs).orderBy("pos").collect()] == [2, 0, 1]
    assert metrics.reciprocal_rank(hits, docs, own).first().mrr == 0.5


def test_versioned_store(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    assert store.read("t") is None
    one, two = spark.range(3), spark.range(5)
    assert store.publish({"t": one}) == 1 and store.publish({"t": two}) == 2 and store.read("t").count() == 5
    store.roll_back(["t"], 1)
    assert store.read("t").count() == 3 and store.generation("t") == 1


def test_markdown_source_and_suite(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\n![x](data:image/png;base64,QUJD) end")
    (tmp_path / "a.markdown").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "e.mdown").write_text("  ")
    got = {r.doc_id: r for r in files.cleaned(files.read_markdown(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"a", "b", "e"} and not got["a"].readable and got["b"].clean == "# B\n end" and got["b"].size_reduction > 50 and got["e"].rejected
    (tmp_path / "s.yaml").write_text("queries:\n- {id: q1, text: t, validated: true, doc_relevance: {d1: 3, d2: 1}}\n- {id: q2, text: u, suite: negative}\n")
    suite = files.load_suite(spark, f"{tmp_path}/s.yaml")
    assert [(r.id, r.expected_doc_ids) for r in files.eval_samples(suite).collect()] == [("q1", ["d1"])]
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(ValueError):
        files.load_suite(spark, f"{tmp_path}/empty.json")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"doc_id":"a","hash":"1","ingested_at":"2024-01-01"}\nbroken\n{"doc_id":"a","hash":"2","ingested_at":"2024-01-02"}\n')
    m = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [(r.doc_id, r.hash) for r in m.collect()] == [("a", "2")]
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "doc_id string, hash string")
    assert sorted((r.doc_id, r.hash) for r in files.upsert_manifest(m, new).collect()) == [("a", "2"), ("b", "3")]
