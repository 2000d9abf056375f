"""Ingest under crashes and other writers, single documents taken back and deleted, compaction; the index follows every step."""

import os

import pytest
from test_plans import write

from quillon.errors import CommitConflict, GenerationUnavailable
from quillon.operators.lexical import bm25, build_index
from quillon.plans import ingest
from quillon.sources.segments import SegmentIndex
from quillon.sources.versions import VersionedStore

ASKED = [(1, "alpha"), (2, "beta"), (3, "gamma delta"), (4, "gamma-delta"), (5, "omega")]


def hits(df):
    return sorted((r.qid, r.bm25_rank, r.chunk_id, r.doc_id, round(r.bm25_score, 9)) for r in df.collect())


def searched(spark, store):
    """What the kept index finds; equal to an index built anew from what is published."""
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    index, snap = ingest.lexical(store)
    chunks = ingest.published(store)
    want = hits(bm25(build_index(chunks), asked, 20))
    assert hits(index.search(asked, 20, snap=snap)) == want and snap.chunks == chunks.count()
    return {(q, d) for q, _, _, d, _ in want}


@pytest.fixture
def place(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    write(folder, "a.md", "a", "alpha " * 80)
    write(folder, "b.md", "b", "beta " * 80)
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    return folder, store, lambda **more: {r.doc_id: (r.decision, r.error) for r in ingest.run(spark, f"file://{folder}", store, **more).collect()}


def files_under(tmp_path, name):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path / "store" / name) for f in names)


def test_documents_come_go_and_come_back(spark, tmp_path, place):
    folder, store, run = place
    run()
    write(folder, "b.md", "b", "gamma delta " * 60)
    write(folder, "c.md", "c", "omega alpha " * 60)
    run()
    assert searched(spark, store) == {(1, "a"), (1, "c"), (3, "b"), (4, "b"), (5, "c")}
    rows = {r.doc_id: r.run_id for r in store.read("documents").collect()}
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "run_id string")
    before = store.state()
    for bad in (of("000000001-b"), of(rows["a"], "nothing")):  # not active, unknown
        with pytest.raises(GenerationUnavailable):
            ingest.roll_back_runs(store, bad)
    assert store.state() == before
    kept = files_under(tmp_path, "chunks")
    assert ingest.roll_back_runs(store, of(rows["b"], rows["c"])) == 2  # one goes back, the new one away
    assert searched(spark, store) == {(1, "a"), (2, "b")} and {r.doc_id: r.run_id for r in store.read("documents").collect()} == {"a": "000000001-a", "b": "000000001-b"}
    assert ingest.delete_documents(store, spark.createDataFrame([("a",), ("zz",)], "doc_id string")) == 1
    assert searched(spark, store) == {(2, "b")} and ingest.delete_documents(store, spark.createDataFrame([("a",)], "doc_id string")) == 0
    assert files_under(tmp_path, "chunks") == kept  # no document's files were touched
    assert {(r.doc_id, r.operation, r.phase) for r in ingest.journal(store).where("generation > 2").collect()} == {("b", "roll_back", "DONE"), ("c", "roll_back", "DONE"), ("a", "delete", "DONE")}
    got = run()
    assert {d: x for d, (x, _) in got.items()} == {"a": "CREATE", "b": "REPLACE", "c": "CREATE"}


def test_a_crash_leaves_the_old_state(spark, place, monkeypatch):
    """A crash in any write of an ingest: nothing changes, its documents are pending until it is over."""
    folder, store, run = place
    run()
    write(folder, "b.md", "b", "gamma delta " * 60)
    entry = store.state()[1]

    def die(*_, **__):
        raise RuntimeError("lost")

    points = [(VersionedStore, "append"), (SegmentIndex, "_commit"), (VersionedStore, "_put")]
    for i, (target, name) in enumerate(points):
        with monkeypatch.context() as m:
            m.setattr(target, name, die)
            with pytest.raises(RuntimeError):
                run()
        assert store.open() == [2 + i] and all(store.state()[1][k] == entry[k] for k in ("tables", "published", "extra"))
        if i == 0:
            assert run() == {"a": ("NOOP_OWNER", None), "b": ("INCOHERENT", "pending_operation")}  # its writer may be at work
        store.recover()
    assert run() == {"a": ("NOOP_OWNER", None), "b": ("REPLACE", None)}
    assert searched(spark, store) == {(1, "a"), (3, "b"), (4, "b")} and store.open() == [] and store.generation("documents") == 5
    assert {(r.generation, r.phase) for r in ingest.journal(store).where("doc_id = 'b'").collect()} == {(1, "DONE"), (5, "DONE"), *((g, "GIVEN_UP") for g in range(2, 5))}


def test_writers_do_not_mix(spark, tmp_path, place, monkeypatch):
    """Another ingest commits while one is at work: it leaves that one's documents alone; that one gives its generation up, decides again, and both count."""
    folder, store, run = place
    assert store.next_generation() == 1 and VersionedStore(spark, store.root).next_generation() == 2
    store.recover()
    other = tmp_path / "other"
    other.mkdir()
    write(other, "x.md", "x", "omega " * 80)
    write(other, "b2.md", "b", "gamma delta " * 60)
    real, calls = VersionedStore.append, []

    def append(self, tables, generation):
        real(self, tables, generation)
        calls.append(generation)
        if len(calls) == 1:
            ingest.run(spark, f"file://{other}", VersionedStore(spark, store.root))

    monkeypatch.setattr(VersionedStore, "append", append)
    assert run() == {"a": ("CREATE", None), "b": ("CREATE", None)}
    assert {r.doc_id: r.generation for r in store.read("documents").collect()} == {"x": 4, "a": 5, "b": 5}
    assert searched(spark, store) == {(1, "a"), (2, "b"), (5, "x")} and store.state()[1]["given_up"] == [1, 2, 3]
    with pytest.raises(GenerationUnavailable):
        store.publish({}, 3)  # given up for good
    with pytest.raises(CommitConflict):
        store.publish({}, store.next_generation(), base=1)


def test_reads_stay_flat(spark, tmp_path, place):
    folder, store, run = place
    for i in range(2):
        write(folder, "a.md", "a", f"alpha {'omega ' * i}" * 60)
        run()
    assert len(store.published()) == 2
    want = searched(spark, store)
    ingest.compact(store, keep=1)
    folders = lambda t: [x for x in os.listdir(tmp_path / "store" / t) if x.startswith("generation=")]
    assert all(folders(t) == ["generation=3"] for t in (*ingest.OF_DOCUMENTS, "documents", "runs", "batches"))
    assert store.open() == [] and {r.phase for r in ingest.journal(store).collect()} == {"DONE"}
    assert searched(spark, store) == want and store.history("batches").count() == 2
    with pytest.raises(GenerationUnavailable):
        ingest.roll_back_runs(store, spark.createDataFrame([("000000001-a",)], "run_id string"))
    write(folder, "a.md", "a", "delta " * 60)
    assert run() == {"a": ("REPLACE", None), "b": ("NOOP_OWNER", None)}
    active = {r.doc_id: r.run_id for r in store.read("documents").collect()}["a"]
    ingest.roll_back_runs(store, spark.createDataFrame([(active,)], "run_id string"))
    assert searched(spark, store) == want
