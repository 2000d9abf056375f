"""The ingest and evaluation plans end to end on small inputs."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import runtime
from quillon.operators import dense, lexical
from quillon.operators.dense import dense_topk
from quillon.operators.lexical import build_index
from quillon.plans import evaluate, ingest
from quillon.plans.retrieval import Corpus, hybrid_search, presets, read_corpus, run_variant, write_corpus
from quillon.sources.versions import VersionedStore

HEAD = "---\ndoc_id: {0}\ntitle: T\ndomain: d\nsource_type: s\nlanguage: en\n---\n# Title of {0}\n"


def write(folder, name, doc_id, body):
    (folder / name).write_text(HEAD.format(doc_id) + body)


def test_ingest_publishes_what_changed(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    write(folder, "a.md", "a", "alpha " * 80)
    write(folder, "b.md", "b", "beta " * 80)
    write(folder, "c.md", "a", "second with the same id " * 20)
    (folder / "d.md").write_text("# no front matter but blocked? no\n" + "word " * 80)
    (folder / "e.md").write_text("---\nx: [\n---\n")
    got = {r.path.rsplit("/", 1)[1]: (r.decision, r.error) for r in ingest.run(spark, f"file://{folder}", store).collect()}
    assert got == {"a.md": ("CREATE", None), "b.md": ("CREATE", None), "c.md": ("FAILED", "duplicate_doc_id"), "d.md": ("CREATE", None), "e.md": ("FAILED", "validation")}
    assert sorted({r.doc_id for r in ingest.published(store).collect()}) == ["a", "b", "d"] and store.generation("documents") == 1
    again = {r.decision for r in ingest.run(spark, f"file://{folder}", store).where("error IS NULL").collect()}
    assert again == {"NOOP_OWNER"} and store.generation("documents") == 1
    write(folder, "b.md", "b", "gamma " * 80)
    ingest.run(spark, f"file://{folder}", store)
    text = {r.doc_id: r.text for r in ingest.published(store).collect()}
    assert store.generation("documents") == 2 and "gamma" in text["b"] and "alpha" in text["a"]
    assert {r.doc_id for r in store.read("chunks", 2).collect()} == {"b"}  # a generation holds what is new
    assert {r.doc_id: r.generation for r in store.read("documents").collect()} == {"a": 1, "b": 2, "d": 1}


def test_a_bad_file_claims_no_id(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a_bad.md").write_text(HEAD.format("same").replace("---\n#", "tags: 5\n---\n#") + "bad " * 80)
    write(folder, "b_good.md", "same", "good " * 80)
    write(folder, "c_late.md", "same", "late " * 80)
    got = {r.path.rsplit("/", 1)[1]: (r.ok, r.error) for r in ingest.prepare(ingest.files.read_markdown(spark, f"file://{folder}")).collect()}
    assert got == {"a_bad.md": (False, "validation"), "b_good.md": (True, None), "c_late.md": (False, "duplicate_doc_id")}


def test_generations_are_never_written_again(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    for n in (1, 2, 3):
        assert store.publish({"t": spark.range(n)}) == n
    store.roll_back(["t"], 1)
    assert store.read("t").count() == 1 and store.publish({"t": spark.range(9)}) == 4
    assert [store.read("t", g).count() for g in (1, 2, 3, 4)] == [1, 2, 3, 9] and store.read("t").count() == 9
    store.append({"t": spark.range(5)}, 5)  # a crash before the pointer moves
    assert store.generation("t") == 4 and store.publish({"t": spark.range(6)}) == 6 and store.published() == [1, 2, 3, 4, 6]
    with pytest.raises(ValueError):
        store.roll_back(["t"], 7)


def test_states_read_what_is_stored(spark, tmp_path):
    """Each table of the store, broken in one way, shows in the decision."""
    folder = tmp_path / "docs"
    folder.mkdir()
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    write(folder, "a.md", "a", "alpha " * 80)
    ingest.run(spark, f"file://{folder}", store, model=("m1", 4))
    prepared = ingest.prepare(ingest.files.read_markdown(spark, f"file://{folder}"))
    chunks = ingest.markdown.chunk_documents(prepared.where("ok").withColumnRenamed("clean", "body"), "doc_id", "body")
    stored = ingest.read_stored(store)

    def decision(force=False, model=("m1", 4), **changed):
        row = ingest.lifecycle.decide(ingest.states(prepared, chunks, replace(stored, **changed), force, model)).first()
        return row.decision, row.reason

    lit = F.lit
    assert decision() == ("NOOP_OWNER", "unchanged") and decision(force=True) == ("REPLACE", "changed") and decision(model=("m2", 4)) == ("REPLACE", "changed")
    assert decision(ops=spark.createDataFrame([("a", "WRITING")], "doc_id string, phase string"))[1] == "pending_operation"
    assert decision(ops=spark.createDataFrame([("a", "DONE")], "doc_id string, phase string"))[0] == "NOOP_OWNER"
    assert decision(runs=stored.runs.withColumn("state", lit("FAILED")))[1] == "run_not_committed"
    assert decision(runs=stored.runs.withColumn("content_hash", lit(None).cast("string")))[1] == "hash_missing"
    assert decision(documents=stored.documents.withColumn("content_hash", lit("other")))[1] == "document_hash"
    assert decision(documents=stored.documents.withColumn("path", lit("other")))[1] == "path"
    assert decision(vectors=None)[1] == "vectors_unverifiable"
    assert decision(vectors=stored.vectors.withColumn("text_sha", lit("x")))[1] == "stores_differ" and decision(fts=stored.fts.union(stored.fts))[1] == "stores_differ"
    two = stored.chunks.unionByName(stored.chunks.withColumn("chunk_id", lit("more")).withColumn("model_version", lit("m9")))
    assert decision(chunks=two)[1] == "mixed_models"
    fewer = stored.runs.withColumn("chunk_ids", F.array(lit("gone")))
    assert decision(runs=fewer)[1] == "chunk_ids"
    assert decision(documents=stored.documents.withColumn("title", lit("Other")))[0] == "REPLACE"
    assert decision(documents=stored.documents.withColumn("path", lit("q")), runs=stored.runs.withColumn("path", lit("q")))[0] == "NOOP_EQUIVALENT_OTHER_SOURCE"
    legacy = stored.documents.withColumn("run_id", lit(None).cast("string"))
    assert decision(documents=legacy) == ("NOOP_OWNER", "unchanged")
    assert decision(documents=None, runs=None, chunks=None, vectors=stored.vectors.limit(0), fts=stored.fts.limit(0)) == ("CREATE", "new")
    assert decision(documents=None, runs=None, chunks=None)[1] == "orphans"


def test_an_ingest_writes_every_table(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    write(folder, "a.md", "a", "alpha " * 80)
    (folder / "bad.md").write_text("---\nx: [\n---\n")
    embed = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    ingest.run(spark, f"file://{folder}", store, embed=embed, model=("m1", 2))
    n = ingest.published(store).count()
    assert n and all(ingest.published(store, t).count() == n for t in ("vectors", "fts")) and ingest.published(store, "vectors").first().embedding == [1.0, 0.0]
    assert {r.tag for r in ingest.published(store, "document_tags").collect()} == {"domain:d", "source_type:s", "lang:en"}
    assert [(r.total, r.committed, r.failed, r.status) for r in store.history("batches").collect()] == [(2, 1, 1, "PARTIAL")]
    write(folder, "b.md", "b", "beta " * 80)
    ingest.run(spark, f"file://{folder}", store, embed=embed, model=("m1", 2))
    store.roll_back(["documents"], 1)
    assert {r.doc_id for r in ingest.published(store).collect()} == {"a"}
    ingest.run(spark, f"file://{folder}", store, embed=embed, model=("m1", 2))
    assert store.generation("documents") == 3 and {r.doc_id for r in ingest.published(store).collect()} == {"a", "b"}


def test_repair(spark):
    chunks = spark.createDataFrame([("c1", "d", "x", "", 0), ("c2", "d", "y", "m", 4)], "chunk_id string, doc_id string, text string, model_version string, embedding_dim int")
    vectors = spark.createDataFrame([("c1", "d"), ("zz", "d")], "chunk_id string, doc_id string")
    fts = spark.createDataFrame([("d", "c1", "s"), ("d", "c1", "s")], "doc_id string, chunk_id string, text_sha string")
    full, kept, index = ingest.repair(chunks, vectors, fts, ("m", 4))
    assert {(r.model_version, r.embedding_dim) for r in full.collect()} == {("m", 4)} and [r.chunk_id for r in kept.collect()] == ["c1"] and sorted(r.chunk_id for r in index.collect()) == ["c1", "c2"]


def chunks_of(spark):
    words = ["trade data set", "price index data", "survey of trade", "nothing else here", "trade trade data"]
    rows = [(f"c{i}", f"d{i % 2}", t, f"Part {i}", i, i + 1, [1.0, i / 10, 0.0]) for i, t in enumerate(words)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, heading_path string, line_start int, line_end int, embedding array<float>")


def test_search_and_evaluation(spark, tmp_path):
    chunks = chunks_of(spark)
    sparse = ingest.backfill_sparse(chunks, spark.createDataFrame([], "chunk_id string, token string, weight double"))
    write_corpus(Corpus(chunks.select("chunk_id", "doc_id", "embedding"), build_index(chunks), sparse), f"file://{tmp_path}/index")
    corpus = read_corpus(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "trade data", [1.0, 0.4, 0.0]), (2, "absent", None)], "qid int, text string, embedding array<float>")
    weights = spark.createDataFrame([(1, "trade", 1.0), (1, "data", 1.0)], "qid int, token string, weight double")
    hits = hybrid_search(corpus, asked, weights, presets(top_k=4))
    assert {r.qid for r in hits.collect()} == {1} and hits.count() == 4
    assert [r.chunk_id for r in run_variant("bm25", corpus, asked, weights).orderBy("final_pos").collect()] == ["c4", "c0"]
    assert hybrid_search(corpus, asked, weights, docs=spark.createDataFrame([], "doc_id string")).count() == 0
    assert {r.doc_id for r in hybrid_search(corpus, asked, weights, docs=spark.createDataFrame([("d1",)], "doc_id string")).collect()} == {"d1"}
    shown = evaluate.contexts(hits, asked, chunks)
    first = shown.where("prompt_index = 1").first()
    answer = f"Trade data are described well enough [[1] Fuente: {first.doc_id} | Sección: {first.heading_path} | Líneas: {first.line_start}-{first.line_end}]."
    rows = evaluate.evaluate(spark.createDataFrame([(1, answer, 1.0), (3, None, None)], "qid int, answer string, consistency double"), shown)
    got = {r.qid: r for r in rows.collect()}
    assert got[1].trust_level == "HIGH" and not got[1].abstains and "Fuente" not in got[1].answer_for_eval and got[3].error == "no_answer" and got[3].abstains
    assert evaluate.no_answer_correctness(rows.withColumn("negative", F.col("qid") == 3)).first().correctness == 1.0


def test_queries_in_many_blocks(spark, monkeypatch):
    from quillon.operators import dense

    chunks = chunks_of(spark).select("chunk_id", "doc_id", "embedding")
    asked = spark.createDataFrame([(i, [1.0, i / 7, 0.5]) for i in range(23)] + [(99, None), (98, [1.0])], "qid int, embedding array<float>")
    whole = sorted(map(tuple, dense_topk(chunks, asked, 3).select("qid", "chunk_id", "dense_rank").collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "HELD_BLOCKS", 2)
    parts = dense_topk(chunks, asked, 3)
    assert sorted(map(tuple, parts.select("qid", "chunk_id", "dense_rank").collect())) == whole and len(whole) == 69
    assert evaluate.ranking_overlap(parts, parts, 3).first().recall == 1.0


def test_common_vector(spark):
    rows = [(i, "d", [1.0, 1.0]) for i in range(500)] + [(1000, "d", [1.0, 1.01])]
    vectors = spark.createDataFrame(rows, "chunk_id int, doc_id string, embedding array<float>").coalesce(1)
    got = dense_topk(vectors, spark.createDataFrame([(1, [2.0, 2.0])], "qid int, embedding array<float>"), 3)
    assert [r.chunk_id for r in got.orderBy("dense_rank").collect()] == [0, 1, 2]


def test_repairs(spark):
    chunks = chunks_of(spark)
    docs = spark.createDataFrame([("d0", "active", "T")], "doc_id string, status string, title string")
    assert sorted((r.doc_id, r.title) for r in ingest.documents_from_chunks(docs, chunks).collect()) == [("d0", "T"), ("d1", "Part 1")]
    assert ingest.config_diff({"m": 16, "x": 1}, {"m": 32, "x": 1}) == [("m", 16, 32)]


def test_dense_keeps_the_best_of_a_task(spark, monkeypatch):
    """Rows meet the queries in small products; a task gives its k best of all of them, ties by the smallest ids."""
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)).round(1)
    x[40:70] = x[5]
    vectors = spark.createDataFrame([(f"c{i * 37 % 90:02d}", f"d{i % 4}", [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, doc_id string, embedding array<double>").coalesce(1)
    asked = rng.normal(size=(6, 4))
    asked[2] = x[5]
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(asked)], "qid int, embedding array<double>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    near = np.round(unit(asked) @ unit(x).T, 9)
    want = {(q, f"c{i * 37 % 90:02d}", place + 1) for q in range(6) for place, i in enumerate(sorted(range(90), key=lambda i: (-near[q, i], i * 37 % 90))[:5])}
    assert {(r.qid, r.chunk_id, r.dense_rank) for r in dense.dense_topk(vectors, queries, 5).collect()} == want


def test_batches_for_python_are_bounded(spark):
    """However a session is set, what a worker is given at once has a fixed bound in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    lexical.post(spark.createDataFrame([("a", "d", "x")], "chunk_id string, doc_id string, text string"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    thin = spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long, size long").collect()
    wide = spark.range(0, 400, 1, 1).selectExpr("repeat(CAST(id % 10 AS string), 65536) AS t").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in thin) == 9000 and max(r.n for r in thin) <= runtime.BATCH_ROWS
    assert sum(r.n for r in wide) == 400 and max(r.size for r in wide) <= runtime.BATCH_BYTES + (1 << 18)
