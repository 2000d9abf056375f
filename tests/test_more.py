"""Runner, calibration, timing, settings, errors and the approximate index on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config, errors, providers
from quillon.operators import ann, lifecycle, markdown, metadata, verification
from quillon.operators.dense import dense_topk
from quillon.plans import benchmark, evaluate, ingest, timing
from quillon.plans.registry_more import CONTRACT
from quillon.plans.retrieval import index_corpus, read_corpus
from quillon.plans.session import Session, search
from quillon.sources import files


def test_environment(tmp_path):
    (tmp_path / "env").write_text("# note\n\nQUILLON_TOP_K=7\nQUILLON_MMR_ON = off\nbroken\nQUILLON_RRF_K=9\nA=b=c\n")
    env = {"QUILLON_RRF_K": "30"}  # the shell wins
    assert config.load_env(str(tmp_path / "env"), env)["A"] == "b=c" and config.load_env(str(tmp_path / "none"), env) == {}
    s = config.from_env(env=env)
    assert (s.top_k, s.rrf_k, s.mmr_on, s.mmr_lambda) == (7, 30, False, config.DEFAULTS.mmr_lambda)


def test_errors_are_contracts(spark, tmp_path):
    """Every error class is raised by the contract that it names, and is a ValueError for those who don't know it."""
    from quillon.sources.versions import VersionedStore

    (tmp_path / "suite.json").write_text("[]")
    with pytest.raises(errors.SuiteInvalid):
        files.load_suite(spark, f"file://{tmp_path}/suite.json")
    with pytest.raises(errors.CommandUnknown):
        Session().command("/nothing", "x")
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(errors.GenerationUnavailable):
        store.roll_back(["t"], 1)
    store.publish({"t": spark.range(1)})
    with pytest.raises(errors.CommitConflict):
        store.publish({"t": spark.range(2)}, base=0)
    assert store.open() == [] and store.generation("t") == 1 and issubclass(errors.ContractError, ValueError)


def test_timer_and_log(spark, tmp_path):
    with timing.PhaseTimer() as t:
        t.start("a")
        t.start("b")
        assert list(t.seconds) == ["a"] and t.stop() >= 0 and t.stop() == 0
        t.start("c")
    assert list(t.seconds) == ["a", "b", "c"] and t.total() == sum(t.seconds.values())
    log = f"file://{tmp_path}/log"
    for x in (1.0, 3.0, 2.0):
        timing.append_log(spark, {"search": x, "rest": x / 2}, log)
    row = timing.log_summary(timing.read_log(spark, log)).first()
    assert (row.least, row.p50, row.most, row.n) == (1.5, 3.0, 4.5, 3)
    bars = {r.phase: r.bar for r in timing.phase_report(timing.read_log(spark, log)).collect()}
    assert bars["search"] == "█" * 20 and bars["rest"] == "█" * 10 + "░" * 10
    assert timing.log_summary(timing.read_log(spark, log).limit(0)).count() == 0
    t.reset()
    assert t.total() == 0


def test_config_checks_and_feedback(spark):
    assert lifecycle.config_issues() == [] and len(lifecycle.config_issues(config.Settings(top_k=0, sparse_coverage=2.0), "")) == 3
    log = spark.createDataFrame([], "id long, query_text string, chunk_id string, feedback string, query_hash string")
    new = spark.createDataFrame([("What  IS it", "c1", "useful"), ("x", "c2", "odd"), ("what is it", "c0", "relevant")], "query_text string, chunk_id string, feedback string")
    rows = lifecycle.feedback_add(log, new, {"k": 1}).orderBy("id").collect()
    assert [(r.id, r.chunk_id, r.normalized_query) for r in rows] == [(1, "c1", "what is it"), (2, "c0", "what is it")] and rows[0].query_hash == rows[1].query_hash
    empty, n = lifecycle.feedback_clear(spark.createDataFrame(rows))
    assert n == 2 and empty.count() == 0


def test_yaml_may_be_absent(monkeypatch):
    monkeypatch.setattr(markdown, "yaml", None)
    assert ("INFO", "yaml_unavailable", 1) in markdown.issues(CONTRACT[0][0])


@pytest.mark.parametrize("text,want", [c for c in CONTRACT if c[0] is not None])
def test_contract(text, want):
    assert sorted(markdown.issues(text), key=str) == sorted(want, key=str)


def test_cells_find_the_near(spark):
    rng = np.random.default_rng(5)
    spots = ann.unit(rng.normal(size=(6, 8)))
    rows = [(i, "d", (spots[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows + [(999, "d", None)], "chunk_id int, doc_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, spots[i].tolist()) for i in range(6)], "qid int, embedding array<float>")
    c = ann.centres(vectors, 6)
    exact = dense_topk(vectors, asked, 20)
    assert evaluate.ranking_overlap(exact, ann.search(vectors, asked, c, 2, 20), 20).first().recall > 0.95
    assert evaluate.ranking_overlap(exact, ann.search(vectors, asked, c, len(c), 20), 20).first().recall == 1.0
    assert ann.centres(vectors.limit(0), 4).size == 0


def test_fusion_settings_see_their_own_candidates(spark):
    rows = [(1, f"c{i}", f"d{i}", i + 1 if i < 4 else None, 4 - i if i < 3 else (6 if i == 4 else None), 5 - i) for i in range(5)]
    ranked = spark.createDataFrame(rows, "qid int, chunk_id string, doc_id string, dense_rank int, bm25_rank int, sparse_rank int")
    grid = spark.createDataFrame([(0, 2, 3, 1.0, 1.0, 60, 1.0), (1, 9, 9, 0.0, 0.0, 60, 1.0)], "config_id int, dense_k int, bm25_k int, sparse_w double, bm25_w double, rrf_k int, dense_w double")
    got = benchmark.fuse(ranked, grid).orderBy("config_id", "pos").collect()
    assert {r.chunk_id for r in got if r.config_id == 0} == {"c0", "c1", "c2"} and [r.sparse_rank for r in got if r.config_id == 0 and r.chunk_id == "c2"] == [1]
    assert [r.chunk_id for r in got if r.config_id == 1] == ["c0", "c1", "c2", "c3", "c4"]
    assert benchmark.grid_table(spark).count() == 324 and json.dumps(benchmark.GRID)
    judged = spark.createDataFrame([(1, "d1", 3), (2, "d1", 1)], "qid int, doc_id string, grade int")
    every = spark.createDataFrame([(1, "a", None), (2, "b", None)], "qid int, text string, category string")
    out = benchmark.calibrate(ranked, grid, judged, every).orderBy("place").collect()
    assert len(out) == 2 and {r.config_id for r in out} == {0, 1} and all(0 <= r["recall@5"] <= 0.5 for r in out)
    assert benchmark.scores(got_frame(spark), judged, every.withColumn("k", F.lit("v")), "k").where("qid = 2").first()["recall@5"] == 0


def got_frame(spark):
    return spark.createDataFrame([("v", 1, "c1", "d1", 1, 1, None, None)], "k string, qid int, chunk_id string, doc_id string, pos int, dense_rank int, bm25_rank int, sparse_rank int")


def test_session_commands():
    s = Session()
    assert s.command("/docs", "a, b").docs == ("a", "b") and s.command("docs", "a").command("docs", "ALL").docs is None
    assert s.command("mode", "hyde").hyde and not s.command("mode", "hyde").command("mode", "standard").hyde and s.command("mode", "hyde").command("mode", "fast").hyde
    assert s.command("temp", "0.7").temperature == 0.7 and s.command("topk", "9").top_k == 9 and s.command("rewrite", "on").rewrite and s.command("feedback") == s
    for bad in (("mode", "x"), ("hyde", "maybe"), ("temp", "warm"), ("nope", None)):
        with pytest.raises(ValueError):
            s.command(*bad)


def test_session_search(spark, tmp_path):
    words = ["trade data set", "price index data", "survey of trade", "nothing else here", "trade trade data"]
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 2}", t, [1.0, i / 10]) for i, t in enumerate(words)], "chunk_id string, doc_id string, text string, embedding array<float>")
    index_corpus(spark, chunks.select("chunk_id", "doc_id", "text"), chunks.select("chunk_id", "doc_id", "embedding"), f"file://{tmp_path}/index")
    corpus = read_corpus(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, 0, "trade data", [1.0, 0.0]), (1, 1, "trade data", [1.0, 0.4]), (2, 0, "price", [1.0, 0.1])], "qid int, variant_no int, text string, embedding array<float>")
    rows = search(corpus, asked, chunks.select("chunk_id", "text"), Session()).collect()
    first = {r.qid: r for r in rows if r.pos == 1}
    assert first[1].chunk_id in ("c0", "c4") and first[1].rerank_score == 1.0 and first[2].chunk_id == "c1"
    assert len({(r.qid, r.chunk_id) for r in rows}) == len(rows) == 10
    fast = search(corpus, asked, chunks.select("chunk_id", "text"), Session(mode="fast", docs=("d1",))).collect()
    assert {r.doc_id for r in fast} == {"d1"} and {r.rerank_score for r in fast} == {None} and [r.pos for r in fast if r.qid == 1] == [r.merged_pos for r in fast if r.qid == 1]
    sparse = spark.createDataFrame([(1, "survey", 5.0)], "qid int, token string, weight double")
    assert search(corpus, asked, chunks.select("chunk_id", "text"), Session(), sparse).count() == 10


def test_generation_is_a_column(spark):
    rows = spark.createDataFrame([(1, 100), (2, 7500), (3, 100), (4, 100), (5, 100)], "qid int, prompt_tokens int")

    def call(asked):
        at = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("qid"))
        return asked.withColumn("content", at("said", "", "", "", "")).withColumn("reasoning", at(None, None, None, None, None).cast("string")).withColumn("failure", at("", "", "the context is too long", "refused", ""))

    got = {r.qid: r for r in providers.generated(rows, call).collect()}
    assert {q: r.status for q, r in got.items()} == {1: "ok", 2: "overflow", 3: "overflow", 4: "connection", 5: "empty"} and got[1].answer == "said" and got[1].output_tokens == 7580 and got[3].answer is None
    made = []
    assert [providers.cached(lambda *k: made.append(k) or len(made), "m", "cpu") for _ in range(1)] == [1]
    maker = made.append
    providers.cached(maker, 5), providers.cached(maker, 5)
    assert made.count(5) == 1


def test_verification_text(spark):
    chunks = spark.createDataFrame([(1, "d", "c1", "A", 1, 5, 9, 0.2), (1, "d", "c2", "B", 2, 1, 2, 0.8)], "qid int, doc_id string, chunk_id string, heading_path string, pos int, line_start int, line_end int, rerank_score double")
    answers = spark.createDataFrame([(1, "x [[1] Fuente: d | Sección: A | Líneas: 5-9]", 1.0), (2, "nothing", None)], "qid int, answer string, consistency double")
    cited = verification.classify(verification.citations(answers), chunks)
    got = {r.qid: r.block for r in verification.summary_text(cited, verification.trust(answers, cited, chunks), chunks).collect()}
    assert got[1].split("\n")[1:4] == ["  [1] d | 5-9  0.0/10 " + "░" * 10, "  [2] d | 1-2  10.0/10 " + "█" * 10, "  Citations: 1/1"] and "Consistency: OK" in got[1] and "0/0" in got[2]


def test_answer_log_and_index_config(spark, tmp_path):
    row = ("q", None, False, '["k1", "k2"]', 0.5, "LOW", True, "2024-01-01")
    df = spark.createDataFrame([row], files.ANSWER_FEEDBACK)
    for _ in range(2):
        files.save_answer_feedback(df, f"file://{tmp_path}/log")
    assert lifecycle.top_chunks(files.read_answer_feedback(spark, f"file://{tmp_path}/log")).first().n == 2
    files.write_index_config(spark, {"cells": 32}, f"file://{tmp_path}/config")
    assert ingest.config_diff(files.read_index_config(spark, f"file://{tmp_path}/config"), {"cells": 64}) == [("cells", 32, 64)]
    assert metadata.post_filter(df, None) is df
