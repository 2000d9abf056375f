"""BM25 against the full-text index of the standard library's SQLite."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import abstains, fold, last_terms, phrases, strip_citations, tokens, without_stop_words
from quillon.operators.lexical import bm25, build_index

TEXTS = [
    "Data set about trade data", "the data-set and the set of data", "Élan vital, élan!", "straße und øre", "set data data", "data_set code", "nothing here", "trade trade trade data set", "", None,
]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame([(i, f"d{i % 3}", t) for i, t in enumerate(TEXTS)], "chunk_id int, doc_id string, text string"))


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize = \"unicode61 remove_diacritics 2\")")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(i + 1, t or "") for i, t in enumerate(TEXTS)])
    return con


@pytest.mark.parametrize("query,match", [("data", '"data"'), ("data set", '"data" "set"'), ("data-set", '"data-set"'), ("Elan", '"elan"'), ("trade data data", '"trade" "data" "data"'), ("straße", '"straße"'), ("data_set", '"data_set"')])
def test_scores(spark, index, fts, query, match):
    want = {r - 1: -s for r, s in fts.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
    got = {r.chunk_id: r.bm25_score for r in bm25(index, spark.createDataFrame([(1, query)], "qid int, text string"), 50).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 or got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_filter_keeps_global_weights(spark, index):
    q = spark.createDataFrame([(1, "data")], "qid int, text string")
    full = {r.chunk_id: r.bm25_score for r in bm25(index, q, 50).collect()}
    some = {r.chunk_id: r.bm25_score for r in bm25(index, q, 50, spark.createDataFrame([("d1",)], "doc_id string")).collect()}
    assert some == {k: v for k, v in full.items() if k % 3 == 1}
    assert bm25(index, q, 50, spark.createDataFrame([], "doc_id string")).count() == 0


def test_unmatched_and_empty_queries(spark, index):
    q = spark.createDataFrame([(1, "absent"), (2, "- !"), (3, ""), (4, None), (5, "data absent")], "qid int, text string")
    assert bm25(index, q, 5).count() == 0


def test_text_functions(spark):
    row = spark.range(1).select(
        tokens(F.lit("Ärger_des ﬁnal-x 2é")).alias("t"), fold(F.lit("ÀÉÎõü ß ø")).alias("f"), phrases(F.lit("what's data-set? -")).alias("p"),
        without_stop_words(F.lit("What is the role of SDMX?")).alias("w"), last_terms(F.lit("a b1 c2 d3 e4 f5 g6")).alias("l"),
        abstains(F.lit("The provided documents do not mention any such thing at all.")).alias("a"), abstains(F.lit("x" * 40)).alias("n"), abstains(F.lit(None).cast("string")).alias("z"),
        strip_citations(F.lit("Done [[1] Fuente: a | b]. More")).alias("s"),
    ).first()
    assert row.t == ["arger", "des", "ﬁnal", "x", "2e"] and row.f == "aeiou ß ø" and row.p == [["what"], ["s"], ["data", "set"]]
    assert row.w == "role sdmx" and row.l == "c2 d3 e4 f5 g6" and row.a and not row.n and row.z and row.s == "Done. More"
