"""The corpus pipeline on a small folder, stage by stage, against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import ROWS, brute_fp, brute_grams, brute_hits, brute_kept, roots

import corpus_pipeline
from quillon.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rest string, blob string, place string, bad_doc string, __k0 string, __text string, text_hash string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def write(spark, path, rows, items):
    full = [(i, t, None if "ж" in (t or "") else random.Random(str(t)).choice(["en", "de", None]), "s", len(t or ""), "f", "r", "b", "p", None, "k", "x", "h") for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    text = dict((i, t) for i, t in ROWS)
    rows = [*ROWS, (600, "ж щ ю ф ы " * 20), (None, "ж щ ю ф ы " * 20), (601, "... 123"), ROWS[0], ROWS[-1]]
    return write(spark, tmp_path_factory.mktemp("sf"), rows, [(1, text[9]), (2, text[40])])


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.schema, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        rows = out.collect()
        if k < 4:
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
            assert all((r.source, r.fp, r.bad_doc, r["__k0"], r["__text"], r.text_hash) == ("s", "f", None, "k", "x", "h") for r in rows)
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 0:
            prototypes = langid.fit(docs)
            least = langid.rejection(docs, prototypes)
            size = lambda t: sum(brute_grams(t or "").values())
            good = {t for t in {t for _, t in before} if cosine(t, prototypes) >= least > 0 or 0 < size(t) < 100}
            assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t in before if t in good)
            assert {t for _, t in before if any(c.isalpha() for c in t or "")} - good == {"ж щ ю ф ы " * 20}
        elif k == 1:
            fps = [brute_fp(t) for _, t in before]
            root = roots(len(before), [(i, j) for i in range(len(before)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
            groups = defaultdict(list)
            for (i, t), x in zip(before, root):
                groups[x].append((i, t))
            assert len(rows) == len(groups) and {r.doc_id for r in rows if r.doc_id is not None} == {min(i for i, _ in g if i is not None) for g in groups.values() if any(i is not None for i, _ in g)}
            assert Counter((r.doc_id, r.text) for r in rows) <= Counter(before)
        elif k == 2:
            assert Counter((r.doc_id, len(r.text.encode().split()), hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest()) for r in rows) == Counter((i, n - m, h) for (i, n, m, h), c in brute_kept(before).items() for _ in range(c))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert Counter(r.doc_id for r in rows) == Counter(i for (i, _, n, _), c in brute_hits(before, items).items() for _ in range(c) if n == 0)
            assert len(rows) < len(before)
        else:
            assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in before)
        seen.append(name)
        if k < 4:
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    assert len(seen) == 5
    last = sorted(map(str, rows))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(shared))
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == last
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - there if not x.startswith(".")}
    assert left <= {name for name, _ in corpus_pipeline.STAGES}


def cosine(text, prototypes):
    """Best cosine of a text's summed gram vectors, by hand."""
    grams = brute_grams(text or "")
    if not grams:
        return -1.0
    v = np.array(list(grams.values()), np.float64) @ langid._gram_vectors(np.array(list(grams), np.uint64)).astype(np.float64)
    return max(float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for p in prototypes.values())


def test_empty_tables_and_nulls(spark, tmp_path):
    empty = write(spark, tmp_path / "empty", [], [])
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, empty)
        assert out.count() == 0 and (k == 4 or out.columns == NAMES)
    assert corpus_pipeline.run(spark, empty).count() == 0
    nulls = write(spark, tmp_path / "nulls", [(None, None), (1, None), (2, ""), (None, ""), (3, None)], [(1, None), (None, "some words"), (2, "")])
    docs = spark.read.parquet(f"{nulls}/documents.parquet")
    got = [pairs(stage(spark, docs, nulls)) for _, stage in corpus_pipeline.STAGES[:4]]
    assert got[0] == got[2] == got[3] == pairs(docs)  # nothing is labelled with a letter, so all stay
    assert len(got[1]) == 1 and next(iter(got[1]))[0] == 1
    assert corpus_pipeline.run(spark, nulls).count() == 1


def test_without_a_benchmark_all_stay(spark, tmp_path, folder):
    none = write(spark, tmp_path / "none", ROWS, [])
    docs = spark.read.parquet(f"{none}/documents.parquet")
    assert pairs(corpus_pipeline.decontaminate(spark, docs, none)) == pairs(docs)


def test_registered_sql(spark):
    import duckdb

    from quillon.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf), con.execute(sql)
        names = [c[0] for c in want.description]
        key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
        assert sorted(got.columns) == sorted(names)
        assert key(got.select(*names).collect()) == key(want.fetchall()), name
