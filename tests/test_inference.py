"""Batch inference: the encoder's vectors, failures as a column, one model a worker, and a search from raw texts."""

import math
import os
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from quillon import inference
from quillon.operators.dense import dense_topk


def by_hand(words, dim):
    out = [0.0] * dim
    for w in words:
        n = int(md5(w.encode()).hexdigest()[:8], 16)
        out[n // 2 % dim] += -1 if n % 2 else 1
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "Trade, data trade"), (2, ""), (3, None), (4, "Ñandú 12"), (5, "x " * 5000)], "id int, text string")
    got = {r.id: r for r in inference.hashed(rows, dim=32).collect()}
    assert got[1].asDict().keys() == {"id", "text", "embedding", "failure"}
    for i, words in ((1, ["trade", "data", "trade"]), (2, []), (5, ["x"] * 5000)):
        assert np.allclose(got[i].embedding, by_hand(words, 32)) and got[i].failure is None
    assert abs(np.linalg.norm(got[4].embedding) - 1) < 1e-12
    assert got[3].embedding is None and got[3].failure == "no text"
    assert inference.hashed(rows.where("false"), dim=32).count() == 0


def test_a_failure_is_a_column(spark):
    class Choosy:  # refuses a batch with a long text, and tells which process made it
        def __call__(self, texts):
            if any(len(t) > 10 for t in texts):
                raise ValueError("too long")
            return np.array([[len(t), os.getpid(), id(self) % 100003] for t in texts], float)

    rows = spark.range(500).select("id", F.when(F.col("id") % 50 == 7, "far too long a text").when(F.col("id") % 50 == 8, F.lit(None).cast("string")).otherwise(F.repeat(F.lit("a"), (F.col("id") % 9).cast("int"))).alias("text")).repartition(8)
    got = inference.encoder(Choosy, dim=3, batch=16)(rows).collect()
    assert len(got) == 500 and {r.failure for r in got} == {None, "no text", "ValueError: too long"}
    assert all((r.embedding is None) == (r.failure is not None) == (r.id % 50 in (7, 8)) for r in got)
    assert all(r.embedding[0] == r.id % 9 for r in got if r.failure is None)
    made = {tuple(r.embedding[1:]) for r in got if r.failure is None}
    assert len(made) == len({pid for pid, _ in made})  # one model a worker, over all its batches and partitions


def test_from_raw_text_to_neighbours(spark):
    docs = spark.createDataFrame([(f"c{i}", f"d{i}", t) for i, t in enumerate(["trade data by country", "a price index", "population survey", None, ""])], "chunk_id string, doc_id string, text string")
    asked = spark.createDataFrame([(1, "Trade data"), (2, "price of the index"), (3, None)], "qid int, text string")
    found = dense_topk(inference.hashed(docs), inference.hashed(asked), 1).collect()
    assert {(r.qid, r.chunk_id) for r in found} == {(1, "c0"), (2, "c1")}
