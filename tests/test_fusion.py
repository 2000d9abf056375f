"""Fusion and diversity against plain Python."""

import random

import pytest

from quillon.operators.fusion import document_cap, document_mmr, weighted_rrf

RANKED = "qid int, chunk_id string, doc_id string, dense_rank int, bm25_rank int, sparse_rank int"


def ranks(spark, rows):
    return spark.createDataFrame(rows, RANKED)


def test_small_weight_flips_order(spark):
    rows = [(1, f"f{i}", "d", i, None, None) for i in range(1, 6)] + [(1, "small", "d", 6, None, 2), (1, "large", "d", None, None, 1)]
    order = {w: [r.chunk_id for r in weighted_rrf(ranks(spark, rows), 20, 1, 1, w).orderBy("rrf_rank").collect()] for w in (0.25, 1.0)}
    assert order[1.0][0] == "small" and order[0.25][-1] == "large"


def test_zero_weight_rows_stay_listed(spark):
    got = weighted_rrf(ranks(spark, [(1, "a", "d", None, None, 1), (1, "b", "d", 1, None, None)]), 20, 1, 1, 0).orderBy("rrf_rank").collect()
    assert [(r.chunk_id, round(r.rrf_score, 9)) for r in got] == [("b", round(1 / 21, 9)), ("a", 0.0)]


def greedy(rows, lam):
    """Greedy selection with a penalty for documents seen, ties to the earliest."""
    top = max(s for _, _, s in rows)
    if top <= 0:
        return [c for c, _, _ in rows]
    left, seen, out = list(rows), set(), []
    while left:
        best = max(range(len(left)), key=lambda i: (round(lam * left[i][2] / top - (1 - lam) * (left[i][1] in seen), 12), -i))
        c, d, _ = left.pop(best)
        seen.add(d)
        out.append(c)
    return out


@pytest.mark.parametrize("lam", [0.0, 0.6, 1.0])
def test_mmr_closed_form_is_greedy(spark, lam):
    rng = random.Random(7)
    lists, rows = {}, []
    for q in range(60):
        scores = sorted((rng.choice([0, 1, 2, 3, 5, 8]) / 10 for _ in range(rng.randint(1, 12))), reverse=True)
        lists[q] = [(f"c{i}", f"d{rng.randint(0, 3)}", s) for i, s in enumerate(scores)]
        rows += [(q, c, d, s, i + 1) for i, (c, d, s) in enumerate(lists[q])]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, doc_id string, rrf_score double, rrf_rank int")
    got = {}
    for r in document_mmr(df, lam).orderBy("qid", "final_pos").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {q: greedy(x, lam) for q, x in lists.items()}


def test_cap(spark):
    df = spark.createDataFrame([(1, f"c{i}", "a" if i < 4 else "b", i + 1) for i in range(6)], "qid int, chunk_id string, doc_id string, rrf_rank int")
    assert [r.chunk_id for r in document_cap(df, 2).orderBy("final_pos").collect()] == ["c0", "c1", "c4", "c5"]
    with pytest.raises(ValueError):
        document_cap(df, 0)
