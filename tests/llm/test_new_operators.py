"""MinHash near-duplicates, the conversation trie and hard negatives by brute force: small tables with nulls, ties, repeats, long texts, and the registered queries."""

import hashlib
import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import minhash, negatives, queries, trie

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


# -- MinHash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text)."""
    sets = [brute_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    of = [least.get(find(i)) for i in range(len(rows))]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, of)), key=repr)


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(df).collect()), key=repr)


def changed(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "É a b"), (8, "é a b"), (None, "one"), (None, "alone here"), (9, "one"), (9, "one"), (9, "other words of one id")]
    base = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (12, 30, 45, 60, 200)]
    # copies around the threshold: many of a group share buckets and few are linked, and chains link what no hub is linked to
    for k, words in enumerate(base):
        for i in range(24):
            rows.append((100 * (k + 1) + i, changed(words, rng, i % 5)))
        chain = list(words)
        for i in range(14):
            chain[rng.randrange(len(chain))] = f"y{k}-{i}"
            rows.append((1000 * (k + 1) + i, " ".join(chain)))
    rows.append((77777, " ".join(f"w{rng.randrange(50)}" for _ in range(60000))))
    assert near(spark, rows) == brute_components(rows)


def test_minhash_needs_more_than_hubs(spark):
    """A hub that is in every bucket and linked to nobody; the others are linked to one another."""
    words = [f"w{i}" for i in range(60)]
    group = [" ".join([*words[: 60 - j], *[f"z{i}" for i in range(j)]]) for j in (8, 9, 10, 11)]
    rows = [(i, t) for i, t in enumerate([" ".join(words), *group, " ".join(["p", *words[5:]])])]
    assert near(spark, rows) == brute_components(rows)


def test_minhash_empty_and_extra_columns(spark):
    assert minhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 5, "n"), (2, "a b c d", 6, "m")], "doc_id long, text string, key int, node string").withColumn("component_id", F.lit(3)).withColumn("bands", F.lit(3))
    assert sorted(r.component_id for r in minhash.near_components(df).collect()) == [1, 1]


def test_signature_follows_the_sets(spark):
    """Shared bins come close to the likeness, also where sets are much smaller than the bins."""
    rng = np.random.default_rng(3)
    for n in (6, 20, 200, 3000):
        got = []
        for _ in range(60):
            every = rng.integers(0, 2**63, n + n // 6, dtype=np.uint64)
            a, b = np.unique(every[:n]), np.unique(every[n // 6 :])
            got.append((minhash.signature(a) == minhash.signature(b)).mean())
        want = (n - n // 6) / (n + n // 6)
        assert abs(np.mean(got) - want) < 0.05
    assert (minhash.signature(np.array([7], np.uint64)) == 7).all()


def test_op11(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op11_minhash(spark, SF).collect()), key=repr)
    assert got == brute_components(docs)


# -- trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, mine in own.items():
        h = crc32(str(c).encode()) % 6
        base = own.get(c - int(math.fmod(c, 100)), [])
        full[c] = tuple(base[:h] + mine[h:])
    nodes = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        return [p] + [x for k in kids[p] for x in below(k)]

    out = []
    for p, members in nodes.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(p)))
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in sub if s)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[s] for s in sub), saved, sha(ends)))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def built(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("d1", F.lit(1)).repartition(3)
    turns = trie.ordered(df)
    convs, rebuilt = trie.branched(turns, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
    return sorted((tuple(r[c] for c in TRIE) for r in trie.trie(convs, rebuilt).collect()), key=repr)


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 3)
    monkeypatch.setattr(trie, "PIECE", 4)
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 12), *range(95, 112), 300, 305, -3, -200, -205]:
        for t in range(rng.choice([0, 1, 1, 2, 4, 7, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, "tool"]), rng.choice(["a", "bb", "bb", None, "é€"])))
    rows += [(None, 1, "user", "nobody"), (400, 1, "user", "a"), (400, 1, "user", "a"), (401, None, None, None), (2**40, 0, "u", "x" * 5000)]
    rows += [(c, t, "user", "same") for c in range(1000, 1030) for t in range(8)]  # copies, and ids that end at one node in several pieces
    assert built(spark, rows) == brute_trie(rows)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 16)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(150)] + [(5, t, "user", f"t{t % 3}") for t in range(150, 160)] + [(7, 0, "a", "b")]
    assert built(spark, rows) == brute_trie(rows)


def test_trie_empty(spark):
    assert built(spark, []) == [] == built(spark, [(None, 1, "a", "b")])


def test_turnless_branches(spark):
    """A base that is absent takes the first turns away: conversations without any are members of the root alone."""
    short = [c for c in range(1001, 1100) if crc32(str(c).encode()) % 6 == 5][:3]
    rows = [(c, t, "user", "x") for c in short for t in range(2)]
    got = built(spark, rows)
    assert got == brute_trie(rows) and got == [(short[0], 0, None, 3, 0, 1, 0, sha(",".join(map(str, short))))]


def test_op12(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    assert sorted((tuple(r[c] for c in TRIE) for r in queries.op12_trie(spark, SF).collect()), key=repr) == brute_trie(rows)


# -- hard negatives


def brute_negatives(rows, keep, positives=5, k=10):
    """rows: vec_id, label, vector; keep says which ids are anchors."""
    whole = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[(i, label, tuple(math.floor(256 * x) for x in v))] = None
    whole = list(whole)
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in whole:
        if keep(a[0]):
            best = sorted((-dot(a, b), b[0], b) for b in whole if b[1] == a[1] and b != a)[:positives]
            other = sorted((-dot(a, b), b[0]) for b in whole if b[1] != a[1])
            for s, p, _ in best:
                found = [(i, -n) for n, i in other if -30 * s <= -100 * n <= -90 * s][:k]
                out += [(a[0], p, r, i, -s, n) for r, (i, n) in enumerate(found, 1)]
    return sorted(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, keep, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("x")).repartition(3)
    own = negatives.whole_vectors(df)
    return sorted(tuple(r[c] for c in NEGATIVES) for r in negatives.mine(own, own.where(keep), **sizes).collect())


def vectors(n, dim, rng, spread=0.2):
    middle = rng.normal(size=(6, dim))
    x = middle[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return [[float(np.float32(v)) for v in row] for row in x]


@pytest.mark.parametrize("sizes", [{"block": 16, "leaf": 4, "sample": 90}, {"block": 60, "leaf": 8, "sample": 40}, {}])
def test_negatives_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(4)
    x = vectors(240, 6, rng)
    rows = [(i, int(rng.integers(0, 4)), v) for i, v in enumerate(x)]
    # a vector that many rows share, repeated rows, one id with two vectors, lengths, nulls, what isn't finite
    rows += [(1000 + i, i % 3, x[0]) for i in range(60)] + [rows[3]] * 3 + [(rows[8][0], 1, x[9])]
    rows += [(2000, 1, x[5][:3]), (2001, 2, [*x[5], 1.0]), (2002, 1, [])]
    rows += [(None, 1, x[1]), (3000, None, x[1]), (3001, 1, None), (3002, 1, [1.0, None]), (3003, 1, [float("nan")] * 6), (3004, 1, [float("inf")] * 6)]
    got = mined(spark, rows, "vec_id % 8 = 0", **sizes)
    assert got == brute_negatives(rows, lambda i: i % 8 == 0) and len(got) > 500


def test_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(np.float32(v * 10.0**6)) for v in row]) for i, row in enumerate(vectors(50, 3, rng))]
    assert mined(spark, rows, "vec_id % 5 = 0") == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_nothing(spark):
    assert mined(spark, [], "true") == [] and mined(spark, [(1, 1, [1.0])], "vec_id = 9") == []
    assert mined(spark, [(1, 1, [1.0])], "true") == [] and mined(spark, [(1, 1, [0.0]), (2, 1, [0.0]), (3, 2, [5.0])], "vec_id = 1") == [(1, 2, 1, 3, 0, 0)]


def test_packs_are_not_broadcast(spark):
    """Queries meet blocks in a merge, however small Spark takes the packs for: a broadcast would pass through the driver."""
    rows = [(i, i % 3, v) for i, v in enumerate(vectors(90, 4, np.random.default_rng(9)))]
    own = negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    found = negatives.mine(own, own.where("vec_id % 9 = 0"), block=16, leaf=4, sample=90)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [cell#" in line and "part#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_blocks_are_pruned(spark):
    """Tight clusters: a query visits few leaves, and gets what all of them give."""
    rng = np.random.default_rng(8)
    x = np.floor(256 * np.array(vectors(4000, 16, rng, 0.01))).astype(np.int64)
    norms = negatives._norms(x)
    top = float(norms.max())
    tree, leaves = negatives.grow(negatives._augmented(x, norms, top), 64)
    low, high = negatives.bounds(tree, x[:50], top)
    s = negatives.products(x[:50], x)
    for n, at in enumerate(leaves):
        assert (s[:, at] <= high[:, n, None]).all() and (s[:, at] >= low[:, n, None]).all()
    tenth = np.sort(s, axis=1)[:, -10]
    assert (high >= tenth[:, None]).mean() < 0.4


def test_op13(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows_of("embeddings")]
    got = sorted(tuple(r[c] for c in NEGATIVES) for r in queries.op13_negatives(spark, SF).collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0)
