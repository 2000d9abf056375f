"""The training-data operators on small fixtures with every awkward row, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, components, decontam, fingerprint, html, langid, neardup, quality, quantile, sample, sharding, substr, tokencount
from quillon.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cell int, part int, shard int, fp long, __component string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeioustrlnmé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus():
    """Nulls, empty and long texts, exact and near copies, shared passages, repeated rows and ids, null ids."""
    rng = random.Random(5)
    words = vocabulary(1)
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 12, 13, 14, 40, 200]))) for _ in range(120)]
    passage = " ".join(rng.choices(words, k=60))
    for i in range(0, 60, 3):
        texts[i] += "\n" + passage + " " + rng.choice(words)
    base = " ".join(rng.choices(words, k=300)).split(" ")
    for i in range(30):  # near copies of one text
        w = list(base)
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 10 + ["", " \n\t", "!!! ...", "UPPER Case TEXT here", "x" * 3000, " ".join(rng.choices(words, k=30000)), "tab\tand\x0bform\x0cfeed nbsp one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, None), (None, texts[1]), (None, None), (7, texts[7]), (8, "another text under a known id"), (2**40, texts[2])]
    return rows


ROWS = corpus()


def frame(spark, rows):
    full = [(i, t, random.Random(str(t)).choice(["en", "de", None]), None, len(t or ""), "k", 1, 2, 3, 4, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("limit", [1, 7, 100, 3000])
def test_smallest_hashes(spark, limit):
    keys = spark.range(2000).selectExpr("id AS k", "CAST(id % 7 AS string) AS `a.b`").union(spark.createDataFrame([(None, None)], "k long, s string")).repartition(5)
    want = keys.selectExpr("xxhash64(k, `a.b`) AS h", "k").orderBy("h", "k").limit(limit)
    assert sorted(str(r.k) for r in sample.smallest_hashes(keys, limit).collect()) == sorted(str(r.k) for r in want.collect())
    assert sample.smallest_hashes(keys.limit(0), limit).count() == 0


# -- 1 sharding


def test_sharding_keeps_groups_and_balances(docs, none):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    text = {}
    assert len(rows) == len(ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in ROWS)
    for r in rows:
        assert text.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    largest = max(r.size for r in rows)
    rest = (sum(loads) - largest) / 3
    assert max(loads) == largest and all(abs(x - rest) < 0.05 * rest for x in loads if x != largest)
    assert sharding.shard_by_bytes(none, 4).count() == 0


def test_differencing_two_way_is_the_textbook_one():
    out = sharding.differencing(np.array([8, 7, 6, 5, 4]), 2)
    sums = [sum(x for x, s in zip([8, 7, 6, 5, 4], out) if s == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2  # 14 and 16: the differencing method's own result
    assert len(sharding.differencing(np.zeros(0, np.int64), 3)) == 0


@pytest.mark.parametrize("k,n", [(2, 9), (3, 40), (5, 7), (40, 200), (7, 3), (1, 4)])
def test_differencing_by_brute_force(k, n):
    """The same largest-difference rule on lists of lists: equal shard sums."""
    loads = random.Random(100 * k + n).sample(range(1, 100_000), n)
    parts = [(x, i, [[x]] + [[] for _ in range(k - 1)]) for i, x in enumerate(loads)]  # spread, age, fullest part first
    age = n
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b) = parts.pop(0), parts.pop(0)
        joint = sorted((x + y for x, y in zip(a, reversed(b))), key=lambda x: -sum(x))
        parts.append((sum(joint[0]) - sum(joint[-1]), age, joint))
        age += 1
    out = sharding.differencing(np.array(loads), k)
    assert sorted(np.bincount(out, loads, k).astype(int).tolist()) == sorted(map(sum, parts[0][2]))


@pytest.mark.parametrize("k", [2, 3, 40])
def test_differencing_balances(k):
    loads = np.random.default_rng(k).integers(1, 5000, 3000)
    out = sharding.differencing(loads, k)
    sums = np.bincount(out, loads, k)
    assert sums.max() - sums.min() <= 5 and len(sums) == k


# -- 2 language


def test_language(spark, none):
    rng = random.Random(3)
    words = {"aa": vocabulary(11), "bb": [w.translate(str.maketrans("aeios", "kzxwq")) for w in vocabulary(12)], "цц": ["".join(rng.choice("абвгде") for _ in range(5)) for _ in range(200)]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.choice([3, 30, 300]))), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows] + [(900, None, "aa", None), (901, "123 !!", "aa", ""), (902, "", None, "")], "doc_id long, text string, lang string, __k0 string")
    p = langid.fit(df.where("doc_id % 5 <> 0"))
    assert sorted(p) == sorted(words)
    got = {r.doc_id: r for r in langid.predict(df, p).collect()}
    assert len(got) == len(rows) + 3 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(df, p)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert langid.fit(none) == {} and langid.predict(none, p).count() == 0 and {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}


def test_without_a_labelled_row_all_stay(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "more of them", None), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.keep_known(df, langid.fit(df)).collect()) == [1, 2, 3]


def test_profiles_are_sums_of_bound_vectors():
    text = "Abc  a1b"
    codes, counts = langid.grams(text)
    seq = " abc a b "
    want = Counter(tuple(map(ord, seq[i : i + 3])) for i in range(len(seq) - 2))
    assert {(int(c) >> 42, int(c) >> 21 & 0x1FFFFF, int(c) & 0x1FFFFF): n for c, n in zip(codes, counts.tolist())} == want
    v = sum(n * np.roll(langid._letter_vector(a), 2).astype(int) * np.roll(langid._letter_vector(b), 1) * langid._letter_vector(c) for (a, b, c), n in want.items())
    assert (langid.bundle(codes, counts) == v).all()


def brute_grams(text):
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = " ".join(line.split())
    line = f" {line} " if line else ""
    code = lambda g: sum(ord(c) << k for c, k in zip(g, (42, 21, 0)))
    return Counter(code(line[i : i + 3]) for i in range(len(line) - 2))


@pytest.mark.parametrize("window", [1, 2, 3, 7, 100, 1 << 20])
def test_long_text_in_windows(monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    for text in ["ab cd ef " * 30, "  a1b--c d", "", "...", "x", "éß日本 --- Ω" * 9, " " * 250 + "end", "ab" + "." * 210 + "cd"]:
        u, c = langid.grams(text)
        assert dict(zip(u.tolist(), c.tolist())) == brute_grams(text)


def test_language_by_brute_force(spark):
    rng = random.Random(31)
    words = {"aa": vocabulary(41), "bb": vocabulary(42)}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.choice([1, 9, 50]))), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vector = lambda grams: sum(n * np.prod([np.roll(langid._letter_vector(g >> k & 0x1FFFFF).astype(int), t) for k, t in ((42, 2), (21, 1), (0, 0))], axis=0) for g, n in grams.items())
    bundles = {lang: vector(sum((brute_grams(t) for _, t, x in rows if x == lang), Counter())) for lang in words}
    fitted = langid.fit(df)
    assert all((fitted[lang] == bundles[lang]).all() for lang in words)
    for r in langid.predict(df, fitted).collect():
        v = vector(brute_grams(dict((i, t) for i, t, _ in rows)[r.doc_id]))
        cosines = {lang: b @ v / np.linalg.norm(b) / np.linalg.norm(v) for lang, b in bundles.items()}
        assert cosines[r.lang_pred] == pytest.approx(max(cosines.values())) and r.score == pytest.approx(max(0, cosines[r.lang_pred]))


def test_rejection(spark, none):
    words = vocabulary(51)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words, k=40)), "aa") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "жщю " * 30, None), (103, "жщю", None), (101, None, "aa"), (102, "...", "aa"), (None, "x", "aa")], "doc_id long, text string, lang string")
    p = langid.fit(df)
    least = langid.rejection(df, p)
    got = {r.doc_id: r.score for r in langid.predict(df, p).collect()}
    own = sorted([got[i] for i in range(60)])
    assert least == pytest.approx(0.5 * (own[0] + 0.59 * (own[1] - own[0]))) and got[100] < least
    assert sorted(r.doc_id for r in langid.keep_known(df, p, least=least).where("doc_id IS NOT NULL").collect()) == [*range(60), 103]
    assert langid.rejection(none, p) == 0 and langid.rejection(df.where("lang IS NULL"), p) == 0


def test_rejection_counts_all_rows(spark, monkeypatch):
    """The threshold is that of every labelled row, also where there are more of them than the 4,000 that a sample once held."""
    words = vocabulary(52)
    rng = random.Random(7)
    rows = [(i, " ".join([*rng.choices(words, k=40), *["жщю"] * rng.randrange(9)]), "aa") for i in range(4600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    p = langid.fit(df)
    own = sorted(r.score for r in langid.predict(df, p).collect())
    assert langid.rejection(df, p) == pytest.approx(0.5 * float(np.percentile(own, 1)), abs=1e-12)


def test_percentile(spark):
    rng = np.random.default_rng(12)
    for x in (rng.random(3000), rng.random(50).repeat(40), np.array([0.25]), np.array([0.0, 1.0]), 0.5 + rng.random(500) * 1e-13, rng.integers(0, 3, 300) / 2):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        for share in (0.0, 0.01, 0.37, 1.0):
            want = df.agg(F.percentile("x", F.lit(share))).first()[0]
            assert quantile.percentile(df, share, bins=16) == pytest.approx(want, abs=1e-15) and want == pytest.approx(float(np.percentile(x, 100 * share)), abs=1e-12)
    assert quantile.percentile(df.limit(0), 0.5) is None


# -- 3 fingerprints


def test_fingerprints(spark, docs, none):
    rows = fingerprint.fingerprint_documents(docs).collect()
    order = sorted(((i, t or "") for i, t in ROWS if i is not None), key=lambda r: -r[0])
    assert len(rows) == len(ROWS)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    unique = [i for i, n in Counter(i for i, _ in ROWS).items() if n == 1 and i is not None]
    got = {r.doc_id: r for r in rows}
    for at, (i, t) in enumerate(order):
        if i not in unique or at + 1 == len(order):
            continue
        options = [x for j, x in order if j == order[at + 1][0]]
        cut = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 in {h(t[: len(t) - cut] + x[:cut]) for x in options}
    by_text = defaultdict(set)
    for r in rows:
        if r.doc_id in unique:
            by_text[dict((a, b) for a, b in ROWS)[r.doc_id] or ""].add(r.fp)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {0}
    assert fingerprint.fingerprint_documents(none).count() == 0
    alone = fingerprint.fingerprint_documents(frame(spark, [(3, "abcdef ghi")])).first()
    assert alone.edited_sha256 == h("abcdef " + "abc") and alone.near_next == 1.0


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("hot", [None, 7])
def test_an_id_that_many_rows_have_is_split(spark, hot, bounded, monkeypatch):
    if bounded:  # fewer parts than splits, bounds from a third of the rows
        monkeypatch.setattr(fingerprint, "MAX_PARTS", 3)
        monkeypatch.setattr(fingerprint, "MARK_ROWS", 120)
    rows = [(hot, f"{i:04d} {'abc ' * 6}") for i in range(300)] + [(1000 + i, f"{300 + i:04d} {'abc ' * 6}") for i in range(60)] + [(i - 60, f"{360 + i:04d} {'abc ' * 6}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lined = fingerprint._followed(df, "doc_id", "text").where("ghost = 0").collect()
    after = {r.text: r.next_text for r in lined}
    ids = {t: i for i, t in rows}
    assert len(after) == len(rows) and set(after.values()) == set(ids)
    at = max((i, t) for i, t in rows if i is not None)[1]
    seen = []
    for _ in rows:
        seen.append(ids[at])
        at = after[at]
    assert len(set(after)) == 380 and at == max((i, t) for i, t in rows if i is not None)[1]
    known = [i for i in seen if i is not None]
    assert known == sorted(known, reverse=True) and (hot is not None or seen[-300:] == [None] * 300)
    sizes = Counter(r.part for r in lined)
    assert max(sizes.values()) < 200


def test_simhash_votes(spark):
    text = "the The quick brown brown fox a"
    words = Counter(text.lower().split())
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    total = sum(n * max(1, len(w) - 2) for w, n in words.items())
    votes = [sum(n * max(1, len(w) - 2) for w, n in words.items() if hashed[w] >> b & 1) for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * votes[b] > total)
    got = fingerprint.simhash(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").first().fp
    assert got & (2**64 - 1) == want


def test_block_tables_find_all_within_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(64), k)) for b, k in product(base, range(6))]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp long")
    for radius in (0, 3):
        want = {(a, b) for a in set(signed[:20]) for b in set(signed) if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        found = fingerprint.within_radius(df.limit(20), df, radius)
        pairs = [(r.query_fp, r.fp) for r in fingerprint.within_radius(spark.createDataFrame([(v,) for v in signed[:20]], "fp long"), df, radius).collect()]
        assert set(pairs) == want and len(pairs) == len(want) and found.count() > 0


def test_near_counts(spark, docs):
    rows = fingerprint.fingerprint_documents(docs).select("doc_id", "fp").collect()
    table = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, fp long")
    got = Counter(tuple(r) for r in fingerprint.near_counts(table, 3, 10).select("doc_id", "fp", "near_docs").collect())
    near = lambda a: sum(bin((a ^ r.fp) & (2**64 - 1)).count("1") <= 3 for r in rows) - 1
    assert got == Counter((r.doc_id, r.fp, near(r.fp) if r.doc_id is not None and r.doc_id % 10 == 0 else None) for r in rows)


# -- 5 near duplicates


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        v = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += v >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_near_components(docs, none):
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in neardup.near_components(docs).collect())
    fps = [brute_fp(t) for _, t in ROWS]
    root = roots(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = defaultdict(list)
    for (i, _), r in zip(ROWS, root):
        if i is not None:
            least[r].append(i)
    want = Counter((i, fp, min(least[r]) if least[r] else None) for (i, _), fp, r in zip(ROWS, fps, root))
    assert got == want and neardup.near_components(none).count() == 0
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(min(least[r]) if least[r] else None for r in set(root))


@pytest.mark.parametrize("extra", range(8))
def test_long_buckets_are_compared_in_blocks(spark, monkeypatch, extra):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SHORT", 3)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})[extra:]
    arr = np.array(fps, np.uint64)
    rows = np.array([(x, 0, f) for x, f in zip([5] * len(fps), arr.view(np.int64).tolist())])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1].astype(np.int32)), pa.array(p[:, 2])], ["bucket", "role", "fp"]) for p in np.array_split(rows, 9)]
    out = [r for b in neardup._verify(iter(batches)) for r in b.to_pylist()]
    blocks = [np.frombuffer(r["payload"], np.uint64) for r in out if r["payload"]]
    assert len(blocks) > 10 and sum(map(len, blocks)) == len(fps) and not [r for r in out if r["payload"] is None]
    place = {f: i for i, f in enumerate(fps)}
    found = []
    for i in range(len(blocks)):
        for j in range(i + 1):
            a, b = neardup.spanning(np.concatenate([blocks[i], blocks[j]]))
            found += [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    assert set(found) <= {tuple(p) for p in want} | {(b, a) for a, b in want}
    assert roots(len(fps), found) == roots(len(fps), want)


@pytest.mark.parametrize("segment", [0, 1, 2])
def test_long_buckets_are_dealt_anew(monkeypatch, segment):
    import pyarrow as pa

    rng = random.Random(segment)
    lo, width = neardup.SEGMENTS[segment]
    mask = ((1 << width) - 1) << lo
    centre = rng.getrandbits(64)
    flip = lambda x, k, bits: x ^ sum(1 << b for b in rng.sample(bits, k))
    free = [b for b in range(64) if not mask >> b & 1]
    fps = {flip(centre, rng.randint(0, 12), free) for _ in range(300)}
    fps = np.array(sorted(fps | {flip(x, rng.randint(1, 4), free) for x in list(fps)[:200]}), np.uint64)
    bucket = segment << 60 | (centre >> lo & ((1 << width) - 1))

    def sorted_rows(batches):
        rows = sorted({(r["bucket"], r["role"], r["fp"]) for b in batches for r in b.to_pylist()})
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["bucket", "role", "fp"])

    payload = [pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([p.tobytes()], pa.binary())], ["bucket", "payload"]) for p in np.array_split(fps, 5)]
    out = [r for b in neardup._verify(iter([sorted_rows(neardup._finer(iter(payload)))])) for r in b.to_pylist()]
    assert not [r for r in out if r["payload"]]
    place = {int(f): i for i, f in enumerate(fps)}
    found = [(place[r["a"] % 2**64], place[r["b"] % 2**64]) for r in out]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 4]
    assert len(want) > 100 and roots(len(fps), found) == roots(len(fps), want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = roots(300, [(a, b) for a, b in edges if a is not None])
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 4 extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies for all of you today</div><div id=sidebar>Side words here</div>
<article><h1>Big &amp; bold</h1><p>First   <b>para</b>graph&nbsp;here<br>and more.<p>Second with <a href="x">a link</a>, fine.</p><div class="ad">Buy now</div><table><tr><td>one</td><td>two</td></tr></table>
<form><label>Mail</label></form><section class="reader-comments"><p>I disagree with all of this text at length</p></section></article><aside>Related words</aside><footer>&copy; foot</footer></body></html>"""
WANT = "Big & bold First paragraph here and more. Second with a link, fine. one two"


def test_extraction(spark):
    more = [(i, "u", f"<html><body><nav><a>m {i}</a></nav><article><h1>h{i}</h1><p>{'word ' * 30}</p></article><footer>f</footer></body></html>") for i in range(30)]
    odd = [(100, "u", PAGE), (101, None, None), (102, "u", ""), (103, "u", "plain text &lt;b&gt; only"), (104, "u", "<div class='ad'>unclosed advert<article><p>the words of the article itself"), (105, "u", "<p>a < b and c > d</p>"), (100, "u", PAGE), (106, "u", "<nav>only menu</nav>")]
    df = spark.createDataFrame([(*r, "x") for r in more + odd], "page_id long, url string, html string, text string")
    w = html.fit(df)
    assert w[">a"] < -2 < w["p"] and w[".ad"] < 0 < w[".post"]
    got = [(r.page_id, r.text) for r in html.extract(df, w).collect()]
    text = dict(got)
    assert text[100] == WANT and len(got) == len(more) + len(odd) and text[101] == text[102] == text[106] == "" and text[103] == "plain text <b> only"
    assert text[104] == "the words of the article itself" and text[7] == "h7 " + "word " * 29 + "word" and text[105] == "a < b and c > d"
    empty = spark.createDataFrame([], df.schema)
    assert html.fit(empty) == html.learn({}) and html.extract(empty, {}).count() == 0
    assert html.Page(PAGE).best(html.learn({})) == WANT


def test_names_are_learned_not_listed():
    prior = html.learn({})
    words = " ".join(f"w{i}" for i in range(50))
    assert html.Page(f'<div class="post search-guide"><p>{words}</p></div><div class="x">tail</div>').best(prior).startswith(words)
    assert html.Page(f'<div class="search-layout"><h1>Title</h1><p>{words}</p><div class="search-box">find</div></div>').best(prior) == f"Title {words}"
    assert html.Page(f'<article><p>{words}</p><div class="zonk">buy it</div><p>end</p></article>').best(prior) == f"{words} buy it end"
    taught = html.learn({"": (1000, 1000), ".zonk": (0, 300), "p": (900, 0)})
    assert html.Page(f'<article><p>{words}</p><div class="zonk">buy it</div><p>end</p></article>').best(taught) == f"{words} end"
    held = html.learn({"": (1000, 1000), ".widget": (5000, 0)})  # pages whose articles are widgets
    assert html.Page(f'<div class="widget"><p>{words}</p></div>').best(held) == words and html.Page(f'<div class="widget"><p>{words}</p></div>').best(prior) == ""
    comments = "".join(f"<article class=comment><p>I think {i} times</p></article>" for i in range(99))
    assert html.Page(f'<main><h1>T</h1><p>{words}</p></main><section id="comments">{comments}</section>').best(prior) == f"T {words}"


@pytest.mark.parametrize("name, kept", [
    ("search-guide", True), ("comment-thread-analysis", True), ("shareHistory", True), ("related-literature", True), ("search-box", False), ("reader-comments", False), ("main-nav", False), ("article-related-posts", False),
    ("ad-leaderboard", False), ("cookie-pledge", False), ("comments", False), ("notice", False), ("analysis", True), ("content-sidebar", False), ("site-footer-links", False), ("share-xy", False),
])
def test_compound_names(name, kept):
    """A name with a word of its own leaves nothing out, alone on a page or inside the article; beside a plain one it does."""
    prior = html.learn({})
    words, tail = " ".join(f"w{i}" for i in range(50)), "these are the last words of it"
    part = f'<div class="{name}"><p>{tail}</p></div>'
    assert html.Page(f"<main><h1>T</h1><p>{words}</p>{part}</main>").best(prior) == f"T {words}" + f" {tail}" * kept
    assert html.Page(f"<body>{part}</body>").best(prior) == tail * kept
    assert html.Page(f'<main><p>{words}</p><div class="{name} comments"><p>{tail}</p></div></main>').best(prior) == words
    taught = html.learn({"": (1000, 1000), **{f".{w}": (0, 500) for w in ("guide", "analysis", "history", "literature")}})  # labelled pages have them beyond
    assert html.Page(f"<main><p>{words}</p>{part}</main>").best(taught) == words


LAYOUTS = (
    '<header><h1>Site</h1></header><ul class="menu"><li><a href=1>{n}</a></li></ul><div id="content" class="main"><h1>{h}</h1><p>{a}</p><div class="advert">{n}</div><p>{b}</p></div><div class="sidebar">{n}</div><footer>{n}</footer>',
    '<div class="navbar"><a>{n}</a></div><article class="entry"><h1>{h}</h1><p>{a}<p>{b}</article><section class="comments"><p>{n}</p><p>{n}</p></section><div id=footer>{n}</div>',
    '<table><tr><td class="toolbar">{n}</td><td><h1>{h}</h1><p>{a}</p><form><label>{n}</label></form><p>{b}</p></td></tr></table><ul><li><a>{n}</a></li><li><a>{n}</a></li></ul>',
    '<main><h1>{h}</h1><section><p>{a}</p></section><aside>{n}</aside><section><p>{b}</p></section></main><div class="related-posts"><a>{n}</a></div>',
)


def test_held_out_pages():
    """Words kept and words wanted over pages in layouts of which one alone was labelled."""
    rng, words = random.Random(12), vocabulary(3)
    text = lambda n: " ".join(rng.choices(words, k=n))
    counts: Counter = Counter()
    seen = {}
    for i in range(200):
        page = LAYOUTS[1].format(n=text(8), h=text(4), a=text(40), b=text(60))
        for f, x, y in html.tally(html.Page(f"<body>{page}</body>")):
            seen[f] = tuple(np.add(seen.get(f, (0, 0)), (x, y)))
    weights = html.learn(seen)
    for i in range(200):
        part = dict(n=text(rng.randint(3, 15)), h=text(5), a=text(rng.randint(10, 80)), b=text(rng.randint(10, 80)))
        got = Counter(html.Page(f"<html><body>{LAYOUTS[i % 4].format(**part)}</body></html>").best(weights).split())
        want = Counter(f"{part['h']} {part['a']} {part['b']}".split())
        counts.update(hit=sum((got & want).values()), got=sum(got.values()), want=sum(want.values()))
    assert counts["hit"] / counts["got"] > 0.97 and counts["hit"] / counts["want"] > 0.99


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, '<a ">"' * 170_000, "<div>" * 60_000 + "</p>" * 60_000 + "x", "<" * 1_000_000, "<!--" * 250_000, "<p class='" * 100_000, "<div class=ad>" * 70_000 + "</b>" * 10_000, "<a href='x>" * 90_000 + "'>end", '<x "' * 100_000 + ">", "<h1>" * 9000 + "</div>" * 9000,
     "<p " + "class " * 150_000 + ">x", "<nav><article>" * 20_000],
)
def test_malformed_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.Page(page).best(html.learn({}))
    assert time.process_time() - began < 4


def test_best_region_is_the_maximum():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([1, 2, 3, -0.5, -2, -5]) for _ in range(rng.randint(0, 12))]
        every = [(a, b) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)]
        a, b = html.region(scores)
        assert sum(scores[a:b]) == max(sum(scores[x:y]) for x, y in every)


# -- 6 and 8 tokens

ALPHABET = list("abcdefgh ABC  12 \n\n\t'stré日ñ🎉\x85\xa0 \x1c!?.,-_") + ["'s", "'ll", " the", "ing", "<|endoftext|>", "  "]


def odd_texts():
    rng = random.Random(6)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(1500)] + ["a" * 4000, " " * 500, "ab" * 2000, "\n" * 99 + "x", "", "word " * 3000] + [t for _, t in ROWS if t is not None and len(t) < 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, library, none, monkeypatch):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in tokencount.count_tokens(df, tokenizer_file()).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(x) for x in library(texts)] and (got[None].n_tokens, got[None].n_bytes) == (0, 0)
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]
    assert tokencount.count_tokens(none, tokenizer_file()).count() == 0
    counter = tokencount.Counter(tokenizer_file())
    assert counter.split
    monkeypatch.setattr(tokencount, "SPAN", 40)
    monkeypatch.setattr(tokencount, "CALL", 100)
    assert counter.counts(texts, [len(t.encode()) for t in texts]) == [len(x) for x in library(texts)]
    for text in texts[:300] + texts[-40:]:
        parts = list(tokencount.spans(text, 7))
        assert "".join(parts) == text and sum(map(len, library(parts))) == len(library([text])[0])


def test_counts_under_other_files(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t for t in odd_texts() if "\x00" not in t] + ["lower CASE words  here " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    words = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    words.no_truncation()
    for name, want in (("piece_bpe_32k.model", [len(x) for x in model.encode(texts)]), ("word_bpe_49k.json", [len(e) for e in words.encode_batch(texts, add_special_tokens=False)])):
        got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, tokenizer_file(name)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_encoder_equals_the_library_and_round_trips(spark, library, none):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, ids int")
    ids = bpe.encode_documents(df, tokenizer_file())
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert [got[i] for i in range(len(texts))] == library(texts) and got[None] == []
    back = {r.doc_id: r.text for r in bpe.decode_documents(ids, tokenizer_file()).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    dig = {r.doc_id: r for r in bpe.digests(df, tokenizer_file()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert all((dig[i].n_tokens, dig[i].ids_sha256, dig[i].decoded_sha256) == (len(got[i]), sha(",".join(map(str, got[i]))), sha(t)) for i, t in enumerate(texts))
    assert bpe.digests(none, tokenizer_file()).count() == 0
    half = bpe.decode_documents(spark.createDataFrame([(1, library(["é🎉"])[0][:-1]), (2, None)], "doc_id int, ids array<int>"), tokenizer_file()).collect()
    assert half[0].text.endswith("�") and half[1].text == ""


# -- 7 decontamination


def lower_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items):
    windows = defaultdict(set)
    for name, text in items:
        w = lower_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(name) if name is not None else "")
    out = []
    for i, t in rows:
        w = lower_words(t)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                k = tuple(w[a : a + n])
                if k in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[k]
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return Counter(out)


@pytest.mark.parametrize("pass_bytes", [1 << 21, 300])
def test_decontamination(spark, docs, none, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 5000)
    text = dict((i, t) for i, t in ROWS if i is not None)
    items = [(1, " ".join(text[0].split()[-40:]).upper()), (2, text[3]), (10, "Case text"), (11, None), (12, ""), (13, "absent " * 12), (None, text[4]), (1, text[9]), (14, "x" * 3000), (15, "éé one")]
    tests = spark.createDataFrame([(a, b, "c") for a, b in items], "item_id long, text string, doc_id string")
    rows = decontam.find(docs, tests).select("doc_id", "n_words", decontam.hit_words().alias("n"), "items").collect()
    assert Counter((r.doc_id, r.n_words, r.n, tuple(r.items)) for r in rows) == brute_hits(ROWS, items)
    clean = decontam.drop_contaminated(docs, tests)
    want = Counter(i for (i, _, n, _), c in brute_hits(ROWS, items).items() for _ in range(c) if n == 0)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == want
    assert decontam.find(none, tests).count() == 0 and decontam.find(docs, tests.limit(0)).where(F.size("items") > 0).count() == 0


def test_one_index_serves_every_benchmark(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BYTES", 4000)
    text = dict((i, t) for i, t in ROWS if i is not None)
    index = decontam.build_index(docs)
    monkeypatch.setattr(decontam, "build_index", None)  # is not built again
    for items in ([(1, text[9]), (2, text[40])], [(3, " ".join(text[i] for i in range(60))), (4, text[126])]):
        tests = spark.createDataFrame(items, "item_id long, text string")
        rows = decontam.find(docs, tests, index=index).select("doc_id", "n_words", decontam.hit_words().alias("n"), "items").collect()
        assert Counter((r.doc_id, r.n_words, r.n, tuple(r.items)) for r in rows) == brute_hits(ROWS, items)


def test_clashing_names_and_ids_of_any_type(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [("a", passage, 1, 2, 3, 4), (None, f"x {passage}", 1, 2, 3, 4), ("b", "clean", 1, 2, 3, 4), (None, None, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, bad_doc int, bad_key int, __doc int, __key int")
    out = decontam.drop_contaminated(df, spark.createDataFrame([(1, passage)], "item_id int, text string"))
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.where("text IS NULL OR text = 'clean'").collect()))


@pytest.mark.parametrize("tries,slop", [(1, 0), (50, 0), (1 << 20, 0), (40, 2)])
def test_matches_in_small_lots(monkeypatch, tries, slop):
    monkeypatch.setattr(decontam, "TRIES", tries)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(40)]
    items = [(str(i), " ".join(rng.choices("abcd", k=rng.choice([1, 3, 10, 14]))).encode()) for i in range(30)] + [("z", b"")]
    windows = decontam.Windows(items)
    row = decontam._block([*range(40)], decontam.pa.int64(), [0] * 40, [t.encode() for t in texts]).to_pylist()[0]
    block = decontam.Block(row, windows)
    which, where = decontam.matches(block, windows, slop)
    want = set()
    for d, t in enumerate(texts):
        w = t.encode().split()
        names = {v: k for k, v in windows.terms.items()}
        for k, r in enumerate(windows.matrix.tolist()):
            own = [names[x] for x in r if x >= 0]
            for a in range(-slop, len(w) + slop):
                if all(any(0 <= a + j + s < len(w) and w[a + j + s] == x for s in range(-slop, slop + 1)) for j, x in enumerate(own)):
                    want.add((k, int(block.base[d]) + a))
    assert len(which) == len(set(zip(which.tolist(), where.tolist()))) and set(zip(which.tolist(), where.tolist())) == want


def test_long_items_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PASS_BYTES", 500)
    rng = random.Random(7)
    long = " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(9000))
    own = long.split()
    df = spark.createDataFrame([(i, " ".join(own[a : a + 10])) for i, a in enumerate([0, 4090, 4095, 4096, 4100, 8191, 8192, 8990])] + [(99, " ".join(own[5:14]))], "doc_id long, text string")
    tests = spark.createDataFrame([(1, long)], "item_id long, text string")
    monkeypatch.setattr(decontam, "PASS_BYTES", 40_000)
    assert sorted(r.doc_id for r in decontam.find(df, tests).where(F.size("items") > 0).collect()) == [*range(8)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "one two extra three four"), (2, "one two three four"), (3, "four three two one"), (4, "one x y z two three four")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    near = lambda s: sorted(r.doc_id for r in decontam.find(df, tests, s).where(F.size("items") > 0).collect())
    assert near(0) == [2] and near(1) == [1, 2] and 4 in near(3)
    with pytest.raises(ValueError):
        decontam.find(df, tests, 99)


def test_proximity_does_not_depend_on_the_block(spark):
    rng = random.Random(4)
    item, slop = ["t0", "t1", "t2", "t3"], 2
    rows = [(i, " ".join(rng.choices([*item, "x", "y"], k=rng.choice([4, 5, 6, 9])))) for i in range(150)] + [(150, "t3 t0 t1 t2"), (151, "t0 t1 t2 " * 40)]
    places = {i: [[k for k, w in enumerate(t.split()) if w == x] for x in item] for i, t in rows}
    starts = {i: [a for a in range(-4, 130) if all(any(abs(p - a - j) <= slop for p in own) for j, own in enumerate(at))] for i, at in places.items()}
    words = {i: {k for a in s for k in range(a - slop, a + 4 + slop) if 0 <= k < len(dict(rows)[i].split())} for i, s in starts.items()}
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dealt in (df.coalesce(1), df.repartition(7)):
        got = {r.doc_id: (len(r["items"]), r.n) for r in decontam.find(dealt, tests, slop).select("doc_id", "items", decontam.hit_words().alias("n")).collect()}
        assert got == {i: (int(bool(s)), len(words[i])) for i, s in starts.items()}


# -- 9 substrings


def brute_kept(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - 12):
                k = tuple(w[a : a + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - 12):
                if first[tuple(w[a : a + 13])] < i:
                    gone |= set(range(a, a + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substrings(spark, docs, none):
    got = Counter(tuple(r) for r in substr.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_kept(ROWS)
    assert substr.dedup_substrings(none).count() == 0
    out = substr.rewrite(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    for r in out.collect():
        assert r.n_chars == (len(r.text) if r.text is not None else None) and (r.key, r.cell, r.fp) == ("k", 1, 4)
    assert Counter((i, hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()) for i, t in ((r.doc_id, r.text) for r in out.collect())) == Counter((i, h) for (i, _, _, h), c in brute_kept(ROWS).items() for _ in range(c))


@pytest.mark.parametrize("bits", [8, 1])
def test_hashes_only_propose(spark, docs, bits):
    short = [(i, t) for i, t in ROWS if len(t or "") < 20000]
    got = substr.dedup_substrings(frame(spark, short), hash_bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_kept(short)


def test_factors_are_text_of_earlier_documents(spark, docs):
    words = {i: (t or "").split() for i, t in ROWS if i is not None and i not in (7, 8)}  # ids that occur once
    ids = [i for i, _ in ROWS]
    rows = [r for r in substr.factors(docs).collect() if r.doc_id in words and r.source_id in words]
    assert len(rows) > 50 and max(r.n_words for r in rows) > 100
    for r in rows:
        own, ref = words[r.doc_id], words[r.source_id]
        assert r.source_id < r.doc_id and r.n_words >= 13 and ids.count(r.doc_id) == 1
        assert own[r.start : r.start + r.n_words] == ref[r.source_start : r.source_start + r.n_words]


def test_word_hashes_depend_on_bytes_alone():
    raw = np.frombuffer(b"ab cd ab  abab\tcd" + b"z" * 50 + b" cd", np.uint8)
    text, start, end, row = substr.joined_words(raw, np.array([0, 3, len(raw)]))
    assert text.tobytes() == b" ".join(raw.tobytes().split()) + b" " and row.tolist() == [0] + [1] * (len(start) - 1)
    h = substr.word_hashes(text, start, end)
    words = [text[a:b].tobytes() for a, b in zip(start, end)]
    assert words == raw.tobytes().split() and len(set(h.tolist())) == len(set(words))
    assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words))


def test_windows_do_not_cross_documents(spark):
    w = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(w)), (2, "w12"), (3, " ".join([*w, "w12"])), (4, " ".join([*w, "w12"]))]
    got = {r.doc_id: r.n_removed for r in substr.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 13}


def test_windows_around_a_common_line_are_told_apart(spark):
    rng = random.Random(9)
    line = " ".join(f"f{k}" for k in range(8))  # its runs of four words are common anchors
    noise = lambda: " ".join(str(rng.getrandbits(60)) for _ in range(12))
    rows = [(i, f"{noise()} {line} {noise()}") for i in range(6000)]
    rows += [(10000 + i, f"{line} {line} {line} {'tail' if i % 2 else 'end'} {i}") for i in range(50)]  # windows of nothing but common anchors
    rows = [(i, t) for i, t in rows]
    got = substr.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_kept(rows)
    assert got.where("doc_id < 10000 AND n_removed > 0").count() == 0


# -- 10 quality


def test_quality(spark, none):
    rng = random.Random(1)
    words = vocabulary(21)
    good = lambda: " ".join(rng.choices(words, k=60))
    bad = lambda: " ".join(w + "***" for w in rng.choices(words, k=60)) if rng.random() < 0.5 else " ".join(rng.choices(words, k=60)).upper()
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, ""), (901, "", ""), (1, rows[1][1], "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows if i % 5] + [(None, 1, None), (77, None, None), (1, 1, 1)], "doc_id long, quality int, text int")
    net = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, net).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and {900, 901} <= set(got)
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95
    assert {r.doc_id: r.score for r in quality.score(df.repartition(7), quality.fit(df.repartition(3), labels)).collect()} == pytest.approx(got, abs=1e-9)
    flat = quality.fit(none.select("doc_id", "text"), labels.limit(0))
    assert {round(r.score, 9) for r in quality.score(df, flat).collect()} == {0.5} and quality.score(none, net).count() == 0


def test_quality_features_by_brute_force(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(vocabulary(61, 30) + ["ABC", "!!", "x1"], k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(30)]
    places, signs = quality.index_vectors()
    own = np.zeros((quality.SLOTS, quality.DIMS))
    for s in range(quality.SLOTS):
        own[s, places[s]] = signs[s]
    sums = np.zeros_like(own)
    seqs = [quality.slots(t).tolist() for t in texts]
    for seq in seqs:
        for i, a in enumerate(seq):
            for j in range(max(0, i - 2), min(len(seq), i + 3)):
                if j != i:
                    sums[a] += own[seq[j]]
    assert (quality.context_sums([quality.slots(t) for t in texts]) == sums).all()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    net = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int"))
    vectors = np.where(np.abs(sums).sum(1, keepdims=True) > 0, sums, own)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(net.vectors, vectors, atol=1e-6)
    for seq in seqs:
        got = quality.pool(np.array(seq, np.int32), net.vectors)
        if not seq:
            assert not got.any()
            continue
        rows = vectors[seq]
        alike = [sum(float(rows[i] @ rows[i + k]) for i in range(len(seq) - k)) / len(seq) for k in (1, 2)]
        want = np.concatenate([rows.mean(0), rows.std(0), [np.linalg.norm(rows.mean(0))], alike, [np.log1p(len(seq))]])
        assert np.allclose(got, want, atol=1e-3)
    raw = np.array([quality.pool(np.array(s, np.int32), net.vectors) for s in seqs])
    hidden = np.tanh((raw - net.shift) / net.scale @ net.first + net.first_bias)
    want = 1 / (1 + np.exp(-(hidden @ net.second + net.second_bias) / net.temperature))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert np.allclose([got[i] for i in range(30)], want)


def test_temperature_has_the_least_loss_on_the_held_out_fifth():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(np.int64)
    net = quality.train(x, y, np.zeros((1, 1)), epochs=20)
    held = np.random.default_rng(quality.SEED)
    held.normal(0, 1 / np.sqrt(quality.FEATURES), (quality.FEATURES, quality.HIDDEN))
    fifth = held.permutation(200)[:40]
    p = lambda t: 1 / (1 + np.exp(-net.logits(x[fifth]) / t))
    loss = lambda t: -np.mean(np.log(np.where(y[fifth] == 1, p(t), 1 - p(t))))
    assert loss(net.temperature) == pytest.approx(min(loss(t) for t in np.geomspace(0.25, 16, 49)))
