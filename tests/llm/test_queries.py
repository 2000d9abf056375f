"""The registered opN_ queries on the smallest tables: columns, types, folds, laws, thresholds, digests; and every row by brute force where there is one."""

import hashlib
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import brute_fp, brute_grams, brute_hits, brute_kept, roots

from quillon.llm import langid, quality, queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_shard": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op2_language": "doc_id long, held_out boolean, lang_pred string, score double",
    "op3_fingerprint": "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_extract": "page_id long, url string, text string, n_chars long",
    "op5_neardup": "doc_id long, fingerprint string, component_id long",
    "op6_tokens": "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    "op7_decontaminate": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op8_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op9_substrings": "doc_id long, n_words long, n_removed long, kept_sha256 string",
    "op10_quality": "doc_id long, held_out boolean, score double, predicted int",
}


def table(name, folder=SF):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


DOCS = {r["doc_id"]: r for r in table("documents")}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
fold = lambda i: crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def get(name):
        if name not in held:
            df = queries.queries()[name](spark, SF)
            held[name] = (df.schema, df.collect())
        return held[name]

    return get


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, results, name):
    schema, rows = results(name)
    want = {f.name: f.dataType for f in spark.createDataFrame([], COLUMNS[name]).schema}
    assert {f.name: f.dataType for f in schema if f.name in want} == want
    key = "page_id" if name == "op4_extract" else "doc_id"
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in table("pages" if key == "page_id" else "documents"))


def test_op1(results):
    rows = results("op1_shard")[1]
    for r in rows:
        raw = (DOCS[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, crc32(raw), "bytes", None) and 0 <= r.shard < 40
    for s in range(40):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    group = {}
    assert all(group.setdefault(DOCS[r.doc_id]["text"], r.shard) == r.shard for r in rows)
    # the groups of equal texts, differenced as such: cells hold one each here
    loads = Counter()
    for r in rows:
        loads[DOCS[r.doc_id]["text"]] += r.size
    whole = np.array(sorted(loads.values()))
    want = np.bincount(sharding.differencing(whole, 40), whole, 40)
    got = np.bincount([r.shard for r in rows], [r.size for r in rows], 40)
    assert got.max() - got.min() <= max(want.max() - want.min(), whole.max()) * 1.05 + 1


def test_op2(results):
    """Every row by brute force: prototypes of the training folds, cosines, the largest."""
    kept = {i: brute_grams(r["text"] or "") for i, r in DOCS.items()}
    total = {}
    for i, r in DOCS.items():
        if not fold(i) and r["lang"] is not None and r["text"] is not None:
            total.setdefault(r["lang"], Counter()).update(kept[i])
    codes = sorted({g for c in kept.values() for g in c})
    at = {g: k for k, g in enumerate(codes)}
    vectors = langid._gram_vectors(np.array(codes, np.uint64)).astype(np.float64)
    bundle = lambda c: np.array(list(c.values()), np.float64) @ vectors[[at[g] for g in c]]
    names = sorted(total)
    matrix = np.stack([bundle(total[n]) for n in names])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    for r in results("op2_language")[1]:
        assert r.held_out == fold(r.doc_id)
        if not kept[r.doc_id]:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = bundle(kept[r.doc_id])
        cosines = matrix @ v / np.linalg.norm(v)
        assert r.lang_pred == names[int(np.argmax(cosines))] and r.score == pytest.approx(min(1, max(0, cosines.max())))


def brute_simhash(text):
    import xxhash

    votes = np.zeros(64)
    for w in text.lower().split():
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        weight = max(1, len(w) - 2)
        votes += weight * np.array([1 if h >> b & 1 else -1 for b in range(64)])
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_op3(results):
    rows = {r.doc_id: r for r in results("op3_fingerprint")[1]}
    order = sorted(DOCS, reverse=True)
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    for i, after in zip(order, order[1:] + order[:1]):
        text, other, r = DOCS[i]["text"] or "", DOCS[after]["text"] or "", rows[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (brute_simhash(text), brute_simhash(edited))
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, rows[after].fingerprint)
        near = sum(bin(int(x.fingerprint, 16) ^ int(r.fingerprint, 16)).count("1") <= 3 for x in rows.values()) - 1
        assert r.near_docs == (near if i % 50 == 0 else None)


def test_op4(results):
    """Every page: what its marked article says, written down by a parser of its own."""
    from html.parser import HTMLParser

    class Marked(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.parts.append(" " if tag not in ("b", "i", "a") else "")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.parts.append(" " if tag not in ("b", "i", "a") else "")

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    pages = {r["page_id"]: r for r in table("pages")}
    for r in results("op4_extract")[1]:
        parser = Marked()
        parser.feed(pages[r.page_id]["html"] or "")
        parser.close()
        assert (r.text, r.n_chars, r.url) == (" ".join("".join(parser.parts).split()), len(r.text), pages[r.page_id]["url"])


def test_op5(results):
    rows = {r.doc_id: r for r in results("op5_neardup")[1]}
    ids = sorted(rows)
    fps = [brute_fp(DOCS[i]["text"]) for i in ids]
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    least = {}
    for i, x in zip(ids, root):
        least.setdefault(x, i)
    assert all((rows[i].fingerprint, rows[i].component_id) == (f"{f:016x}", least[x]) for i, f, x in zip(ids, fps, root))


def test_op6_and_op8(results):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    t.no_truncation()
    counts, coded = ({r.doc_id: r for r in results(n)[1]} for n in ("op6_tokens", "op8_bpe"))
    for i, d in DOCS.items():
        text = d["text"] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 512)
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert coded[i].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_op7(results):
    want = brute_hits([(i, d["text"]) for i, d in DOCS.items()], [(r["item_id"], r["text"]) for r in table("benchmark")])
    rows = results("op7_decontaminate")[1]
    named = Counter({(i, n, hit, len(items), sha(",".join(items)), hit > 0): c for (i, n, hit, items), c in want.items()})
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == named


def test_op9(results):
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in results("op9_substrings")[1]) == brute_kept([(i, d["text"]) for i, d in DOCS.items()])


def test_op10(spark, results):
    rows = {r.doc_id: r for r in results("op10_quality")[1]}
    known = {r["doc_id"]: r["quality"] for r in table("labels")}
    assert all(r.held_out == fold(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    docs = spark.createDataFrame([(i, d["text"]) for i, d in DOCS.items()], "doc_id long, text string")
    net = quality.fit(docs, spark.createDataFrame([(i, y) for i, y in known.items() if not fold(i)], "doc_id long, quality int"))
    for i, d in DOCS.items():
        own = net.score(quality.pool(quality.slots(d["text"] or ""), net.vectors)[None])[0]
        assert rows[i].score == pytest.approx(own, abs=1e-9)


def test_labels_ids_and_sources_are_no_inputs(spark, tmp_path):
    """Predictions stay as they are when lang, source, ids' order and held-out labels change."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 'zz' ELSE lang END AS lang", "'s' AS source", "0L AS n_chars")
    changed.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_language", "op10_quality"):
        a, b = ({r.doc_id: r.score for r in queries.queries()[name](spark, d).collect()} for d in (SF, str(tmp_path)))
        assert a == pytest.approx(b, abs=1e-9)
