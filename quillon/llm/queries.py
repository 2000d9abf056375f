"""The thin registered queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, fingerprint, html, langid, minhash, neardup, negatives, quality, sharding, substr, tokencount, trie
from quillon.llm.store import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by the law ``bytes``: equal texts together, bytes near equal."""
    rows = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds 1 to 4 of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.where(F.coalesce(~_held_out(), F.lit(False))))
    found = langid.predict(docs, prototypes)
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and of its edited text, with likenesses; near_docs for every fiftieth id."""
    rows = materialize(fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents")), "fingerprints")
    return fingerprint.near_counts(rows).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.to_hex(F.col("fp")).alias("fingerprint"),
        fingerprint.to_hex(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "near_docs",
    )


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate class of every document."""
    rows = neardup.near_components(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", fingerprint.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    rows = tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file())
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document: words under a window, items with a window."""
    rows = decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = decontam.hit_words()
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under a window that an earlier document has."""
    return substr.dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels in the folds 1 to 4."""
    docs = _table(spark, sf_dir, "documents")
    known = _table(spark, sf_dir, "labels").where(F.coalesce(~_held_out(), F.lit(False)))
    rows = quality.score(docs, quality.fit(docs, known))
    return rows.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct three-word shingles and near-duplicate class of every document."""
    return minhash.near_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix tree of all conversations, each rebuilt as a branch of its hundred's first one."""
    turns = trie.ordered(_table(spark, sf_dir, "conversations"))
    turns = materialize(turns, "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs, rebuilt = trie.branched(turns, F.col("conv_id") - F.col("conv_id") % 100, head)
    return trie.trie(materialize(convs, "conversations"), rebuilt)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, ten for each of its five positives."""
    table = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialize(negatives.whole_vectors(table.select("vec_id", label.alias("label"), "embedding")), "whole-vectors")
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))


#: Hits of every window of ten benchmark words (fewer: the whole item) in every document.
OP7_SQL = """
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), size AS (SELECT DISTINCT n FROM win), place AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc, size WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.i, p.n, win.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM place) p JOIN win ON p.s = win.s AND p.n = win.n
), word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Words under a window of 13 that starts in a document with a smaller id too.
OP9_SQL = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM doc WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM place),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM late)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM doc),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
"""

#: Documents linked by whole shingle sets, every link found by the shingles that two documents share.
OP11_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM doc JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""

#: Rebuilt conversations as lists of turns; a node is a distinct list of first turns, its subtree all that start with it.
OP12_SQL = """
WITH turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(s[k]) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
  FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM turn GROUP BY conv_id)
), branch AS (
  SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 100 AS base, least(c.h, coalesce(b.n, 0)) AS taken FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 100
), built AS (
  SELECT b.conv_id, t.i AS depth, t.role, t.text FROM branch b JOIN turn t ON t.conv_id = b.base AND t.i <= b.taken
  UNION ALL SELECT b.conv_id, t.i - b.h + b.taken, t.role, t.text FROM branch b JOIN turn t ON t.conv_id = b.conv_id AND t.i > b.h
), path AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
), len AS (SELECT conv_id, max(depth) AS turns FROM path GROUP BY conv_id),
node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM path GROUP BY p, depth),
up AS (
  SELECT DISTINCT node.p, above.p AS up, above.conv_id AS parent_conv_id FROM node JOIN path x ON x.conv_id = node.conv_id AND x.depth = node.depth - 1 JOIN node above ON above.p = x.p AND above.depth = x.depth WHERE node.depth > 0
), kids AS (SELECT up AS p, count(*) AS n FROM up GROUP BY up),
under AS (
  SELECT DISTINCT a.p AS top, node.p AS p, node.n_convs, node.chars FROM node JOIN path x ON x.conv_id = node.conv_id AND x.depth <= node.depth JOIN node a ON a.p = x.p AND a.depth = x.depth
), sums AS (
  SELECT top AS p, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves FROM under LEFT JOIN kids ON kids.p = under.p GROUP BY top
), ends AS (
  SELECT path.p, string_agg(CAST(path.conv_id AS VARCHAR), ',' ORDER BY path.conv_id) AS ids FROM path JOIN len ON len.conv_id = path.conv_id AND len.turns = path.depth GROUP BY path.p
)
SELECT node.conv_id, node.depth, up.parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves, CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN sums ON sums.p = node.p LEFT JOIN up ON up.p = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN ends ON ends.p = node.p
"""

#: Scores of all rows for every anchor, then ranks.
OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_shard, op2_language, op3_fingerprint, op4_extract, op5_neardup, op6_tokens, op7_decontaminate, op8_bpe, op9_substrings, op10_quality, op11_minhash, op12_trie, op13_negatives)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontaminate": OP7_SQL, "op9_substrings": OP9_SQL, "op11_minhash": OP11_SQL, "op12_trie": OP12_SQL, "op13_negatives": OP13_SQL}
