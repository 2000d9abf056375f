"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, star-shaped candidate links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare
from quillon.llm.components import connected_components
from quillon.llm.store import drop, materialize

SHINGLE, PERCENT = 3, 85
#: Two sets of likeness 0.85 share a band of five bins with probability 0.44, so forty bands miss them with 1e-10.
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


#: Bins that an empty bin tries, one after the other: a row of a 2-universal hash of (bin, attempt).
_TRIES = (_mix(np.arange(BINS * 4096, dtype=np.uint64) + _M1) % _U(BINS)).astype(np.int64).reshape(BINS, 4096)
_BAND = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _M1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct word shingles; with fewer words the whole sequence is one, with none there is none."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and \x09-\x0D and the space alone
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * _M1 + h[i : i + n])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least hash of each of BINS bins of one permutation; an empty bin copies the first filled one that it tries."""
    where = ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    bins, first = np.unique(where, return_index=True)  # hashes are sorted, and so are their bins
    out[bins], filled[bins] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(bins) == 1:
        out[:] = hashes[0]
        return out
    for at in range(0, _TRIES.shape[1], 32):
        if not len(empty):
            break
        tries = _TRIES[empty, at : at + 32]
        ok = filled[tries]
        hit = ok.any(1)
        found = tries[hit, ok[hit].argmax(1)]
        out[empty[hit]] = out[found]
        empty = empty[~hit]
    if len(empty):  # not once in 10^17 sets of two filled bins: any fixed rule does
        out[empty] = out[bins[0]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key a band: the hash of its number and its bins."""
    m = sig.reshape(BANDS, ROWS)
    out = _BAND.copy()
    for i in range(ROWS):
        out = _mix(out * _M1 + m[:, i])
    return out


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of id and text), n_shingles, digest (of the whole set, null without words) and bands of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, bands = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text)
                n.append(len(hashes))
                node.append(_digest(hashes) if len(hashes) else None)
                bands.append(band_keys(signature(hashes)).view(np.int64).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.binary())], ["doc_id", "key", "n_shingles", "digest", "bands"]
            )

    own = _keyed(docs, id_col, text_col)
    return own.mapInArrow(run, own.select("doc_id", "key").schema.add("n_shingles", "long").add("digest", "binary").add("bands", "binary"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), text.alias("text"))


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, hub (its first node), node, n: a row per band of each distinct set, where the bucket has another set too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            if not len(keys):
                continue
            at = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            bucket = np.frombuffer(b"".join(keys.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(at), batch.column(1).take(at)], ["bucket", "node", "n"])

    table = classes.select("node", "n", "bands").mapInArrow(run, "bucket long, node long, n long")
    shared = table.groupBy("bucket").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return table.join(shared.drop("members"), "bucket")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (the whole sorted set) of the rows ``wanted`` (key, node, digest): one text of each, hashed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = {}
            for node, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if node not in seen:
                    hashes = shingle_set(text)
                    if _digest(hashes) == digest:  # else another text has the same key
                        seen.add(node)
                        found[node] = hashes.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "shingles"])

    rows = _keyed(docs, id_col, text_col).join(wanted, "key").select("node", "digest", "text").mapInArrow(run, "node long, shingles binary")
    return rows.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    named = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """term, node, n, root, pos: of each of ``members`` (node, n, root) the shingles of which one must be shared by any two that link.

    Of two linked sets of n and m shingles, lined up by one order of all shingles, the first shared one stands at most
    at n - o + 1, o the least overlap that links them: 0.85 n at least. The order is by how many members have a shingle,
    then by its hash, so that what stands first is rare; those that one member alone has take places, and are no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_buffer() for x in batch.column(3)]
            if not raw:
                continue
            at = pa.array(np.repeat(np.arange(len(raw)), [x.size // 8 for x in raw]))
            term = np.frombuffer(b"".join(raw), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term), *(batch.column(i).take(at) for i in range(3))], ["term", "node", "n", "root"])

    every = members.join(sets, "node").select("node", "n", "root", "shingles").mapInArrow(run, "term long, node long, n long, root long")
    every = materialize(every, "minhash-shingles")
    common = every.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = every.join(common, "term")
    own = Window.partitionBy("node")
    held = held.withColumn("pos", F.row_number().over(own.orderBy("df", "term")) + F.col("n") - F.count(F.lit(1)).over(own))
    return held.where(100 * (F.col("n") - F.col("pos") + 1) >= PERCENT * F.col("n")).select("term", "node", "n", "root", "pos")


def _reach(n: str, m: str, i: str, j: str) -> Column:
    """Whether sets of n and m that first share their i-th and j-th shingle can still link."""
    return (100 + PERCENT) * (1 + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))) >= PERCENT * (F.col(n) + F.col(m))


def _between(keys: DataFrame, hubs: int) -> DataFrame:
    """Candidate pairs of each key's first ``hubs`` members with the others, of different components and within reach."""
    hub = keys.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("pos", "node"))).where(F.col("rank") <= hubs)
    hub = hub.select("term", *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "root", "pos")])
    pairs = keys.join(hub, "term").where((F.col("root") != F.col("hub_root")) & _reach("n", "hub_n", "pos", "hub_pos"))
    return pairs.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()


def _mixed(keys: DataFrame) -> DataFrame:
    """The rows of keys that members of several components have, one of which stands early enough to reach the others."""
    small = (100 + PERCENT) * (1 + F.col("n") - F.col("pos")) >= 2 * PERCENT * F.col("n")
    some = keys.groupBy("term").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(small).alias("small")).where("x <> y AND small").select("term")
    return keys.join(some, "term", "left_semi")


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Confirmed links (a, b) between distinct sets that connect what all links within shared buckets connect.

    Every bucket compares its members with its first one, so candidates grow with the rows, not with a group's square. A
    bucket whose members are of one component after that is done. In the others two members may be linked that are not
    both linked to the first. Those members are compared by their rarest shingles, of which linked sets share one, and
    only across components: again a key's first members with the others, four times as many each round until every key
    is of one component or has had all its members as hubs. So no link within a bucket is lost.
    """
    table = materialize(_buckets(classes), "minhash-buckets")
    pairs = table.where((F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")))
    pairs = materialize(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "minhash-pairs")
    wanted = table.select("node").distinct()
    sets = materialize(_sets(docs, classes.join(wanted, "node", "left_semi").select("key", "node", "digest"), id_col, text_col), "minhash-sets")
    found = [materialize(_confirmed(pairs, sets), "minhash-links")]
    roots = materialize(connected_components(found[0]), "minhash-roots")
    placed = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = placed(table.select("bucket", "node", "n"))
    mixed = at.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    members = materialize(at.join(mixed, "bucket", "left_semi").select("node", "n", "root").distinct(), "minhash-members")
    drop(table)
    keys = materialize(_mixed(_rarest(members, sets)), "minhash-keys")
    tried, hubs = pairs, 1
    while not keys.isEmpty():
        pairs = materialize(_between(keys, hubs).join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
        new = materialize(_confirmed(pairs, sets), "minhash-links")
        found.append(new)
        tried = tried.union(pairs)
        if not new.isEmpty():
            roots = materialize(connected_components(_union(found)), "minhash-roots")
        many = keys.groupBy("term").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hubs).select("term")
        after = materialize(_mixed(placed(keys.drop("root").join(many, "term", "left_semi"))), "minhash-keys")
        drop(keys)
        keys, hubs = after, 4 * hubs
    drop(sets)
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts link where 100 * intersection >= 85 * union of their distinct three-word shingles, A-Z lower-cased; a text of
    fewer words is one shingle, one without words (or null) has none and links with nothing: its component is itself.
    component_id is the smallest doc_id reachable; kept: it is the row's own. Repeated rows and equal sets are one node.
    Rows with a null id count for reachability, not for the smallest id; where no other is reachable component_id is
    null and the row kept. Shingles are compared as 64-bit hashes, sets told apart by 128-bit digests. Empty table: no rows.

    Plan: one pass makes the sketches; buckets hold distinct sets, so copies make none hot; texts of sets that share a
    bucket are hashed once more for their whole sets; the component comes back by the set's digest, in a join that Spark
    can split where copies make it hot.
    """
    rows = materialize(sketches(docs, id_col, text_col), "minhash-rows")
    shingled = rows.where("digest IS NOT NULL")
    sums = shingled.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(sums.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    roots = materialize(connected_components(links(docs, classes, id_col, text_col)), "minhash-components")
    joined = classes.select("digest", "node", "least").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(joined.select("digest", "root").join(least, "root").select("digest", "component_id"), "minhash-of")
    single = rows.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(of, "digest").select("doc_id", "n_shingles", "component_id").union(single)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
