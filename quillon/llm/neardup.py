"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare
from quillon.llm.components import connected_components
from quillon.llm.store import materialize

SHINGLE, RADIUS, SEED = 4, 4, 42
#: First bit and width of each segment of a fingerprint. Radius 4 over three segments: some segment differs in one bit
#: at most, so a ball of radius 1 in each segment finds every link.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket is compared as a whole up to so many fingerprints, in pairs of such blocks beyond.
BLOCK = 4096
#: Runs up to this length are compared by shifting the whole batch.
SHORT = 12


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles: a bit is set if more than half the hashes have it; no word: 0."""
    words = text.lower().split()  # of bytes: A-Z alone, and \x09-\x0D and the space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - size + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long) of every row; a null text has no words, so its bits are zero."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary()).to_pylist()
            fps = np.array([simhash(x or b"", size) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return own.mapInArrow(run, own.select("doc_id", "text_hash").schema.add("fp", "long"))


def probes(fps: DataFrame) -> DataFrame:
    """Table rows of each distinct fingerprint: bucket (segment and its bits), role and fp.

    Role 0 is the entry under its own segment bits; role 1 are its visits to the segment's Hamming ball of radius 1. Two
    fingerprints that differ in one bit of a segment meet when the one that has the bit visits the other's bucket, so
    visits clear a bit and need not set one.
    """
    parts = []
    for k, (lo, width) in enumerate(SEGMENTS):
        key = f"(shiftrightunsigned(fp, {lo}) & {(1 << width) - 1}L)"
        tag = k << 60
        parts.append(f"array(named_struct('bucket', {tag}L | {key}, 'role', 0))")
        parts.append(
            f"transform(filter(sequence(0, {width - 1}), i -> (shiftright({key}, i) & 1L) = 1L), "
            f"i -> named_struct('bucket', {tag}L | ({key} & ~shiftleft(1L, i)), 'role', 1))"
        )
    return fps.select("fp", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("p")).select("p.bucket", "p.role", "fp")


def spanning(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that connect all that can be connected: a forest, fewer links than fingerprints."""
    left = np.unique(fps)
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            by = np.zeros(len(left), np.int64)
            for i in range(0, len(front), 512):
                near = np.bitwise_count(left[:, None] ^ front[None, i : i + 512]) <= radius
                hit = near.any(1) & ~found
                by[hit] = i + near[hit].argmax(1)
                found |= hit
            a.append(front[by[found]])
            b.append(left[found])
            front, left = left[found], left[~found]
    none = np.zeros(0, fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


_LINKS = "a long, b long, bucket long, blk int, payload binary"


def _links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["a", "b", "bucket", "blk", "payload"]
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and role: links of each bucket, or its blocks where it is long."""
    none = np.zeros(0, np.uint64)
    kept_bucket, kept_role, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int32), none
    open_bucket, written = None, 0  # a long bucket whose blocks are being written

    def blocks(bucket: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal open_bucket, written
        if open_bucket != bucket:
            open_bucket, written = bucket, 0
        for i in range(0, len(fps), BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int64()), pa.array([written], pa.int32()), pa.array([fps[i : i + BLOCK].tobytes()], pa.binary())],
                ["a", "b", "bucket", "blk", "payload"],
            )
            written += 1

    def complete(bucket: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bucket[0] == open_bucket:  # the rest of a bucket whose blocks have begun, however short
            n = int(np.searchsorted(bucket, open_bucket, "right"))
            yield from blocks(int(open_bucket), fp[:n])
            bucket, role, fp = bucket[n:], role[n:], fp[n:]
            if not len(bucket):
                return
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(edges, len(bucket)))
        long_run = np.repeat(sizes > SHORT, sizes)
        for d in range(1, min(SHORT, int(sizes.max()))):
            i = np.flatnonzero((bucket[d:] == bucket[:-d]) & (role[:-d] == 0) & ~long_run[d:])
            near = np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS
            i = i[near]
            if len(i):
                yield _links_batch(fp[i], fp[i + d])
        for k in np.flatnonzero(sizes > SHORT):
            at, n = int(edges[k]), int(sizes[k])
            if role[at] == 0:  # else visitors alone, who meet elsewhere
                if n > BLOCK:
                    yield from blocks(int(bucket[at]), fp[at : at + n])
                else:
                    a, b = spanning(fp[at : at + n])
                    if len(a):
                        yield _links_batch(a, b)

    for batch in batches:
        bucket = np.concatenate([kept_bucket, batch.column(0).to_numpy()])
        role = np.concatenate([kept_role, batch.column(1).to_numpy()])
        fp = np.concatenate([kept_fp, batch.column(2).to_numpy().view(np.uint64)])
        if not len(bucket):
            continue
        last = int(np.searchsorted(bucket, bucket[-1]))  # sorted: the last bucket may go on
        if last:
            yield from complete(bucket[:last], role[:last], fp[:last])
        bucket, role, fp = bucket[last:], role[last:], fp[last:]
        if role[0] != 0 and open_bucket != bucket[0]:  # visitors alone: one row tells as much
            bucket, role, fp = bucket[:1], role[:1], fp[:1]
        if len(bucket) > 2 * BLOCK and (role[0] == 0 or open_bucket == bucket[0]):
            yield from blocks(int(bucket[0]), fp[: len(fp) // BLOCK * BLOCK])
            part = len(fp) // BLOCK * BLOCK
            bucket, role, fp = bucket[part:], role[part:], fp[part:]
        kept_bucket, kept_role, kept_fp = bucket, role, fp
    if len(kept_bucket):
        yield from complete(kept_bucket, kept_role, kept_fp)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, lo, hi): the one or two blocks of each pair come one after the other."""
    key, held = None, []

    def links() -> Iterator[pa.RecordBatch]:
        if held:
            a, b = spanning(np.concatenate(held))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        for bucket, lo, hi, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (bucket, lo, hi) != key:
                yield from links()
                key, held = (bucket, lo, hi), []
            held.append(np.frombuffer(payload, np.uint64))
    yield from links()


#: Bits of a fingerprint's first segment's rest, and the widths of the second level's segments in it.
FINE = (15, 14, 14)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long buckets dealt anew: the same tables over the bits that the bucket leaves open."""
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fps = np.unique(np.frombuffer(payload, np.uint64))
            lo, width = SEGMENTS[bucket >> 60]
            low = fps & np.uint64((1 << lo) - 1)
            rest = low | (fps >> np.uint64(lo + width) << np.uint64(lo))
            at = 0
            for k, wide in enumerate(FINE):
                key = (rest >> np.uint64(at) & np.uint64((1 << wide) - 1)).astype(np.int64)
                at += wide
                tag = (bucket >> 60 << 60) | (bucket & ((1 << 22) - 1)) << 24 | k << 20
                found, role, who = [key | tag], [np.zeros(len(key), np.int32)], [fps]
                for bit in range(wide):
                    has = key >> bit & 1 == 1
                    found.append(key[has] & ~(1 << bit) | tag)
                    role.append(np.ones(int(has.sum()), np.int32))
                    who.append(fps[has])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(role)), pa.array(np.concatenate(who).view(np.int64))], ["bucket", "role", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs within RADIUS would.

    Buckets hold distinct fingerprints, so exact copies can't make one hot. A bucket that near copies, or sheer numbers,
    make long is dealt anew by the same method over the bits that it leaves open (three segments, balls of radius 1);
    what stays long then is compared in pairs of blocks spread over tasks. Each comparison returns a forest, not pairs.
    """
    prepare(fps.sparkSession)
    table = probes(fps).repartition("bucket").sortWithinPartitions("bucket", "role")
    found = materialize(table.mapInArrow(_verify, _LINKS), "simhash-links")
    out = found.where("payload IS NULL").select("a", "b")
    if found.where("payload IS NOT NULL").isEmpty():
        return out
    finer = found.where("payload IS NOT NULL").select("bucket", "payload").mapInArrow(_finer, "bucket long, role int, fp long").distinct()
    found = materialize(finer.repartition("bucket").sortWithinPartitions("bucket", "role").mapInArrow(_verify, _LINKS), "simhash-finer-links")
    parts = found.where("payload IS NOT NULL").select("bucket", "blk", "payload")
    total = parts.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n"))
    meet = parts.join(total, "bucket").withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    meet = meet.where("other <> blk OR n = 1").select("bucket", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "payload")
    pairs = meet.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_block_pairs, "a long, b long")
    return out.union(found.where("payload IS NULL").select("a", "b")).union(pairs)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the component) and component_id of every row.

    component_id is the smallest doc_id reachable over links, its own included.

    Null texts and texts without words share the fingerprint zero and link like any other. Rows with a null id are
    kept; they count for reachability but not for the smallest id. Repeated rows are one node. Empty table: no rows.

    Plan: narrow (doc_id, fp) table; one row per distinct fingerprint; probe table shuffled by bucket; star contraction;
    the class is joined back by fingerprint, in a join that Spark can split where copies make it hot.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    roots = materialize(connected_components(links(classes.select("fp"))), "fp-roots")
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    member = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    single = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    of_fp = materialize(member.union(single), "fp-components")
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays per component: the one with the smallest id; all columns as they are.

    Where several rows of a component carry that id, the one with the smallest text hash stays (equal rows: one of
    them). A component of null ids alone keeps one row. Names of our own are not taken if ``docs`` has them.
    """
    key, ids, hashes = (_free(docs, n) for n in ("__key", "__id", "__hash"))
    first = near_components(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    stay = stay.select(F.xxhash64("doc_id", "text_hash").alias(key), F.col("doc_id").alias(ids), F.col("text_hash").alias(hashes))
    rows = docs.withColumn(key + "k", F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))))
    same = F.col(id_col).eqNullSafe(F.col(ids)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashes))
    kept = rows.join(stay, (F.col(key + "k") == F.col(key)) & same, "left_semi")
    order = Window.partitionBy(key + "k", id_col).orderBy(F.lit(1))
    return kept.withColumn(key, F.row_number().over(order)).where(F.col(key) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name
