"""Substring dedup by relative Lempel-Ziv parsing.

The reference text is every document that comes before (smaller id), kept in blocks of word sequences. Where a document
may be factored is found by anchors: every 13-word window has one run of GRAM words with the least hash, so windows that
are equal have equal anchors and the pieces of text around an anchor meet in one block. A block factors each piece
against the pieces of earlier documents. It is not the greedy parse of the textbook: each window is referred to the
smallest id that has it, and a factor is a run of windows referred to one document, so a passage that a later document has
in one piece may come as two factors of two documents. Which words are covered is the same under either parse. Hashes only propose; a factor counts when its words equal the reference's, byte by byte. Factors of neighbouring pieces
with one source are joined again where the document is cut.

Anchors that are too common to be a block's (found by a first pass over all documents) rank behind all others. Windows
that have none but such are posted one by one, dealt by their own hash, so that no anchor makes a block hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare, tidy, utf8
from quillon.llm.store import drop, materialize

#: Words of a window and of an anchor; words of documents for each reference block; bytes hashed at once.
WINDOW, GRAM, BLOCK_WORDS, CHUNK = 13, 3, 250_000, 1 << 18
#: An anchor is common with this share of all anchors (over 16 for each partition, bounded): so many are sent out at most.
LEAST_SHARE = 2.0**-20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WINDOW)]
_GRAM_POWERS = [np.uint64(pow(0xA0761D6478BD642F, k, 1 << 64)) for k in range(GRAM)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_COMMON = np.uint64(1 << 63)

#: Level at which pieces of text are packed.
PACK = 5
#: A factor as it travels: first window, number of windows, the source's document and first window, and the hash of its
#: words, by which rows that share an id know their own.
FACTOR = np.dtype([("start", "<i4"), ("count", "<i4"), ("source", "<i8"), ("source_start", "<i4"), ("check", "<u8")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xE7037ED1A0B428DB)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x8EBC6AF09C88C6E3)
    return h ^ (h >> np.uint64(32))


def joined_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the rows in ``raw`` joined by one space each, with every word's first and past-the-last byte and its row."""
    solid = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    begins = solid & ~(np.concatenate([[False], solid[:-1]]) & ~border[:-1])
    start = np.flatnonzero(begins)
    end = np.flatnonzero(solid & ~(np.concatenate([solid[1:], [False]]) & ~border[1:])) + 1
    stop = np.cumsum(end - start + 1) - 1
    text = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
    letters = np.ones(len(text), bool)
    letters[stop] = False
    text[letters] = raw[solid]
    kind = np.int32 if len(raw) < 1 << 30 else np.int64
    return text, (stop - (end - start)).astype(kind), stop.astype(kind), (np.searchsorted(offsets, start, "right") - 1).astype(kind)


_kept_powers: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _kept_powers or len(_kept_powers[0]) < n:
        both = []
        for base in (_BASE, _BASE_INVERSE):
            row = np.full(max(n, CHUNK), base)
            row[0] = 1
            both.append(np.cumprod(row))
        _kept_powers[:] = both if n <= 2 * CHUNK else []
        return both[0][:n], both[1][:n]
    return _kept_powers[0][:n], _kept_powers[1][:n]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, by differences of prefix sums, then mixed."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
        lo, hi = start[at], end[stop - 1]
        n = int(hi - lo)
        powers, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * powers, out=sums[1:])
        s, e = start[at:stop] - lo, end[at:stop] - lo
        out[at:stop] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = stop
    return _mix(out)


def _rolled(h: np.ndarray, powers: list[np.uint64]) -> np.ndarray:
    n = len(h) - len(powers) + 1
    out = np.zeros(max(0, n), np.uint64)
    for k, p in enumerate(powers):
        out += h[k : k + n] * p if n > 0 else out
    return _mix(out)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sources(text: bytes, lo: np.ndarray, hi: np.ndarray, row: np.ndarray, hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window the number of an equal one whose owner comes before, -1 if there is none.

    Windows stand in order of ``row`` and place; ``lo`` and ``hi`` are their bytes in ``text``. Equal hashes propose the
    least owner's window; runs of windows with one run as their source are compared as wholes, byte by byte. Where
    bytes differ, all windows with that hash are told apart by their bytes, so any hash gives the same answer.
    """
    found = np.full(len(hashed), -1, np.int64)
    order = np.argsort(hashed)
    equal = hashed[order[1:]] == hashed[order[:-1]]
    several = np.zeros(len(order), bool)
    several[1:] = equal
    several[:-1] |= equal
    some = np.sort(order[several])
    if not len(some):
        return found
    order = some[np.lexsort((owner[some], hashed[some]))]
    heads = _runs(hashed[order])
    size = np.diff(np.append(heads, len(order)))
    least = np.repeat(order[heads], size)
    late = owner[order] > owner[least]
    found[order[late]] = least[late]
    cand = np.flatnonzero(found >= 0)
    if not len(cand):
        return found
    src = found[cand]
    new = np.ones(len(cand), bool)
    new[1:] = (cand[1:] != cand[:-1] + 1) | (src[1:] != src[:-1] + 1) | (row[cand[1:]] != row[cand[:-1]]) | (row[src[1:]] != row[src[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(cand)) - 1
    a, b, c, d = (x.tolist() for x in (lo[cand[first]], hi[cand[last]], lo[src[first]], hi[src[last]]))
    wrong = [k for k in range(len(a)) if text[a[k] : b[k]] != text[c[k] : d[k]]]
    if wrong:
        bad = np.concatenate([hashed[cand[first[k] : last[k] + 1]] for k in wrong])
        known: dict[bytes, int] = {}
        for i in order[np.isin(hashed[order], bad)].tolist():  # by hash, owner, place
            earlier = known.setdefault(text[lo[i] : hi[i]], i)
            found[i] = earlier if owner[i] > owner[earlier] else -1
    return found


def _factors(text: bytes, lo: np.ndarray, hi: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray, src: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(document, its longest factors) of windows in order of row and place, with the equal window of each in ``src``."""
    found = np.flatnonzero(src >= 0)
    if not len(found):
        return
    s = src[found]
    cut = np.ones(len(found), bool)
    cut[1:] = (found[1:] != found[:-1] + 1) | (row[found[1:]] != row[found[:-1]]) | (doc[s[1:]] != doc[s[:-1]]) | (place[s[1:]] != place[s[:-1]] + 1)
    first = np.flatnonzero(cut)
    a, z, s = found[first], found[np.append(first[1:], len(found)) - 1], s[first]
    rows = np.empty(len(a), FACTOR)
    rows["start"], rows["count"], rows["source"], rows["source_start"] = place[a], z - a + 1, doc[s], place[s]
    rows["check"] = [xxhash.xxh64_intdigest(text[x:y]) for x, y in zip(lo[a].tolist(), hi[z].tolist())]
    by = np.argsort(doc[a], kind="stable")
    rows, owner = rows[by], doc[a][by]
    heads = _runs(owner)
    for x, y in zip(heads.tolist(), np.append(heads[1:], len(rows)).tolist()):
        yield int(owner[x]), rows[x:y].tobytes()


_POSTED = "p int, doc long, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["p", "doc", "blob"])


class Windows:
    """The windows of a batch of documents: bytes, hashes, and the place of the anchor of each."""

    def __init__(self, batch: pa.RecordBatch, common: np.ndarray, hash_bits: int = 64) -> None:
        raw, offsets = utf8(batch.column(1))
        buffer, lo, hi, of = joined_words(raw, offsets)
        self.words = len(lo)
        self.text = buffer.tobytes()
        self.lo, self.hi = lo, hi
        del raw, buffer
        h = word_hashes(np.frombuffer(self.text, np.uint8), lo, hi)
        whole, gram = _rolled(h, _WINDOW_POWERS), _rolled(h, _GRAM_POWERS)
        del h
        self.inside = np.flatnonzero(of[: len(whole)] == of[WINDOW - 1 :]) if len(whole) else np.zeros(0, np.int64)
        if not len(self.inside):
            return
        self.gram = gram = gram >> np.uint64(1)
        if len(common):
            at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
            self.gram = gram = np.where(common[at] == gram, gram | _COMMON, gram)
        view = np.lib.stride_tricks.sliding_window_view(gram, WINDOW - GRAM + 1)
        turn = np.concatenate([view[self.inside[i : i + 65536]].argmin(1) for i in range(0, len(self.inside), 65536)])
        self.anchor = self.inside + turn
        self.row = of[self.inside]
        self.hashed = whole[self.inside] >> np.uint64(64 - hash_bits)
        first = np.searchsorted(of, np.arange(len(offsets) - 1))
        self.place = (self.inside - first[self.row]).astype(np.int32)


def _tally(share: float):
    """(gram, n): each task's commonest anchors, at least half the share of its own; and (null, words of all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, seen, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for batch in batches:
            w = Windows(batch, np.zeros(0, np.uint64))
            words += w.words
            if not len(w.inside):
                continue
            own = w.gram[w.anchor[_runs(w.anchor, w.row)]]
            seen += len(own)
            own, n = np.unique(own, return_counts=True)
            grams, back = np.unique(np.concatenate([grams, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(grams)).astype(np.int64)
            kept = counts >= share / 4 * seen  # what is rarer so far is forgotten: an undercount of a quarter at most
            grams, counts = grams[kept], counts[kept]
        tidy()
        kept = counts >= share / 2 * seen
        found = [*grams[kept].view(np.int64).tolist(), None, None]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([*counts[kept].tolist(), words, None], pa.int64()), pa.array([None] * (len(found) - 1) + [seen], pa.int64())], ["gram", "n", "anchors"])

    return run


def _postings(blocks: int, common: np.ndarray, hash_bits: int):
    """Rows for the reference blocks: packed pieces of text (null doc), and factors that the batch knows by itself (with doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=PACK).compress
        for batch in batches:
            w = Windows(batch, common, hash_bits)
            if not len(w.inside):
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[w.row]
            inside, at = w.inside, w.place
            lo, hi = w.lo[inside], w.hi[inside + WINDOW - 1]
            # what this batch knows by itself: only the smallest id's windows are posted
            src = sources(w.text, lo, hi, w.row, w.hashed, doc)
            out = [(d % blocks, d, b) for d, b in _factors(w.text, lo, hi, w.row, doc, at, src)]
            value = w.gram[w.anchor]
            alone = value >= _COMMON
            heads = np.ones(len(inside), bool)
            heads[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1]) | alone[1:]
            posts = np.flatnonzero(heads)
            size = np.diff(np.append(posts, len(inside)))
            asks = np.logical_or.reduceat(src < 0, posts)
            posts, size = posts[asks], size[asks]
            if len(posts):
                key = np.where(alone[posts], w.hashed[posts], _mix(value[posts]))
                block = (key % np.uint64(blocks)).astype(np.int64)
                by = np.argsort(block, kind="stable")
                posts, size, block = posts[by], size[by], block[by]
                begin, end = lo[posts].tolist(), hi[posts + size - 1].tolist()
                cuts = _runs(block)
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(block)).tolist()):
                    p = posts[a:b]
                    owner = np.diff(doc[p], prepend=0).astype("<i8").tobytes()
                    head = pack(owner + at[p].astype("<i4").tobytes() + size[a:b].astype("<i4").tobytes())
                    body = pack(b"\n".join([w.text[x:y] for x, y in zip(begin[a:b], end[a:b])]))
                    out.append((int(block[a]), None, np.array([b - a, len(head)], "<i8").tobytes() + head + body))
            if out:
                yield _rows(out)
        tidy()

    return run


def _unpack(blob: bytes) -> tuple:
    unpack = zstandard.ZstdDecompressor().decompress
    n, size = np.frombuffer(blob, "<i8", 2).tolist()
    head = unpack(blob[16 : 16 + size])
    at, count = np.frombuffer(head, "<i4", 2 * n, 8 * n).reshape(2, n)
    return np.cumsum(np.frombuffer(head, "<i8", n)), at, count, unpack(blob[16 + size :])


def factor_block(blobs: list[bytes], hash_bits: int = 64) -> Iterator[tuple[int, bytes]]:
    """(document, factors) of a reference block: each piece against the pieces of earlier documents."""
    parts = [_unpack(b) for b in blobs]
    doc, at, size = (np.concatenate(c) for c in list(zip(*parts))[:3])
    text = b"\n".join([p[3] for p in parts])
    del parts
    buffer = np.frombuffer(text, np.uint8)
    kind = np.int32 if len(text) < 1 << 30 else np.int64
    gaps = np.flatnonzero((buffer == 0x20) | (buffer == 0x0A)).astype(kind)
    lo, hi = np.concatenate([np.zeros(1, kind), gaps + kind(1)]), np.append(gaps, kind(len(buffer)))
    whole = _rolled(word_hashes(buffer, lo, hi), _WINDOW_POWERS)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    word = np.repeat(np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1), size) + place
    place += at[row]
    lo, hi, whole = lo[word], hi[word + WINDOW - 1], whole[word] >> np.uint64(64 - hash_bits)
    src = sources(text, lo, hi, row, whole, doc[row])
    yield from _factors(text, lo, hi, row, doc[row], place, src)


def _resolve(hash_bits: int):
    """Rows sorted by block: the factors of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def answer() -> Iterator[pa.RecordBatch]:
            rows = [(0, *x) for x in factor_block(held, hash_bits)]
            held.clear()
            for i in range(0, len(rows), 5000):
                yield _rows(rows[i : i + 5000])

        for batch in batches:
            for p, doc, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != now and held:
                    yield from answer()
                now = p
                if doc is None:
                    held.append(blob)
                else:
                    yield _rows([(p, doc, blob)])
        if held:
            yield from answer()
        tidy()

    return run


def _partitions(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())


def find_factors(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(doc, blob): the factors of each document, packed as FACTOR, over the text of documents with smaller ids.

    ``rows`` has doc_id (long) and text. Every batch posts a window once, for its smallest id, so a passage that
    a third of all documents share makes no block hot. ``hash_bits`` bounds the proposing hash (the answer is the same).
    The driver receives the common anchors, 2 / share of them at most. Written to the shared folder.
    """
    spark = rows.sparkSession
    prepare(spark)
    parts = _partitions(rows)
    own = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    share = max(1 / (16 * parts), LEAST_SHARE)
    tally = own.mapInArrow(_tally(share), "gram long, n long, anchors long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors"))
    tally = materialize(tally, "anchors")
    whole = tally.where("gram IS NULL").first()
    words, anchors = (whole.n or 0, whole.anchors or 0) if whole else (0, 0)
    common = np.sort(np.array([r.gram for r in tally.where(F.col("gram").isNotNull() & (F.col("n") >= share / 2 * anchors)).collect()], np.int64).view(np.uint64))
    drop(tally)
    blocks = max(parts, -(-words // BLOCK_WORDS))
    posted = own.mapInArrow(_postings(blocks, common, hash_bits), _POSTED)
    dealt = posted.repartition(parts, "p").sortWithinPartitions("p")
    return materialize(dealt.mapInArrow(_resolve(hash_bits), _POSTED).select("doc", "blob"), "factors")


def parse(blobs: list[bytes], words: list[bytes] | None = None) -> np.ndarray:
    """A document's factors by first word, those joined that follow one another in one source.

    Of factors under a repeated id, those count whose words stand at their place in ``words``.
    """
    rows = np.unique(np.frombuffer(b"".join(blobs), FACTOR))
    if words is not None:
        spans = zip(rows["start"].tolist(), (rows["start"] + rows["count"] + WINDOW - 1).tolist(), rows["check"].tolist())
        rows = rows[np.array([b <= len(words) and xxhash.xxh64_intdigest(b" ".join(words[a:b])) == c for a, b, c in spans], bool)]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    start, count = rows["start"].astype(np.int64), rows["count"].astype(np.int64)
    lead = rows["source_start"].astype(np.int64) - start
    new[1:] = (start[1:] != start[:-1] + count[:-1]) | (rows["source"][1:] != rows["source"][:-1]) | (lead[1:] != lead[:-1])
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out["count"] = np.add.reduceat(count, at)
    return out


def covered(words: int, factors: np.ndarray) -> np.ndarray:
    """Which words the factors cover."""
    cover = np.zeros(words + 1, np.int32)
    start = factors["start"].astype(np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + factors["count"] + WINDOW - 1, -1)
    return np.cumsum(cover)[:words] > 0


def _lined(docs: DataFrame, found: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Factors and texts of each document in one partition, factors first. Rows with a null id have no factors and stay spread."""
    both = found.select("doc", "blob").unionByName(rows.withColumnRenamed("doc_id", "doc"), allowMissingColumns=True)
    place = F.when(F.col("doc").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc"))
    both = both.withColumn("place", place).repartition(_partitions(docs), "place").sortWithinPartitions("doc", F.col("blob").isNull())
    return both.select("doc", "blob", "text", *columns)


def _own(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


_TEXT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(want_text: bool):
    """Rows sorted by document, factors before texts: the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blobs = None, []
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc, blob, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if doc != key:
                    key, blobs = doc, []
                if blob is not None:
                    blobs.append(blob)
                    continue
                own = (text or "").encode().split()
                kept = own
                if blobs and doc is not None:
                    gone = covered(len(own), parse(blobs, own))
                    kept = [w for w, g in zip(own, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out[0].append(doc)
                out[1].append(len(own))
                out[2].append(len(own) - len(kept))
                out[3].append(sha256(joined).hexdigest())
                out[4].append(None if not want_text or text is None else text if len(kept) == len(own) else joined.decode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept: the words that no earlier document's window covers.

    Words are runs of other than ASCII white space. A window of 13 words is duplicate if a row with a smaller doc_id has
    it; all is judged on the input. ``kept`` is the text itself where nothing goes, else the kept words joined by one
    space. Null texts have no words (and stay null); rows with a null id neither lose words nor count as earlier; rows
    with equal ids don't count as earlier for one another, and each loses its own words; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = _own(docs, id_col, text_col)
    return _lined(docs, find_factors(rows, hash_bits), rows).mapInArrow(_cut(want_text), _TEXT)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words, source_id, source_start: the factors of every document, places in words from 0.

    Rows with a null id or text have none; rows with equal ids are listed under that id each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blobs = None, []

        def listed() -> pa.RecordBatch:
            f = parse(blobs)
            cols = (np.full(len(f), key or 0), f["start"], f["count"].astype(np.int64) + WINDOW - 1, f["source"], f["source_start"])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in cols], ["doc_id", "start", "n_words", "source_id", "source_start"])

        for batch in batches:
            for doc, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if doc != key:
                    yield listed()
                    key, blobs = doc, []
                blobs.append(blob)
        yield listed()

    found = find_factors(_own(docs, id_col, text_col)).repartition(_partitions(docs), "doc").sortWithinPartitions("doc")
    return found.mapInArrow(run, "doc_id long, start long, n_words long, source_id long, source_start long")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with duplicate substrings gone from the text, and its length in ``chars_col`` where there is such a column.

    All rows stay, those that lose every word with an empty text; null texts stay null. The other columns travel with
    the row, whatever their names, so the texts are shuffled once.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.lit(1).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = _own(docs, id_col, text_col, rest.alias("rest"))
    together = _lined(docs, find_factors(rows), rows, "rest")
    schema = together.select(F.col("doc").alias("doc_id"), "text", "rest").schema
    out = together.mapInArrow(_replace, schema)
    back = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    if chars_col in back:
        back[chars_col] = F.char_length("text").cast(docs.schema[chars_col].dataType)
    return out.select(*[back[c].alias(c) for c in docs.columns])


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, factors before texts: the rows with what is left of their texts."""
    key, blobs = None, []
    for batch in batches:
        stay, left = [], []
        for i, (doc, blob, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if doc != key:
                key, blobs = doc, []
            if blob is not None:
                blobs.append(blob)
                continue
            if blobs and doc is not None and text:
                own = text.encode().split()
                gone = covered(len(own), parse(blobs, own))
                text = b" ".join([w for w, g in zip(own, gone.tolist()) if not g]).decode()
            stay.append(i)
            left.append(text)
        rows = batch.take(pa.array(stay, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(left, pa.string()), rows.column(3)], ["doc_id", "text", "rest"])
    tidy()
