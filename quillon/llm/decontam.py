"""Benchmark decontamination over a stored positional inverted index of all tokens."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from quillon.llm.arrow import prepare
from quillon.llm.store import materialize

#: Words of a window; words left between the documents of an index block; widest proximity.
WINDOW, GAP, SLOP_MOST = 10, 64, 16
#: Text of an index block, and of the test items that one pass sends out, in bytes. More items take more passes over the index.
BLOCK_BYTES, PASS_BYTES = 4 << 20, 2 << 20
#: Words of an item that go into one pass together; a longer item is cut into overlapping parts with the same windows.
PART_WORDS = 4096
#: Places of rarest terms that are tried at once.
TRIES = 1 << 20

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Windows:
    """The windows of some test items: a row of term numbers each, short items padded with -1."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW) -> None:
        self.terms: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                rows.setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.items = [sorted(x) for x in rows.values()]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.matrix = np.full((len(rows), size), -1, np.int32)
        for k, r in enumerate(rows):
            self.matrix[k, : len(r)] = r


def _index_schema(id_field: StructField) -> StructType:
    rest = "n_words array<long>, keys array<long>, terms binary, sizes binary, postings binary"
    return StructType([StructField("doc_ids", ArrayType(id_field.dataType)), *StructType.fromDDL(rest).fields])


def _block(ids: list, id_type: pa.DataType, keys: list, texts: list[bytes]) -> pa.RecordBatch:
    """Index of some documents: their distinct terms, and for each its positions in ascending order, as steps."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    found, at, counts, base = [], [], [], 0
    for text in texts:
        own = words(text)
        found.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
        at.append(np.arange(base, base + len(own), dtype=np.int64))
        counts.append(len(own))
        base += len(own) + GAP
    term, position = np.concatenate(found), np.concatenate(at)
    order = np.argsort(term, kind="stable")
    n = np.bincount(term, minlength=len(number))
    steps = np.diff(position[order], prepend=0)
    steps[(np.cumsum(n) - n)[n > 0]] = position[order][(np.cumsum(n) - n)[n > 0]]
    pack = zstandard.ZstdCompressor(level=1).compress
    wide = np.uint32 if base < 1 << 32 else np.uint64
    row = [[ids], [counts], [keys], [pack(b" ".join(number))], [n.astype(np.uint32 if base < 1 << 32 else np.uint64).tobytes()], [pack(steps.astype(wide).tobytes())]]
    long = pa.list_(pa.int64())
    names = ["doc_ids", "n_words", "keys", "terms", "sizes", "postings"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.list_(id_type), long, long, pa.binary(), pa.binary(), pa.binary()))], names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional postings of every token of all documents, in blocks of about BLOCK_BYTES of text; written once.

    The index knows nothing of any test item: it serves all passes of a benchmark, and any benchmark. Ids keep their
    type. Null texts have no tokens; a longer text is a block of its own; repeated rows are kept apart; an empty table
    gives an empty index; other columns are ignored.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    id_type = to_arrow_type(own.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held, size = [], [], [], 0
        for batch in batches:
            for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
                ids.append(i)
                keys.append(k)
                held.append(t or b"")
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield _block(ids, id_type, keys, held)
                    ids, keys, held, size = [], [], [], 0
        if ids:
            yield _block(ids, id_type, keys, held)

    return materialize(own.mapInArrow(run, _index_schema(own.schema["doc_id"])), "postings")


class Block:
    """A block's postings of the terms that some windows have: their lists one after the other, and the term at each place."""

    def __init__(self, row: dict, windows: Windows) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        self.counts = np.array(row["n_words"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.counts + GAP)])
        wide = np.uint32 if self.base[-1] < 1 << 32 else np.uint64
        n = np.frombuffer(row["sizes"], wide).astype(np.int64)
        own = unpack(row["terms"]).split(b" ") if len(n) else []
        number = np.fromiter((windows.terms.get(w, -1) for w in own), np.int64, len(own))
        known = np.flatnonzero(number >= 0)
        steps = np.frombuffer(unpack(row["postings"]), wide).astype(np.int64)
        total, first = np.cumsum(steps), np.cumsum(n) - n
        starts = first[known]
        size = n[known]
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        before = np.concatenate([[0], total])[starts]
        self.lists = total[each] - np.repeat(before, size)
        self.frequency = np.zeros(len(windows.terms) + 1, np.int64)
        self.start = np.zeros(len(windows.terms) + 1, np.int64)
        self.frequency[number[known]] = size
        self.start[number[known]] = np.cumsum(size) - size
        self.term_at = np.full(int(self.base[-1]) + 2 * (WINDOW + SLOP_MOST), -1, np.int32)
        self.term_at[self.lists] = np.repeat(number[known], size)


def matches(block: Block, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Window number and start of each match: lists are intersected from the rarest term on, shifted by offset.

    The places of a window's rarest term in the block are its first candidates; each further term, from the rarer ones
    on, keeps those that have it at its offset. All windows go through at once, TRIES candidates at a time. With
    ``slop``, every start that has each term within so many words of its place; it may lie outside the document.
    """
    none = np.zeros(0, np.int64)
    if not len(windows.matrix):
        return none, none
    block.frequency[-1] = np.iinfo(np.int64).max  # the padding
    each = block.frequency[windows.matrix]
    alive = np.flatnonzero(each.min(1) > 0)
    order = np.argsort(each[alive], axis=1, kind="stable")
    rarest = order[:, 0]
    size = each[alive, rarest] * (2 * slop + 1)
    which, where = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(TRIES, int(size.sum()) + TRIES, TRIES))
    lo = 0
    for hi in [*cuts.tolist(), len(alive)]:
        hi = min(len(alive), max(hi + 1, lo + 1))
        part = slice(lo, hi)
        lo = hi
        if part.start >= part.stop:
            break
        rows, n = alive[part], each[alive[part], rarest[part]]
        k = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        at = block.lists[np.repeat(block.start[windows.matrix[rows, rarest[part]]], n) + step] - rarest[part][k]
        if slop:
            pairs = np.unique(np.stack([np.repeat(k, 2 * slop + 1), (at[:, None] + np.arange(-slop, slop + 1)).reshape(-1)], 1), axis=0)
            k, at = pairs[:, 0], pairs[:, 1]
        for j in range(0 if slop else 1, WINDOW):
            if not len(at):
                break
            offset = order[part][k, j]
            wanted = windows.matrix[rows[k], offset]
            has = wanted < 0
            for s in range(-slop, slop + 1):
                place = at + offset + s
                has |= (place >= 0) & (block.term_at[np.maximum(place, 0)] == wanted)
            k, at = k[has], at[has]
        which.append(rows[k])
        where.append(at)
    return (np.concatenate(which), np.concatenate(where)) if which else (none, none)


_SPANS = "array<struct<s:long,e:long>>"


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """doc_id, key, n_words, items (ids of items with a match) and spans ([start, end) word ranges under a match) of every row.

    ``slop`` 0: exact phrases. Above: proximity matches, every term within so many words of its place in the window,
    wherever that starts. No window, an empty index: no match, no rows.
    """
    if not 0 <= slop <= SLOP_MOST:
        raise ValueError(f"slop is from 0 to {SLOP_MOST}")
    id_field = index.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(id_field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, windows)
                counts, base = block.counts, block.base
                which, where = matches(block, windows, slop)
                doc = np.searchsorted(base, where + slop, "right") - 1  # the first term lies within slop of the start
                items: list[list[str]] = [[] for _ in counts]
                spans: list[list[dict]] = [[] for _ in counts]
                order = np.lexsort((where, doc))
                cuts = np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]])) if len(doc) else ()
                for part in np.split(order, cuts[1:]) if len(doc) else ():
                    d = int(doc[part[0]])
                    items[d] = sorted({x for k in set(which[part].tolist()) for x in windows.items[k]})
                    lo = np.clip(where[part] - base[d] - slop, 0, counts[d])
                    hi = np.maximum.accumulate(np.clip(where[part] - base[d] + windows.length[which[part]] + slop, 0, counts[d]))
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    ends = np.append(new[1:], len(lo)) - 1
                    spans[d] = [{"s": a, "e": b} for a, b in zip(lo[new].tolist(), hi[ends].tolist())]
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], id_type), pa.array(row["keys"], pa.int64()), pa.array(counts), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    ["doc_id", "key", "n_words", "items", "spans"],
                )

    rest = StructType.fromDDL(f"key long, n_words long, items array<string>, spans {_SPANS}")
    return index.mapInArrow(run, StructType([StructField("doc_id", id_field), *rest.fields]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in parts of PART_WORDS words and those that the last window needs; a window is in one part at least."""
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            own = words(text)
            cuts = range(0, max(1, len(own) - WINDOW + 1), PART_WORDS)
            found = [b" ".join(own[a : a + PART_WORDS + WINDOW - 1]).decode() for a in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(cuts, pa.int64())], ["item", "text", "at"])


def passes(tests: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Windows]:
    """The windows of the test items, in passes of about PASS_BYTES of text, dealt by hash."""
    prepare(tests.sparkSession)
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    items = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text.alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    if n == 1:
        yield Windows([(r.item, r.text.encode()) for r in items.collect()])
        return
    parts = materialize(items.mapInArrow(_parts, "item string, text string, at long"), "items")
    for k in range(n):
        yield Windows([(r.item, r.text.encode()) for r in parts.where(F.pmod(F.xxhash64("item", "at", "text"), F.lit(n)) == k).collect()])


def find(docs: DataFrame, tests: DataFrame, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, key (text hash), n_words, items (sorted as strings) and spans of words under a match.

    Nulls: a null text has no words, so no match; a test item with a null text has no window; one with a null id is
    listed under the empty string. Repeated rows are searched alike; repeated item ids are one item with all their
    windows. Empty tables: no documents, no rows; no test items, no matches. Very long texts are a block of their own.
    Ids of any type. Other columns are ignored.

    The documents are indexed once (or ``index``, an earlier :func:`build_index` of theirs, is taken). The test items go
    to the workers in passes of PASS_BYTES, so that no broadcast grows with the benchmark; every pass reads the index.
    """
    if index is None:
        index = build_index(docs, id_col, text_col)
    found = [search(index, windows, slop) for windows in passes(tests, item_col, item_text_col)]
    if len(found) == 1:
        return found[0]
    every = index.select(F.explode(F.arrays_zip("doc_ids", "keys", "n_words")).alias("r")).select(F.col("r.doc_ids").alias("doc_id"), F.col("r.keys").alias("key"), F.col("r.n_words").alias("n_words"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.where(F.size("items") > 0).groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")
    )
    hits = hits.withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = every.join(hits, every.doc_id.eqNullSafe(hits.d) & (every.key == hits.k), "left")
    return joined.select("doc_id", "key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def hit_words(spans: str = "spans"):
    """Number of words under the spans (ascending by start, maybe overlapping)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate(F.col(spans), start, step, lambda a: a["n"])


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match, all columns as they are, whatever their names.

    Rows are matched by id and text hash; only those of contaminated documents are joined back, so clean ones are kept
    whatever their ids. Null texts stay; of repeated rows all stay or all go; an empty table stays empty.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("bad_doc", "bad_key"):
        while name in taken:
            name += "_"
        names.append(name)
    hits = find(docs, tests, 0, id_col, text_col).where(F.size("items") > 0)
    bad = hits.select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])).distinct()
    key = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[names[0]]) & (key == bad[names[1]]), "left_anti")
