"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillon.llm.arrow import prepare, texts
from quillon.llm.tokencount import PIECE, SPACES, spans, trimmed

#: The pre-tokenizer's pattern, with its white space spelt out.
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary file (tokenizers' .json, byte-level BPE, ids in the order of the merges)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in to_byte for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        for content in self.special:
            vocab.pop(content.encode(), None)
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for raw, i in vocab.items():
            token[i] = raw
        self.length = list(map(len, token))
        # the halves that a token was merged from; a byte is its own halves
        self.left, self.right = list(range(size)), list(range(size))
        self.joint: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (vocab[bytes(to_byte[c] for c in x)] for x in (a, b))
            whole = vocab[token[a] + token[b]]
            self.left[whole], self.right[whole] = a, b
            self.joint[a, b] = whole
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.machine = ahocorasick.Automaton()
        for raw, i in vocab.items():
            self.machine.add_word(raw.decode("latin-1"), i)
            for n in range(len(raw) - 1, 0, -1):
                if raw[:n] in vocab:
                    self.shorter[i] = vocab[raw[:n]]
                    break
        self.machine.make_automaton()
        # decoding: all tokens' bytes end to end, and where each begins
        for content, i in self.special.items():
            token[i] = content.encode()
        self.blob = np.frombuffer(b"".join(token), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in token])])
        self.pairs: dict[int, bool] = {}  # by both ids in one number
        self.pieces: dict[str, tuple[tuple[int, ...], str]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging would leave the two tokens side by side, from the table of pairs.

        It would not if some merge across the border comes before one that built either token: walk the border's inner
        halves, undoing the younger token each time, and look for such a merge.
        """
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is not None:
            return known
        x, y, limit, good = a, b, 1 << 40, True
        while True:
            whole = self.joint.get((x, y))
            if whole is not None and whole < limit:
                good = False
                break
            part_x, part_y = self.right[x] != x, self.left[y] != y
            if part_x and (x > y or not part_y):
                limit, x = x, self.right[x]
            elif part_y:
                limit, y = y + 1, self.left[y]  # of equal ranks the left one merges first
            else:
                break
        self.pairs[pair] = good
        return good

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: longest matches from the left, a shorter one or a step back where a pair can't stand."""
        n = len(raw)
        longest = [-1] * n
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, i in self.machine.iter(raw.decode("latin-1")):
            at = end - length[i] + 1
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        open_end = bytearray(b"\x01") * (n + 1)  # ends from which the rest may still be encoded
        out: list[int] = []
        at, trial = 0, longest[0] if n else -1
        while trial >= 0:
            end = at + length[trial]
            if open_end[end] and (not out or compatible(out[-1], trial)):
                out.append(trial)
                at = end
                trial = longest[at] if at < n else -1
            elif shorter[trial] >= 0:
                trial = shorter[trial]
            else:
                open_end[at] = 0
                trial = out.pop()
                at -= length[trial]
        return out

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        found: list[int] = []
        for w in PATTERN.findall(piece):
            ids = self.words.get(w)
            if ids is None:
                ids = tuple(self.word(w.encode()))
                if len(w) < 64:
                    self.words[w] = ids
            found += ids
        entry = (tuple(found), ",".join(map(str, found)))
        if len(piece) < 64:
            self.pieces[piece] = entry
        return entry

    def _entries(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text[at : mark.start()])
            i = self.special[mark.group()]
            yield (i,), str(i)
            at = mark.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        for run in spans(text):
            for piece in PIECE.findall(run):
                yield self.pieces.get(piece) or self._piece(piece)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimals joined by commas."""
        entries = list(self._entries(text))
        self.pieces, self.words, self.pairs = trimmed(self.pieces), trimmed(self.words), trimmed(self.pairs)
        ids = np.fromiter(chain.from_iterable(e[0] for e in entries), np.int64)
        return ids, ",".join([e[1] for e in entries])

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes end to end, gathered through the offset table."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        return self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes()


_coders: dict[str, ByteBPE] = {}


def coder(path: str) -> ByteBPE:
    if path not in _coders:
        _coders[path] = ByteBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token ids (array of int) of every whole text.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows alike; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = [bpe.encode(t)[0].astype(np.int32) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of token ids; bytes that are no UTF-8 become U+FFFD.

    Null and empty ids give the empty text; repeated rows are decoded alike; an empty table gives no rows; other columns
    are ignored.
    """
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    own = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("text", "string"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them, for every whole text.

    Encoding and decoding run in one pass, so ids don't travel. Null texts count as empty; repeated rows are encoded
    alike; an empty table gives no rows; other columns are ignored. ``path`` is at the same place on every machine.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for text in texts(batch):
                ids, listed = bpe.encode(text)
                count.append(len(ids))
                of_ids.append(sha256(listed.encode()).hexdigest())
                of_text.append(sha256(bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
