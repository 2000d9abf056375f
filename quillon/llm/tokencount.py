"""Token counts with a public tokenizer's own library, in Arrow batches that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import by_bytes, prepare, texts

#: White space as the byte-level pre-tokenizer sees it (the Unicode property).
SPACES = "\t-\r \x85\xa0  -     　"
#: A text may be cut before white space that follows something else: no pre-token spans such a place, and none looks back.
PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_CUT = re.compile(f"[^{SPACES}](?=[{SPACES}])")
#: Characters after which a long text is split; bytes of text per library call; entries that a memo keeps.
SPAN, CALL, KNOWN = 1 << 18, 1 << 18, 300_000


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in runs of about ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text) or not text:
        yield text[at:]


def trimmed(known: dict) -> dict:
    """The same up to ``KNOWN`` entries; beyond, the half that came first, which has the frequent ones."""
    return known if len(known) <= KNOWN else dict(islice(known.items(), KNOWN // 2))


class Counter:
    """Lengths under one tokenizer file by its library, special strings inside texts handled as its default.

    ``.json`` is tokenizers', ``.model`` sentencepiece's. Long texts are split at safe boundaries where the file is
    byte-level, whose pre-tokens never span them; the others see every text whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda group: list(map(len, model.encode(group, num_threads=1)))
            self.split = False
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda group: list(map(len, tokenizer.encode_batch_fast(group, add_special_tokens=False)))
            self.split = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"

    def counts(self, batch: list[str], n_bytes: list[int]) -> list[int]:
        """Tokens of each text, in library calls of about CALL bytes each."""
        of, runs, sizes = [], [], []
        total = [0] * len(batch)
        for i, (text, size) in enumerate(zip(batch, n_bytes)):
            if self.split and size > SPAN:
                for run in spans(text):
                    of.append(i)
                    runs.append(run)
                    sizes.append(len(run.encode()))
            elif text:
                of.append(i)
                runs.append(text)
                sizes.append(size)
        at = iter(of)
        for group in by_bytes(runs, sizes, CALL):
            for n in self.lengths(group):
                total[next(at)] += n
        return total


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text, null as empty (0 and 0).

    ``path`` is the tokenizer file, at the same place on every machine. Arrow batches are bounded by bytes and cut into
    calls of equal bytes; whole texts of any length are counted, and only lengths leave the worker. Repeated rows and
    ids count alike; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.counts(texts(batch), batch.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return own.mapInArrow(run, own.select("doc_id", "n_bytes").schema.add("n_tokens", "long"))
