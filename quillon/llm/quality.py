"""Quality classifier: random-indexing word vectors of the whole corpus, pooled per document, under a two-layer network in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare, texts
from quillon.llm.sample import smallest_hashes
from quillon.llm.store import drop, materialize
from quillon.llm.tokencount import trimmed

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 8000
#: Tasks that sum word contexts, at most.
SUM_TASKS = 2048
#: Word slots, dimensions, non-zero entries of an index vector, neighbours on each side, hidden units, seed.
SLOTS, DIMS, ONES, REACH, HIDDEN, SEED = 1 << 14, 64, 8, 2, 32, 20240613
#: Tokens of a text that are pooled at once; length of a pooled row.
SPAN, FEATURES = 1 << 18, 2 * DIMS + 4

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_slots: dict[str, int] = {}


def _slot(token: str) -> int:
    """Slot of a token: its lower-cased letters and whether it is in capitals."""
    shape = "^" if len(token) > 1 and token.isupper() else ""
    return crc32((shape + token.lower()).encode("utf-8", "replace")) % SLOTS


def slots(text: str) -> np.ndarray:
    """Slots of the text's words and runs of signs, in order."""
    global _slots
    tokens = _TOKEN.findall(text)
    known = _slots
    out = [known.get(t, -1) for t in tokens]
    for i, s in enumerate(out):
        if s < 0:
            out[i] = known[tokens[i]] = _slot(tokens[i])
    _slots = trimmed(known)
    return np.array(out, np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each slot's sparse ternary index vector: fixed random values."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((SLOTS, DIMS)), axis=1)[:, :ONES]
    return places, rng.integers(0, 2, (SLOTS, ONES)) * 2.0 - 1.0


def context_sums(sequences: list[np.ndarray]) -> np.ndarray:
    """Sum of the neighbours' index vectors for each slot, over all its occurrences."""
    places, signs = index_vectors()
    total = np.zeros(SLOTS * DIMS)
    for reach in range(1, REACH + 1):
        left = np.concatenate([s[:-reach] for s in sequences] or [np.zeros(0, np.int32)]).astype(np.int64)
        right = np.concatenate([s[reach:] for s in sequences] or [np.zeros(0, np.int32)]).astype(np.int64)
        for centre, near in ((left, right), (right, left)):
            for k in range(ONES):
                total += np.bincount(centre * DIMS + places[near, k], signs[near, k], SLOTS * DIMS)
    return total.reshape(SLOTS, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors; a slot that was never seen has its own index vector."""
    places, signs = index_vectors()
    own = np.zeros((SLOTS, DIMS))
    np.put_along_axis(own, places, signs, 1)
    seen = np.abs(sums).sum(1, keepdims=True) > 0
    out = np.where(seen, sums, own)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, the mean's length, how alike neighbours and next neighbours are, and the logarithm of the number of words; zeros without a word."""
    if not len(ids):
        return np.zeros(FEATURES)
    first, second, alike = np.zeros(DIMS), np.zeros(DIMS), np.zeros(2)
    for i in range(0, len(ids), SPAN):
        rows = vectors[ids[i : i + SPAN]]
        first += rows.sum(0, dtype=np.float64)
        second += np.einsum("ij,ij->j", rows, rows)
        for k in (1, 2):
            alike[k - 1] += np.einsum("ij,ij->", rows[:-k], rows[k:])
    mean = first / len(ids)
    return np.concatenate([mean, np.sqrt(np.maximum(second / len(ids) - mean**2, 0)), [np.linalg.norm(mean)], alike / len(ids), [np.log1p(len(ids))]])


@dataclass
class Network:
    """Two layers over standardised features, with the temperature that calibrates its logits. Fixed size."""

    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.shift) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -50, 50)))


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray, epochs: int = 60) -> Network:
    """Adam on the logistic loss over four fifths; the temperature with the least loss on the last fifth.

    Without rows of both labels: a constant network, at the smoothed share of label 1.
    """
    rng = np.random.default_rng(SEED)
    n, d = features.shape
    shift, scale = (features.mean(0), features.std(0) + 1e-6) if n else (np.zeros(d), np.ones(d))
    w1, b1 = rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = np.zeros(HIDDEN), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    net = Network(vectors, shift, scale, w1, b1, w2, b2, 1.0)
    if len(np.unique(labels)) < 2 or n < 10:
        return net
    order = rng.permutation(n)
    held, fit = order[: n // 5], order[n // 5 :]
    x, y = (features - shift) / scale, labels.astype(np.float64)
    w2[:] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    params = [w1, b1, w2, np.array([b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), 128):
            b = fit[i : i + 128]
            hidden = np.tanh(x[b] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -50, 50))) - y[b]) / len(b)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            grads = [x[b].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.second_bias = float(params[3][0])
    logits, grid = net.logits(features[held]), np.geomspace(0.25, 16, 49)
    losses = [np.mean(np.logaddexp(0, -np.where(y[held] == 1, logits, -logits) / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


_SUMS = "slot int, sums binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's context sums, one row for each slot that it has."""
    total = np.zeros((SLOTS, DIMS))
    for batch in batches:
        total += context_sums([slots(t) for t in texts(batch)])
    used = np.flatnonzero(np.abs(total).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([r.tobytes() for r in total[used]], pa.binary())], ["slot", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some slots, each added up: whole numbers, so their order doesn't matter."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[slot] = total.get(slot, 0.0) + np.frombuffer(sums, np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "sums"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_ROWS) -> Network:
    """Word contexts of all documents, and a network fitted on the labelled rows with the ``limit`` smallest id hashes.

    Labels: the largest of an id's non-null labels; rows without one, and ids that are null, are passed over. Of rows
    with one id, the text with the smallest hash is the labelled one. Everything about the model has a fixed size: word
    contexts are summed on the executors (SLOTS rows reach the driver), features are pooled there too, and the driver
    trains on ``limit`` short rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    named = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    graded = named.groupBy("k").agg(F.max("y").alias("y"))
    chosen = graded.join(F.broadcast(smallest_hashes(graded.select("k"), limit)), "k")
    sample = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "k")
    first = Window.partitionBy("k").orderBy(F.xxhash64("text"), "text")
    sample = sample.withColumn("n", F.row_number().over(first)).where("n = 1").repartition(8).select("k", "text", "y")
    sample = materialize(sample, "quality-sample")
    sums = np.zeros((SLOTS, DIMS))
    # a task sends SLOTS rows at most, whatever it reads: of many splits several go through one task, so that what is sent stays bounded
    every = docs.select(F.col(text_col).cast("string").alias("text")).coalesce(SUM_TASKS).mapInArrow(_contexts, _SUMS).repartition(8, "slot").mapInArrow(_summed, _SUMS)
    for row in every.toPandas().itertuples(index=False):
        sums[row.slot] = np.frombuffer(row.sums, np.float64)
    vectors = word_vectors(sums)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = [pool(slots(t), vectors).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pooled, pa.binary())], ["k", "y", "f"])

    rows = sample.mapInArrow(features, sample.select("k", "y").schema.add("f", "binary")).toPandas().sort_values("k")
    table = np.stack([np.frombuffer(f, np.float64) for f in rows["f"]]) if len(rows) else np.zeros((0, FEATURES))
    drop(sample)
    return train(table, rows["y"].to_numpy(np.int64), vectors)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1: how likely label 1 is) of every whole text; null counts as empty and is scored too.

    Repeated rows have equal scores, ties in score stay ties; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = texts(batch)
            pooled = np.stack([pool(slots(t), net.vectors) for t in own]) if own else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(pooled), pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, own.select("doc_id").schema.add("score", "double"))
