"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare, texts
from quillon.llm.quantile import percentile
from quillon.llm.store import drop, materialize

#: Dimensions of a hypervector, letters of an n-gram, seed of the random letter vectors.
DIMS, GRAM, SEED = 512, 3, 20240607
#: Texts are read in windows of so many characters, n-grams run on from one to the next.
WINDOW = 1 << 20
#: Count tables and vector tables are flushed or rebuilt beyond so many entries.
TABLE = 40_000
#: N-grams of a text that can be rejected by its score, at least: the cosines of shorter ones say little.
REJECT_GRAMS = 100
SPACE = 32


class _Memory:
    """What a worker keeps between tasks: letter classes, letter vectors and n-gram vectors."""

    def __init__(self) -> None:
        self.vector: dict[int, np.ndarray] = {}
        self.slot: dict[int, int] = {}
        self.table = np.empty((TABLE, DIMS), np.int8)
        self.used = 0
        self.lookup: np.ndarray | None = None


_held: list[_Memory] = []


def _memory() -> _Memory:
    if not _held:
        _held.append(_Memory())
    return _held[0]


def _letter_vector(point: int) -> np.ndarray:
    """The random sign vector of a letter: the same on every worker."""
    known = _memory().vector
    if point not in known:
        known[point] = np.random.default_rng([SEED, point]).integers(0, 2, DIMS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return known[point]


def _classes() -> np.ndarray:
    """1 for the code points that are letters."""
    m = _memory()
    if m.lookup is None:
        m.lookup = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return m.lookup


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes (GRAM code points, 21 bits each) of the lower-cased text with their counts.

    Runs of other characters count as one space, and a space stands at both ends. No letter: none.
    """
    found, counts = [], []
    text = text.lower()
    tail, before = np.full(1, SPACE, np.uint64), False  # what the next window goes on from
    for at in range(0, len(text), WINDOW):
        points = np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _classes()[points]
        keep = letter.copy()
        keep[0] |= before
        keep[1:] |= letter[:-1]
        before = bool(letter[-1])
        seq = np.concatenate([tail, np.where(letter, points, SPACE).astype(np.uint64)[keep]])
        if at + WINDOW >= len(text) and before:
            seq = np.append(seq, np.uint64(SPACE))
        tail = seq[-2:]
        if len(seq) >= GRAM:
            codes = (seq[:-2] << np.uint64(42)) | (seq[1:-1] << np.uint64(21)) | seq[2:]
            u, c = np.unique(codes, return_counts=True)
            found.append(u)
            counts.append(c)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0], counts[0]
    u, back = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bind the permuted letter vectors of each n-gram: rotate by position, multiply."""
    mask = np.uint64((1 << 21) - 1)
    parts = [(codes >> np.uint64(42)) & mask, (codes >> np.uint64(21)) & mask, codes & mask]
    out = None
    for turn, points in zip((2, 1, 0), parts):
        u, back = np.unique(points, return_inverse=True)
        vectors = np.stack([np.roll(_letter_vector(int(p)), turn) for p in u])[back]
        out = vectors if out is None else out * vectors
    return out


def _rows_of(codes: np.ndarray) -> np.ndarray:
    """Vectors of the codes, from the worker's table as far as it holds them."""
    m = _memory()
    if len(codes) > TABLE // 2:
        return _gram_vectors(codes)
    known = m.slot
    listed = codes.tolist()
    at = [known.get(c, -1) for c in listed]
    new = [c for c, k in zip(listed, at) if k < 0]
    if new:
        if m.used + len(new) > TABLE:
            m.slot, m.used = {}, 0
            known = m.slot
            new = listed
        m.table[m.used : m.used + len(new)] = _gram_vectors(np.array(new, np.uint64))
        known.update(zip(new, range(m.used, m.used + len(new))))
        m.used += len(new)
        at = [known[c] for c in listed]
    return m.table[at]


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count-weighted sum of the n-gram vectors, exact in double precision."""
    out = np.zeros(DIMS)
    for i in range(0, len(codes), 8192):
        rows = _rows_of(codes[i : i + 8192])
        part = counts[i : i + 8192]
        if part.sum() < 1 << 23:  # exact in single precision
            out += part.astype(np.float32) @ rows.astype(np.float32)
        else:
            out += part.astype(np.float64) @ rows.astype(np.float64)
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    held: dict[str, list] = {}
    room: dict[str, int] = {}

    def flush(lang: str) -> None:
        pairs = held.pop(lang, [])
        room.pop(lang, None)
        if pairs:
            u, back = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            total = bundle(u, np.bincount(back, np.concatenate([p[1] for p in pairs])))
            sums[lang] = sums.get(lang, 0) + total

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            u, c = grams(text)
            if len(u):
                held.setdefault(lang, []).append((u, c))
                room[lang] = room.get(lang, 0) + len(u)
                if room[lang] > 500_000:
                    flush(lang)
    for lang in list(held):
        flush(lang)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * DIMS, "dim": pa.array(range(DIMS), pa.int32()), "value": pa.array(total, pa.float64())})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all n-grams of a language's texts.

    Rows with a null text or language are passed over. The driver receives languages x DIMS numbers, however many rows
    there are; sums are of whole numbers, so they don't depend on the order of the tasks.
    """
    prepare(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    cells = labelled.mapInArrow(_profile, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in cells.toPandas().itertuples(index=False):
        out.setdefault(lang, np.zeros(DIMS))[dim] = value
    return dict(sorted(out.items()))


def _judged(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns under the names __k0, __k1, ..., with __lang_pred, __score and __n (n-grams)."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    if names:
        matrix = np.stack([prototypes[n] for n in names])
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, sizes = [], [], []
            for text in texts(batch, "__text"):
                u, c = grams(text)
                sizes.append(int(c.sum()))
                if not len(u) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = bundle(u, c)
                cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "__lang_pred", "__score", "__n"])

    own = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("__text"))
    return own.mapInArrow(judge, own.drop("__text").schema.add("__lang_pred", "string").add("__score", "double").add("__n", "long"))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine with the winning prototype, 0 at least) of every row's whole text.

    A null text, one without a letter, or no prototypes at all: ``und`` with score 0. Ties go to the first language in
    alphabetical order. Repeated rows are judged alike; an empty table gives no rows. Prototypes: languages x DIMS.
    """
    out = _judged(docs, prototypes, text_col, [id_col])
    return out.select(F.col("__k0").alias("doc_id"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def rejection(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang") -> float:
    """The score below which a text is in none of the languages: half of what all but a hundredth of labelled texts reach.

    Judged are all labelled rows (equal rows count each), by the cosine with the language that they win, those of
    REJECT_GRAMS at least. Rows with a null text or language don't count; no such row, no prototypes: 0, nothing is
    rejected. The scores alone are written, once.
    """
    labelled = docs.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    scores = _judged(labelled, prototypes, text_col, []).where((F.col("__lang_pred") != "und") & (F.col("__n") >= REJECT_GRAMS))
    scores = materialize(scores.select("__score"), "language-scores")
    least = 0.5 * (percentile(scores, 0.01) or 0.0)
    drop(scores)
    return least


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language, with a score of ``least`` at least; all columns as they are, whatever their names.

    Null texts and texts without a letter have none, and go; texts under REJECT_GRAMS don't go by their score; repeated rows are judged alike; an empty table stays empty.
    Without prototypes no row can be judged, and all stay.
    """
    if not prototypes:
        return docs
    out = _judged(docs, prototypes, text_col, docs.columns).where((F.col("__lang_pred") != "und") & ((F.col("__score") >= least) | (F.col("__n") < REJECT_GRAMS)))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])
