"""Batch inference: a model's vectors as columns, one model a worker, failures as a column; and an encoder without a model.

The encoder is deterministic: every distinct token of a text adds its count, with a sign, to one of ``dim`` places, both by its
MD5; the sum has length one. It stands where a trained model would, so that texts can be searched without any.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from quillon.functions.text import tokens
from quillon.providers import ColumnProvider, cached
from quillon.runtime import ship_package

#: Texts that a model gets at once.
BATCH = 64

#: A model: texts in, a matrix with a row for each out. It may raise for a batch; its texts are then tried one by one.
Model = Callable[[list[str]], np.ndarray]

_ENCODED = StructType([StructField("vector", ArrayType(DoubleType())), StructField("failure", StringType())])


class HashingEncoder:
    """Vectors of space-joined tokens, as the module says; a text without tokens is all zeros."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for token in text.split(" "):
                if token:
                    digest = int(md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                    row[digest // 2 % self.dim] += 1 - 2 * (digest % 2)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _guarded(model: Model, dim: int) -> Callable[[np.ndarray], dict[str, np.ndarray]]:
    def one_by_one(texts: list[str]) -> tuple[list[np.ndarray], list[str | None]]:
        rows, failures = [], []
        for text in texts:
            try:
                rows.append(np.asarray(model([text]), float).reshape(dim))
                failures.append(None)
            except Exception as error:  # a row's failure is a value, whatever the model raises
                rows.append(np.full(dim, np.nan))
                failures.append(f"{type(error).__name__}: {error}")
        return rows, failures

    def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
        given = [t for t in texts if t is not None]
        try:
            rows, failures = list(np.asarray(model(given), float).reshape(len(given), dim)), [None] * len(given)
        except Exception:
            rows, failures = one_by_one(given)
        found = iter(zip(rows, failures))
        every = [(np.full(dim, np.nan), "no text") if t is None else next(found) for t in texts]
        return {"vector": np.stack([v for v, _ in every]), "failure": np.array([f for _, f in every], dtype=object)}

    return predict


def encoder(make: Callable[..., Model], *key: object, dim: int, text_col: str = "text", out: str = "embedding", batch: int = BATCH) -> ColumnProvider:
    """Adds ``out`` (a vector, null where there is none) and failure (null, ``no text``, or the model's error) to a table.

    ``make(*key)`` is called once in a worker's life. Nothing is raised for a row: of a batch that fails every text is
    tried by itself, so one bad text costs the others nothing but time.
    """

    def start() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        return _guarded(cached(make, *key), dim)

    def add(rows: DataFrame) -> DataFrame:
        ship_package(rows.sparkSession)
        told = rows.withColumn("__told", predict_batch_udf(start, return_type=_ENCODED, batch_size=batch)(F.col(text_col)))
        vector = F.when(F.col("__told.failure").isNull(), F.col("__told.vector"))
        return told.withColumn(out, vector).withColumn("failure", F.col("__told.failure")).drop("__told")

    return add


def hashed(rows: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = 256) -> DataFrame:
    """``rows`` with the deterministic encoder's ``out`` and failure; a null text has none, a text without tokens the zero vector."""
    joined = rows.withColumn("__tokens", F.when(F.col(text_col).isNotNull(), F.array_join(tokens(F.col(text_col)), " ")))
    return encoder(HashingEncoder, dim, dim=dim, text_col="__tokens", out=out)(joined).drop("__tokens")
