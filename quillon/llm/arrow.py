"""Arrow batches for the Python stages: bounded in rows and bytes, read without per-row conversion."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from quillon.runtime import ship_package


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and let the workers import this package."""
    ship_package(spark)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and each row's offsets into them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_bytes(items: list, sizes: list[int], limit: int) -> Iterator[list]:
    """Consecutive items in groups of about ``limit`` bytes; a larger item is a group of its own."""
    group, held = [], 0
    for item, size in zip(items, sizes):
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(item)
        held += size
    if group:
        yield group


def tidy() -> None:
    """Give memory that a task no longer uses back to the machine: a worker lives on through stages that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
