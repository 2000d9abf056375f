"""Bounded samples that don't depend on the order or the number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(keys: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` rows of ``keys`` with the smallest hash, ties by the keys themselves.

    Of many rows, only those below a bound that about twice as many pass are sorted, so that what reaches the one task
    that cuts them off doesn't grow with the input. Nulls are keys like any other; no rows, no rows.
    """
    names = [f"`{c}`" for c in keys.columns]
    hashed = keys.withColumn("h", F.xxhash64(*names))
    n = keys.count()
    if n > 4 * limit:
        below = hashed.where(F.col("h") < -(1 << 63) + (1 << 64) * 2 * limit // n)
        if below.count() >= limit:
            hashed = below
    return hashed.orderBy("h", *names).limit(limit).drop("h")
