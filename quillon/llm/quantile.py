"""Percentiles of all rows whose memory doesn't grow with them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that are counted at once; the driver receives a row for each.
BINS = 4096


def percentile(values: DataFrame, share: float, bins: int = BINS) -> float | None:
    """What Spark's exact ``percentile`` gives of the one column of ``values`` (finite doubles, none null); no rows: None.

    That function keeps a map of all distinct values in one task. Here ranges are counted, and then the ranges of the one
    that holds the wanted place, until it holds one value; ``values`` is read about five times, so it should be written.
    """
    x = values.select(F.col(f"`{values.columns[0]}`").alias("x"))
    n, low, high = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = share * (n - 1)
    k = math.floor(at)
    while low < high:
        place = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
        rows = x.where(F.col("x").between(low, high)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(rows, key=lambda r: r.b):
            if k < r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    upto, after = x.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    above = low if upto > math.ceil(at) else after
    return (1 - at % 1) * low + at % 1 * above
