"""Mergeable states of latencies and users: quantile and distinct-count sketches per hour, merged over any range.

An hour's state is a few kilobytes whatever its rows, so a summary of any range reads states instead of sorting values.
The exact forms stay in :mod:`quillon.operators.metrics`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the quantile sketch (its rank error is under 1.4 %), and bits of the distinct count's buckets (its standard error is 1.6 %).
K, BUCKET_BITS = 200, 12


def hourly(events: DataFrame, keys: list[str], value: str = "value", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(keys, hour, n, total, quantiles, users): the states. Null values count in no quantile, null users in no count."""
    return events.groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("quantiles"), F.hll_sketch_agg(user, BUCKET_BITS).alias("users")
    )


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of any rows of :func:`hourly` (or of this) as one per key; without the hour."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("users").alias("users"))


def quantile(rank: float, state: str = "quantiles") -> Column:
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(state), F.lit(rank)))


def summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, p50, p95, p99, n_users) of merged states."""
    out = merged(states, keys)
    return out.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), *[quantile(r).alias(f"p{int(r * 100)}") for r in (0.5, 0.95, 0.99)], F.hll_sketch_estimate("users").alias("n_users"))
