"""Connected components of a links table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import drop, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``-``b`` (long): root is the smallest node it can reach.

    Alternating large-star and small-star steps: neighbours' minima are pre-aggregated sums of a shuffle, and the join
    that brings them back is one that Spark can split at a hub. Each round is written to the shared folder, so lineage
    stays short. Self links, repeated and reversed links are allowed; null ends are passed over; no links, no rows.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = materialize(now, "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = materialize(large, "large-star")
        floor = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(floor, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        small = materialize(small, "small-star")
        after = _state(small)
        drop(now)
        drop(large)
        now = small
        if after == state:
            break
        state = after
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
