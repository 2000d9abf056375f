"""Durations of named phases: measured on the driver, appended to a log, summed up from it."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators.metrics import floor_rank

LOG = "timestamp string, phases map<string,double>, total double"


class PhaseTimer:
    """Seconds of phases; beginning one ends the one before, and leaving the ``with`` block the last."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._now: tuple[str, float] | None = None

    def start(self, phase: str) -> None:
        self.stop()
        self._now = (phase, time.perf_counter())

    def stop(self) -> float:
        """End the running phase; its seconds, 0 if none runs."""
        if self._now is None:
            return 0.0
        (phase, began), self._now = self._now, None
        self.seconds[phase] = time.perf_counter() - began
        return self.seconds[phase]

    def total(self) -> float:
        return sum(self.seconds.values())

    def reset(self) -> None:
        self.seconds, self._now = {}, None

    def __enter__(self) -> PhaseTimer:
        return self

    def __exit__(self, *error: object) -> None:
        self.stop()


def append_log(spark: SparkSession, seconds: dict[str, float], path: str, at: str | None = None) -> None:
    """One more entry of a JSON-lines log."""
    at = at or datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
    spark.createDataFrame([(at, seconds, float(sum(seconds.values())))], LOG).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path)


def log_summary(log: DataFrame) -> DataFrame:
    """(least, p50, p95, p99, most, n) of the entries' totals; no entry, no row."""
    one = log.agg(F.min("total").alias("least"), *[floor_rank("total", p).alias(f"p{p}") for p in (50, 95, 99)], F.max("total").alias("most"), F.count("total").alias("n"))
    return one.where("n > 0")


def phase_report(log: DataFrame, width: int = 20) -> DataFrame:
    """(timestamp, phase, seconds, bar): each phase's share of its entry's longest, as a bar of so many places at most."""
    each = log.select("timestamp", F.explode("phases").alias("phase", "seconds"), F.array_max(F.map_values("phases")).alias("most"))
    filled = F.when(F.col("most") > 0, F.round(F.col("seconds") / F.col("most") * width)).otherwise(0).cast("int")
    return each.select("timestamp", "phase", "seconds", F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled)).alias("bar"))


def observed(df: DataFrame, **measures: Column) -> tuple[dict[str, object], float]:
    """Run ``df`` to nowhere: what the aggregates ``measures`` were over its rows, taken while they passed, and the seconds."""
    told = Observation()
    watched = df.observe(told, *[c.alias(name) for name, c in measures.items()])
    began = time.perf_counter()
    watched.write.format("noop").mode("overwrite").save()
    return told.get, time.perf_counter() - began
