"""Pluggable models: columns that an outside model would compute, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings


class ColumnProvider(Protocol):
    """Adds the columns of a model to a table, with its failures as a status column and never as an exception per row."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def precomputed(table: DataFrame, key: str, columns: list[str]) -> ColumnProvider:
    """The default: columns that were computed elsewhere, joined by key; status ``missing`` where there are none."""

    def add(rows: DataFrame) -> DataFrame:
        have = table.select(key, *columns, F.lit("ok").alias("provider_status"))
        return rows.join(have, key, "left").withColumn("provider_status", F.coalesce("provider_status", F.lit("missing")))

    return add


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: share of the query's distinct tokens that the text has."""
    from quillon.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def with_fallback(rows: DataFrame, made: str, original: str, out: str) -> DataFrame:
    """A rewritten or hypothetical text where the model gave one, else the original."""
    return rows.withColumn(out, F.coalesce(F.nullif(F.trim(F.coalesce(made, F.lit(""))), F.lit("")), F.col(original)))


def retried(score: Callable[[DataFrame], DataFrame], attempts: int = 3) -> ColumnProvider:
    """A judge run again on rows that it gave no score, then 0.5."""

    def add(rows: DataFrame) -> DataFrame:
        out = score(rows)
        for _ in range(attempts - 1):
            again = score(out.where("consistency IS NULL").drop("consistency"))
            out = out.where("consistency IS NOT NULL").unionByName(again)
        return out.withColumn("consistency", F.coalesce("consistency", F.lit(0.5)))

    return add


_cached: dict[tuple, object] = {}


def cached(make: Callable[..., object], *key: object) -> object:
    """What ``make(*key)`` gives, made once in a worker's life and key (a model and its device, say)."""
    if (make, *key) not in _cached:
        _cached[(make, *key)] = make(*key)
    return _cached[(make, *key)]


def generated(rows: DataFrame, call: ColumnProvider, settings: Settings = DEFAULTS, thinking: bool = True) -> DataFrame:
    """``rows`` (with prompt_tokens) and output_tokens, answer, reasoning and status (ok, empty, overflow or connection).

    ``call`` adds content, reasoning and failure (the error's text, or null) to the rows that have room for an answer;
    the others are an overflow, and so is a failure that names the context's size. Nothing is raised for a row.
    """
    from quillon.functions.text import answer_from
    from quillon.operators.context import output_budget

    room = settings.context_window - F.col("prompt_tokens") - settings.context_margin
    fits = room >= settings.min_output_tokens
    asked = call(rows.where(fits).withColumn("output_tokens", output_budget(room, settings, thinking)))
    failure = F.lower(F.coalesce("failure", F.lit("")))
    # How model servers say that a prompt is too long.
    long = failure.rlike("(?s)exceed_context_size|exceeds the context|n_ctx|context.*(exceed|too long|maximum)|(exceed|too long|maximum).*context")
    answer = F.nullif(answer_from(F.col("content"), F.col("reasoning")), F.lit(""))
    status = F.when(long, "overflow").when(failure != "", "connection").when(answer.isNull(), "empty").otherwise("ok")
    done = asked.withColumn("status", status).withColumn("answer", F.when(F.col("status") == "ok", answer)).drop("content", "failure")
    return done.unionByName(rows.where(~fits | fits.isNull()).withColumn("status", F.lit("overflow")), allowMissingColumns=True)
