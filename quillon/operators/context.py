"""Packing ranked chunks into a model's context window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings


def render_chunk(index: Column, doc_id: Column, heading: Column, line_start: Column, line_end: Column, text: Column) -> Column:
    """A chunk as the prompt shows it."""
    word = lambda c, default: F.coalesce(c.cast("string"), F.lit(default))
    return F.concat(
        F.lit("["), index.cast("string"), F.lit("] Fuente: "), word(doc_id, "N/A"), F.lit(" | Sección: "), word(heading, "Sin encabezado"),
        F.lit(" | Líneas: "), word(line_start, "N/A"), F.lit("-"), word(line_end, "N/A"), F.lit("\n---\n"), word(text, ""), F.lit("\n"),
    )


def estimate(tokens: Column, factor: float = DEFAULTS.estimate_factor) -> Column:
    """A careful token estimate."""
    return F.floor(tokens * factor).cast("long") + 1


def pack(hits: DataFrame, base_tokens: Column, settings: Settings = DEFAULTS, tokens: str = "n_tokens") -> DataFrame:
    """Greedy packing in rank order; a chunk that doesn't fit is left out and later, smaller ones may still fit.

    ``hits``: qid, pos, chunk_id and ``tokens`` (of the rendered chunk). Returns qid, used and dropped (chunk ids in
    order), prompt_tokens, output_tokens and status (ok, base_too_large or no_room); a status instead of an exception.
    """
    budget = settings.context_window - settings.context_margin - settings.min_output_tokens
    cost = F.struct("pos", "chunk_id", estimate(F.col(tokens)).alias("cost"))
    rows = hits.withColumn("base", base_tokens.cast("long")).groupBy("qid", "base").agg(F.array_sort(F.collect_list(cost)).alias("list"))
    kind = hits.schema["chunk_id"].dataType.simpleString()
    start = F.struct(F.col("base").alias("run"), F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<{kind}>").alias("dropped"))

    def step(a: Column, x: Column) -> Column:
        fits = a["run"] + x["cost"] <= budget
        return F.when(
            fits, F.struct((a["run"] + x["cost"]).alias("run"), F.array_append(a["used"], x["chunk_id"]).alias("used"), a["dropped"].alias("dropped"))
        ).otherwise(F.struct(a["run"].alias("run"), a["used"].alias("used"), F.array_append(a["dropped"], x["chunk_id"]).alias("dropped")))

    done = rows.withColumn("p", F.aggregate("list", start, step))
    room = settings.context_window - settings.context_margin - F.col("p.run")
    status = F.when(F.col("base") > budget, "base_too_large").when(room < settings.min_output_tokens, "no_room").otherwise("ok")
    return done.select("qid", F.col("p.used").alias("used"), F.col("p.dropped").alias("dropped"), F.col("p.run").alias("prompt_tokens"), output_budget(room, settings).alias("output_tokens"), status.alias("status"))


def output_budget(room: Column, settings: Settings = DEFAULTS, thinking: bool = True) -> Column:
    """Tokens that an answer may have: the wish (times four with thinking), as far as there is room."""
    wish = settings.answer_tokens * (settings.thinking_multiplier if thinking else 1)
    return F.least(F.lit(wish).cast("long"), room)
