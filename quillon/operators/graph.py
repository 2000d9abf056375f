"""A navigable graph index over vectors: a layered proximity graph per part, built and searched in Arrow batches.

Vectors are dealt to parts of a bounded size by a hash of their id. A part's graph links every vector to near ones that
lie in different directions; a vector stands in layer l with probability links^-l, and each layer's vectors are linked
among themselves, so that a search comes from far in few steps. A query walks the graph of every part with a beam, its
cost per part growing with the beam rather than with the part; the parts' best are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillon.runtime import ship_package, written


@dataclass(frozen=True)
class Profile:
    """Links of a vector, neighbours looked at when they are chosen, and the beam of a search."""

    links: int
    build: int
    beam: int


# The profiles.
PROFILES = {"current": Profile(16, 100, 100), "fast": Profile(8, 64, 50), "balanced": Profile(16, 128, 100), "recall": Profile(32, 200, 200)}
#: Vectors of a part; queries that walk together.
PART, TOGETHER = 8192, 512


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _spread(x: np.ndarray, near: np.ndarray, like: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those that are nearer to it than to any taken before, ``links`` at most; -1 fills up."""
    out = np.full((len(near), links), -1, np.int32)
    for a in range(0, len(near), 256):
        cand, s = near[a : a + 256], like[a : a + 256]
        own = x[cand]
        between = np.einsum("nkd,njd->nkj", own, own)
        taken = np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), np.int64)
        for j in range(cand.shape[1]):
            best = np.where(taken, between[:, j, :], -np.inf).max(1)
            ok = (s[:, j] > best) & (count < links) & (cand[:, j] >= 0) & np.isfinite(s[:, j])
            taken[:, j] = ok
            rows = np.flatnonzero(ok)
            out[a + rows, count[rows]] = cand[rows, j]
            count[rows] += 1
    return out


def link(x: np.ndarray, profile: Profile, rng: np.random.Generator) -> np.ndarray:
    """Links (row numbers, -1 for none) of each row of unit vectors: near ones in different directions, and back links, twice ``links`` at most."""
    n, m = len(x), profile.links
    k = min(profile.build, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32)
    far = rng.integers(0, n, (n, m))  # some from anywhere: groups that lie apart stay reachable
    near, like = np.empty((n, k + m), np.int64), np.empty((n, k + m))
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        rows = np.arange(len(s))
        s[rows, a + rows] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
        every = np.concatenate([top, far[a : a + 1024]], axis=1)
        value = np.take_along_axis(s, every, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near[a : a + 1024], like[a : a + 1024] = np.take_along_axis(every, order, 1), np.take_along_axis(value, order, 1)
    out = _spread(x, near, like, m)
    start, at = np.nonzero(out >= 0)
    end = out[start, at]
    a, b = np.concatenate([start, end]), np.concatenate([end, start])
    pair = np.unique(a.astype(np.int64) * n + b)
    a, b = pair // n, pair % n
    mine = (out[a] == b[:, None]).any(1)
    order = np.lexsort((-(x[a] * x[b]).sum(1), ~mine, a))  # own links first, then the nearest back links
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < 2 * m
    links = np.full((n, 2 * m), -1, np.int32)
    links[a[keep], place[keep]] = b[keep]
    return links


def grow(x: np.ndarray, profile: Profile) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down, each (row numbers, links among them as places); the last has all rows."""
    rng = np.random.default_rng(len(x))
    height = np.floor(-np.log(1 - rng.random(len(x))) / np.log(max(2, profile.links))).astype(int)
    layers = []
    for level in range(int(height.max(initial=0)), -1, -1):
        rows = np.flatnonzero(height >= level)
        layers.append((rows, link(x[rows], profile, rng)))
    return layers


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` best places found by each query (rows of ``q``) from ``start`` on, their likeness, and how many were looked at."""
    n, m = len(x), len(q)
    who = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)  # one more place, for -1
    seen[:, n] = True
    best = np.full((m, beam), -1)
    like = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    width = min(beam, start.shape[1])
    first = start[:, :width]
    best[:, :width] = first
    like[:, :width] = np.where(first >= 0, np.einsum("md,mkd->mk", q, x[first]), -np.inf)
    done[:, :width] = first < 0
    seen[who, first] = True
    looked = (first >= 0).sum(1)
    live = np.arange(m)
    while len(live):
        open_like = np.where(done[live], -np.inf, like[live])
        at = open_like.argmax(1)
        go = open_like[np.arange(len(live)), at] > -np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        step = links[best[live, at]]
        new = (step >= 0) & ~seen[live[:, None], step]
        seen[live[:, None], np.where(new, step, n)] = True
        looked[live] += new.sum(1)
        value = np.where(new, np.einsum("md,mkd->mk", q[live], x[step]), -np.inf)
        every, all_like = np.concatenate([best[live], step], 1), np.concatenate([like[live], value], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        top = np.argpartition(-all_like, beam - 1, axis=1)[:, :beam]
        best[live], like[live], done[live] = (np.take_along_axis(z, top, 1) for z in (every, all_like, all_done))
    return best, like, looked


def descend(layers: list, x: np.ndarray, q: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of a part for each unit query, their likeness, and how many vectors were looked at."""
    start, looked = None, np.zeros(len(q), np.int64)
    for i, (rows, links) in enumerate(layers):
        place = np.full(len(x), -1)
        place[rows] = np.arange(len(rows))
        if start is None:
            start = np.repeat(np.arange(min(len(rows), 16))[None], len(q), 0)
        else:
            start = np.where(start >= 0, place[start], -1)
        last = i == len(layers) - 1
        best, like, n = _walk(x[rows], links, q, start, max(beam, k) if last else 8)
        looked += n
        start = np.where(best >= 0, rows[best], -1)
    order = np.argsort(-like, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(np.where(np.isfinite(like), start, -1), order, 1), np.take_along_axis(like, order, 1), looked


def build(vectors: DataFrame, profile: Profile, part: int = PART, n: int | None = None) -> DataFrame:
    """The index of ``vectors`` (chunk_id, doc_id, embedding): a row per part, its graph and vectors packed; a written table.

    Rows without a vector, with a component that isn't finite, or with another length than the part's first by id, are
    left out. A part is built in one task, of ``part`` rows about; its cost is part times rows.
    """
    ship_package(vectors.sparkSession)
    own = vectors.select("chunk_id", "doc_id", F.col("embedding").cast("array<double>").alias("e"))
    own = own.where("e IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    n = own.count() if n is None else n
    parts = max(1, -(-n // part))
    dealt = own.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))

    def plant(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        vec = table["e"].to_pylist()
        keep = [i for i, v in enumerate(vec) if len(v) == len(vec[0])]
        x = _unit(np.array([vec[i] for i in keep]))
        at = pa.array(keep)
        held = {"x": x.astype(np.float32), "layers": grow(x, profile), "chunk_id": table["chunk_id"].take(at).combine_chunks(), "doc_id": table["doc_id"].take(at).combine_chunks()}
        return pa.table({"part": table["part"][:1], "size": pa.array([len(keep)], pa.int64()), "graph": pa.array([pickle.dumps(held)], pa.binary())})

    return written(dealt.groupBy("part").applyInArrow(plant, "part int, size long, graph binary"), "graph")


def search(index: DataFrame, ids: DataFrame, queries: DataFrame, profile: Profile, k: int = 50) -> DataFrame:
    """(qid, chunk_id, doc_id, similarity, dense_rank, looked): about the ``k`` nearest by cosine; looked: vectors that the query was compared with, in all parts.

    ``ids``: any rows with the chunk_id and doc_id that were indexed, for their types. Queries go in packs, each against
    each part; a query of another length finds nothing in a part. Equal likeness (9 places) goes by chunk_id.
    """
    spark: SparkSession = queries.sparkSession
    ship_package(spark)
    asked = queries.where("embedding IS NOT NULL").select("qid", F.col("embedding").cast("array<double>").alias("e"))
    kinds = asked.select("qid").schema.fields + ids.select("chunk_id", "doc_id").schema.fields
    names = [to_arrow_type(f.dataType) for f in kinds]
    schema = type(asked.schema)(list(kinds)).add("similarity", "double").add("looked", "long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(a, TOGETHER)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((some.column(0), some.column(1).to_pylist()))], pa.binary())], ["pack"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, graph in zip(batch.column(0), batch.column(1)):
                qids, vec = pickle.loads(raw.as_buffer())
                held = pickle.loads(graph.as_buffer())
                x = held["x"].astype(np.float64)
                fit = [i for i, v in enumerate(vec) if len(v) == x.shape[1]]
                if not fit:
                    continue
                rows, like, looked = descend(held["layers"], x, _unit(np.array([vec[i] for i in fit])), profile.beam, k)
                i, j = np.nonzero(rows >= 0)
                at = pa.array(rows[i, j])
                yield pa.RecordBatch.from_arrays(
                    [qids.take(pa.array(np.array(fit)[i])).cast(names[0]), held["chunk_id"].take(at).cast(names[1]), held["doc_id"].take(at).cast(names[2]), pa.array(like[i, j]), pa.array(np.where(j == 0, looked[i], 0))],
                    [f.name for f in kinds] + ["similarity", "looked"],
                )

    parts = (index.agg(F.max("part")).first()[0] or 0) + 1
    packs = asked.coalesce(max(1, min(asked.rdd.getNumPartitions(), 8))).mapInArrow(pack, "pack binary")
    each = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = each.join(index, "part").select("pack", "graph").mapInArrow(walk, schema)
    every = Window.partitionBy("qid")
    ranked = found.withColumn("looked", F.sum("looked").over(every)).withColumn("dense_rank", F.row_number().over(every.orderBy(F.round("similarity", 9).desc(), "chunk_id")))
    return ranked.where(F.col("dense_rank") <= k).select("qid", "chunk_id", "doc_id", "similarity", "dense_rank", "looked")
