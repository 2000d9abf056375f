"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one more component, sqrt(M - |x|^2) for M the greatest squared norm, all rows lie on one sphere; a query gets zero
there. Then distance^2 = |q|^2 + M - 2 * score: a window of scores is an annulus of distances, and the best scores are the
nearest rows. The top of the tree deals rows to cells, below it every block of a cell is a tree of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare
from quillon.llm.sample import smallest_hashes
from quillon.llm.store import materialize

#: Rows of a block's tree and of its leaves; rows that the vantage points of the top are chosen from; queries of a pack.
BLOCK, LEAF, SAMPLE, PACK = 8192, 256, 2000, 1024
#: No cell holds fewer sampled rows than this, so the top of the tree has 256 cells at most.
PER_CELL = 8
#: Room for rounding when distances bound scores: relative to the square of the sphere's radius.
SLACK = 1e-9
#: Below every score.
NONE = -(1 << 63) + 1


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, vec (components as floor(scale * x), longs) and row (a hash that names the row) of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; rows equal in all three count
    once. A component beyond a long is cut to a long's range.
    """
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # floor() of a double is a long; beyond its range the cast of the double saturates
    top = F.lit(float(2**62))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -top), top)).cast("long"))
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.when(~bad, whole).alias("vec"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return own.withColumn("row", F.xxhash64("vec_id", "label", "vec")).dropDuplicates(["row", "vec_id", "label"])


def _dense(vecs: list, dim: int) -> np.ndarray:
    """Rows of longs, shorter vectors padded with zeros, cut to ``dim``."""
    out = np.zeros((len(vecs), dim), np.int64)
    for i, v in enumerate(vecs):
        out[i, : min(len(v), dim)] = v[:dim]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs; beyond a long's range they are cut to it."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    most = float(max(q.max(), -float(q.min()))) * float(max(x.max(), -float(x.min()))) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    kinds = (np.int16, np.int32)
    return x.astype(next((t for t in kinds if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)), np.int64))


def _augmented(x: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(top - norms, 0.0))])


def _norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def _far(a: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - point) ** 2).sum(1), 0.0))


@dataclass
class Tree:
    """Vantage points, and each leaf's path: (vantage point, nearest and farthest distance of the leaf's rows from it)."""

    points: np.ndarray
    paths: list[list[tuple[int, float, float]]]


def grow(a: np.ndarray, leaf: int, depth: int = 64) -> tuple[Tree, list[np.ndarray]]:
    """A vantage-point tree over augmented rows, and the row numbers of its leaves. Rows that none can part share a leaf."""
    points: list[np.ndarray] = []
    leaves, paths = [], []
    todo = [(np.arange(len(a)), [])]
    while todo:
        rows, path = todo.pop()
        if len(rows) > leaf and len(path) < depth:
            far = _far(a[rows], a[rows[0]])
            point = a[rows[far.argmax()]]  # a row at the rim parts better than one in the middle
            far = _far(a[rows], point)
            middle = np.median(far)
            near = far <= middle
            if near.all():
                near = far < middle
            if near.any() and not near.all():
                at = len(points)
                points.append(point)
                for side in (near, ~near):
                    todo.append((rows[side], [*path, (at, float(far[side].min()), float(far[side].max()))]))
                continue
        leaves.append(rows)
        paths.append(path)
    return Tree(np.array(points).reshape(len(points), a.shape[1]), paths), leaves


def bounds(tree: Tree, q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each leaf can hold for each query (rows of ``q``, longs), by the triangle inequality."""
    qn = _norms(q)[:, None]
    width = max(0, tree.points.shape[1] - 1)
    inner = _padded(q, width).astype(np.float64) @ tree.points[:, :width].T if len(tree.points) else np.zeros((len(q), 0))
    away = np.sqrt(np.maximum(qn + top - 2 * inner, 0.0))
    low, high = np.zeros((len(q), len(tree.paths))), np.full((len(q), len(tree.paths)), np.inf)
    for k, path in enumerate(tree.paths):
        for at, nearest, farthest in path:
            low[:, k] = np.maximum(low[:, k], np.maximum(away[:, at] - farthest, nearest - away[:, at]))
            high[:, k] = np.minimum(high[:, k], away[:, at] + farthest)
    slack = SLACK * (qn + top) + 1
    reach = np.sqrt(qn) * np.sqrt(top)  # Cauchy-Schwarz, where no vantage point says more
    return np.maximum((qn + top - high**2) / 2, -reach) - slack, np.minimum((qn + top - low**2) / 2, reach) + slack


def _padded(q: np.ndarray, width: int) -> np.ndarray:
    return q[:, :width] if q.shape[1] >= width else np.pad(q, ((0, 0), (0, width - q.shape[1])))


@dataclass
class Queries:
    """A pack of queries: vectors, labels, own rows, a row of longs to carry, score windows, and the worst result that still counts."""

    vec: np.ndarray
    label: np.ndarray
    row: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    least_id: np.ndarray

    def take(self, at: np.ndarray) -> Queries:
        return Queries(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def _search(block: dict, q: Queries, k: int, same: bool, top: float) -> tuple[np.ndarray, ...]:
    """The first ``k`` rows of a block for each query, nearest leaves first: (query number, row number, score)."""
    tree, leaves, x = block["tree"], block["leaves"], block["vec"]
    width = max(x.shape[1], q.vec.shape[1])
    x, v = _padded(x, width), _padded(q.vec, width)
    low, high = bounds(tree, v, top)
    order = np.argsort(-high, axis=1)
    # what other blocks have found already stands for the first k until better rows push it out
    score, ids = np.repeat(q.score[:, None], k, 1), np.repeat(q.least_id[:, None], k, 1)
    rows = np.full((len(v), k), -1)
    live = np.arange(len(v))
    for step in range(len(leaves)):
        leaf = order[live, step]
        nearest = high[live, leaf]
        more = nearest >= np.maximum(score[live, -1], q.low[live])  # no later leaf is nearer
        live, leaf = live[more], leaf[more]
        if not len(live):
            break
        meets = (low[live, leaf] <= q.high[live])
        for n in np.unique(leaf[meets]):
            who = live[meets & (leaf == n)]
            at = leaves[n]
            s = products(v[who], x[at])
            ok = (block["label"][at][None] == q.label[who, None]) == same
            ok &= (s >= q.low[who, None]) & (s <= q.high[who, None]) & (s >= score[who, -1][:, None])
            if same:
                ok &= block["row"][at][None] != q.row[who, None]
            some = ok.any(1)
            who, s, ok = who[some], s[some], ok[some]
            if not len(who):
                continue
            s = np.where(ok, s, NONE)
            if s.shape[1] > k:
                ok &= s >= np.partition(s, -k, axis=1)[:, -k, None]
            i, j = np.nonzero(ok)
            of = np.concatenate([np.repeat(np.arange(len(who)), k), i])
            new = (np.concatenate([score[who].ravel(), s[i, j]]), np.concatenate([ids[who].ravel(), block["vec_id"][at][j]]), np.concatenate([rows[who].ravel(), at[j]]))
            by = np.lexsort((new[1], -new[0], of))
            first = by[np.searchsorted(of[by], np.arange(len(who)))[:, None] + np.arange(k)]
            score[who], ids[who], rows[who] = (x[first] for x in new)
    who, j = np.nonzero(rows >= 0)
    return who, rows[who, j], score[who, j]


def build(rows: DataFrame, block: int = BLOCK, leaf: int = LEAF, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """The written index (cell, part, payload: a block's tree and rows; every row is in one) and the top of the tree.

    The top's vantage points come from ``sample`` rows (smallest hashes); its distances to each cell are those of all rows.
    """
    prepare(rows.sparkSession)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dim = dim or 0
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = float(rows.agg(F.max(norm)).first()[0] or 0.0)
    some = smallest_hashes(rows.select("row"), sample)
    # a row's hash may be another's too: a few rows more are no harm
    held = rows.join(some.distinct(), "row", "left_semi").select("row", "vec").collect() if n else []
    cells = max(1, min(len(held) // PER_CELL, -(-n // block)))
    x = _dense([r.vec for r in sorted(held, key=lambda r: r.row)], dim)
    tree, _ = grow(_augmented(x, _norms(x), top), max(1, -(-len(held) // cells)))
    inner = _cell_tests(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _dense(batch.column(2).to_pylist(), dim)
            yield batch.append_column("cell", pa.array(inner(_augmented(a, _norms(a), top)), pa.int32()))

    dealt = materialize(rows.select("vec_id", "label", "vec", "row").mapInArrow(deal, "vec_id long, label long, vec array<bigint>, row long, cell int"), "vector-cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def plant(table: pa.Table) -> pa.Table:
        vec = _dense(table["vec"].to_pylist(), dim)
        a = _augmented(vec, _norms(vec), top)
        own, leaves = grow(a, leaf)
        far = [[float(f(_far(a, p))) for f in (np.min, np.max)] for p in tree.points]
        held = {"tree": own, "leaves": leaves, "vec": _narrow(vec), **{c: table[c].to_numpy() for c in ("vec_id", "label", "row")}}
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "far": pa.array([far], pa.list_(pa.list_(pa.float64()))), "payload": pa.array([pickle.dumps(held)], pa.binary())})

    index = placed.groupBy("cell", "part").applyInArrow(plant, "cell int, part int, far array<array<double>>, payload binary")
    index = materialize(index, "vector-index")
    # a cell's distances from every vantage point: at most cells^2 pairs of numbers, whatever the rows
    pair = index.select("cell", F.posexplode("far").alias("at", "x")).groupBy("cell", "at").agg(F.min(F.col("x")[0]).alias("low"), F.max(F.col("x")[1]).alias("high"))
    paths = [[] for _ in tree.paths]
    for r in pair.collect():
        paths[r.cell].append((r.at, r.low, r.high))
    there = [r.cell for r in index.select("cell").distinct().collect()]
    return index.drop("far"), {"tree": Tree(tree.points, paths), "cells": np.array(sorted(there), np.int64), "top": top, "dim": dim}


def _cell_tests(tree: Tree):
    """A function that gives each augmented row its cell: the leaf whose path it follows, by each vantage point's middle."""
    split: dict[int, float] = {}
    for path in tree.paths:
        for at, low, _ in path:
            split[at] = max(split.get(at, 0.0), low)  # the farther side's nearest row

    def run(a: np.ndarray) -> np.ndarray:
        away = {at: _far(a, tree.points[at]) for at in split}
        out = np.zeros(len(a), np.int32)
        for k, path in enumerate(tree.paths):
            on = np.ones(len(a), bool)
            for at, low, _ in path:
                on &= (away[at] >= split[at]) if low == split[at] else (away[at] < split[at])
            out[on] = k
        return out

    return run


def nearest(index: DataFrame, top: dict, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """key and the first ``k`` rows (vec_id, row, score, vec where asked for the next search) of each query.

    ``queries``: key (an array of longs, unique), vec, label, row, low and high (window of scores). ``same``: rows of the
    query's own label but itself; else rows of other labels. A query asks its nearest cell first; then only the cells
    that its window meets and that can hold more than it has, so the result is that of asking all.
    """
    spark = queries.sparkSession
    tree, there, radius, dim = top["tree"], top["cells"], top["top"], top["dim"]
    packs = "cell int, pack binary"

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), PACK):
                    part = batch.slice(at, PACK).to_pydict()
                    if not part["vec"] or not len(there):
                        continue
                    number = lambda c: np.array(part[c], np.int64)  # noqa: B023, E731
                    wide = max(dim, max(len(v) for v in part["vec"]))
                    q = Queries(_narrow(_dense(part["vec"], wide)), number("label"), number("row"), np.array(part["key"], np.int64), number("low"), number("high"), number("score"), number("least_id"))
                    low, high = bounds(tree, q.vec, radius)
                    low, high = low[:, there], high[:, there]
                    own = high.argmax(1)
                    asks = (high >= np.maximum(q.low, q.score)[:, None]) & (low <= q.high[:, None])
                    asks[np.arange(len(own)), own] = first
                    if first:
                        asks &= np.arange(len(there))[None] == own[:, None]
                    cells, found = [], []
                    for n in np.flatnonzero(asks.any(0)):
                        cells.append(int(there[n]))
                        found.append(pickle.dumps(q.take(np.flatnonzero(asks[:, n]))))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(found, pa.binary())], ["cell", "pack"])

        return run

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for pack, payload in zip(batch.column(0), batch.column(1)):
                raw = payload.as_buffer()
                if held is None or not raw.equals(held):
                    held, block = raw, pickle.loads(raw)
                q = pickle.loads(pack.as_buffer())
                who, at, score = _search(block, q, k, same, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(q.key[who]), pa.list_(pa.int64())), pa.array(block["vec_id"][at]), pa.array(block["row"][at]), pa.array(score)], ["key", "vec_id", "row", "score"]
                )

    out = "key array<bigint>, vec_id bigint, row bigint, score bigint"
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id", "row")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def asked(q: DataFrame, first: bool) -> DataFrame:
        q = q.select("key", "vec", "label", "row", "low", "high", "score", "least_id")
        sent = q.repartition(tasks).mapInArrow(route(first), packs)
        # to each block of the cell; merged, since packs are far larger than Spark takes them for, and a broadcast of them would go through the driver
        sent = sent.join(F.broadcast(parts), "cell").select("cell", "pack", F.explode("parts").alias("part"))
        return index.hint("merge").join(sent, ["cell", "part"]).select("pack", "payload").mapInArrow(ask, out)

    prepare(spark)
    queries = materialize(queries, "vector-queries")
    tasks = max(1, -(-queries.count() // PACK))
    parts = index.groupBy("cell").agg(F.collect_list("part").alias("parts"))  # a row per cell, a number per block
    start = queries.withColumn("score", F.lit(NONE)).withColumn("least_id", F.lit((1 << 63) - 1))
    near = materialize(merged(asked(start, True)), "vectors-nearest")
    full = near.where(F.col("rank") == k).select("key", F.col("score").alias("have"), F.col("vec_id").alias("have_id"))
    rest = start.hint("merge").join(full, "key", "left").withColumn("score", F.coalesce("have", "score")).withColumn("least_id", F.coalesce("have_id", "least_id"))
    return merged(near.drop("rank").union(asked(rest, False)))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    ``rows`` and ``anchors`` (some of them) as :func:`whole_vectors` gives them. An anchor's positives are its first
    ``positives`` other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, ties by smaller
    vec_id, then by the row's hash. Vectors of other lengths count as padded with zeros. A negative positive_score leaves
    no window, zero only the score zero. No rows or no anchors: no rows. Scores beyond a long are cut to its range.
    """
    index, top = build(rows, **sizes)
    whole = (1 << 63) - 1
    ask = anchors.select(F.array("row").alias("key"), "vec_id", "vec", "label", "row", F.lit(-whole).alias("low"), F.lit(whole).alias("high"))
    ask = materialize(ask, "anchors")
    best = nearest(index, top, ask, positives, True).select(F.col("key")[0].alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("row").alias("positive"), F.col("score").alias("positive_score"))
    pairs = materialize(best, "positives")
    s = F.col("positive_score").cast("decimal(38,0)")
    edge = lambda f, share: f(s * share / 100).cast("long")
    queries = pairs.join(ask.select(F.col("row").alias("anchor"), "vec", "label"), "anchor").select(
        F.array("anchor", "positive").alias("key"), "vec", "label", F.col("anchor").alias("row"), edge(F.ceil, low).alias("low"), edge(F.floor, high).alias("high")
    ).where("low <= high")
    found = nearest(index, top, queries, negatives, False)
    found = found.select(F.col("key")[0].alias("anchor"), F.col("key")[1].alias("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.join(ask.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
