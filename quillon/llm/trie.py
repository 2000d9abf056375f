"""Prefix trie of conversations: owners by binary search over prefix digests, chains of owned nodes, sums from the leaves up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.arrow import prepare
from quillon.llm.store import drop, materialize

#: Turns of a conversation that one group of a window holds; conversation ids of one piece of a list of ids.
SPAN, PIECE = 4096, 4096
KEY = ["depth", "d1", "d2"]


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, i (from 1), role, sha (of the text, 32 bytes) and chars (code points of the text) of every turn.

    Turns are in order of ``turn``, null first, ties by role, then by the text's SHA-256; null role or text counts as
    empty, repeated rows are turns of their own, rows with a null conv_id take no part. Rows are lined up by ranges, and
    a range's place within its conversation is added: a conversation may be of any length.
    """
    col = lambda c: F.col(f"`{c}`")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    slim = rows.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.length(text).cast("long").alias("chars"),
    )
    line = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    ranged = materialize(slim.repartitionByRange(*line).withColumn("range", F.spark_partition_id()), "turns-ranged")
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).where("offset > 0")
    within = Window.partitionBy("conv_id", "range").orderBy(*line[1:])
    placed = ranged.withColumn("i", F.row_number().over(within)).join(offset, ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("i") + F.coalesce("offset", F.lit(0))).alias("i"), "role", "sha", "chars")


def branched(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: (conv_id, turns), and (conv_id, depth, role, sha, chars).

    Each takes the first ``head`` turns of conversation ``base`` (both of conv_id; all if fewer, none if absent), then its
    own turns after its first ``head``.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", base).withColumn("head", head)
    most = own.select("conv_id", F.col("n").alias("base_n")).withColumnRenamed("conv_id", "base")
    heads = own.join(most, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    heads = materialize(heads, "branches")
    convs = heads.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("turns"))
    late = turns.join(heads.select("conv_id", "head", "taken"), "conv_id").where("i > head")
    late = late.select("conv_id", (F.col("i") - F.col("head") + F.col("taken")).alias("depth"), "role", "sha", "chars")
    first = turns.select(F.col("conv_id").alias("base"), "i", "role", "sha", "chars")
    asked = heads.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("i"))
    early = asked.join(first, ["base", "i"]).select("conv_id", F.col("i").alias("depth"), "role", "sha", "chars")
    return convs, early.union(late)


def _running(df: DataFrame, by: str, at: str, sums: dict[str, Column], down: bool = False) -> DataFrame:
    """``df`` with running aggregates over ``at`` within ``by``, in spans of SPAN so that a long group is split.

    ``sums``: name to the aggregate of a column of that name, one that combines partial results (bit_xor, sum).
    """
    way = (lambda c: F.col(c).desc()) if down else F.col
    spanned = df.withColumn("span", F.floor(F.col(at) / SPAN))
    inner = Window.partitionBy(by, "span").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, 0)
    total = spanned.groupBy(by, "span").agg(*[f.alias(c) for c, f in sums.items()])
    before = Window.partitionBy(by).orderBy(way("span")).rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(by, "span", *[f.over(before).alias(f"before_{c}") for c, f in sums.items()]).where(" OR ".join(f"before_{c} IS NOT NULL" for c in sums))
    done = spanned.select(*[c for c in spanned.columns if c not in sums], *[f.over(inner).alias(c) for c, f in sums.items()])
    return done.join(carried, [by, "span"], "left")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, d1, d2 (128 bits of digest of the first ``depth`` turns) and chars of the last of them.

    The digest is the exclusive or of the hashes of (depth, role, text digest), so that parts of it combine.
    """
    own = rebuilt.select("conv_id", "depth", "chars", F.xxhash64("depth", "role", "sha").alias("d1"), F.xxhash64("sha", "role", "depth", F.lit(1)).alias("d2"))
    run = _running(own, "conv_id", "depth", {"d1": F.bit_xor("d1"), "d2": F.bit_xor("d2")})
    both = lambda c: F.col(c).bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0).cast("long"))).alias(c)
    return run.select("conv_id", "depth", both("d1"), both("d2"), "chars")


def first_owned(convs: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, turns and first: the least depth whose prefix has no smaller conversation; turns + 1 where there is none.

    Owned depths are the last ones of a conversation, so they are found by binary search: every open conversation asks
    for the middle of its range in one batch, by two joins a round (its prefix, then that prefix's minimum).
    """
    state = materialize(convs.select("conv_id", "turns", F.lit(1).cast("long").alias("lo"), (F.col("turns") + 1).alias("hi")), "owners")
    while True:
        state_open = state.where("lo < hi")
        if state_open.isEmpty():
            return state.select("conv_id", "turns", F.col("lo").alias("first"))
        asks = state_open.withColumn("depth", F.expr("(lo + hi) div 2")).join(paths.select("conv_id", *KEY), ["conv_id", "depth"])
        told = asks.join(nodes.select(*KEY, "owner"), KEY)
        own = F.col("owner") == F.col("conv_id")
        told = told.select("conv_id", "turns", F.when(own, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(own, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        after = materialize(state.where("lo >= hi").union(told), "owners")
        drop(state)
        state = after


def _id_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of the ids (``conv_id``) that end at each node, ascending and comma-joined.

    Ids meet in pieces of PIECE neighbouring ids first; a node's pieces, in order, go through one running hash.
    """
    prepare(ends.sparkSession)
    piece = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    line = piece.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (owner, depth) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (owner, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _ends(out)
        if key is not None:
            yield _ends([(*key, digest.hexdigest())])

    return line.select("owner", "depth", "ids").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def _ends(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["owner", "depth", "ends_sha256"])


def trie(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: (conv_id, turns) of every conversation; ``rebuilt``: its turns (conv_id, depth from 1, role, sha, chars).
    Nodes are the distinct sequences of first turns, from the root (depth 0; a row of its own unless there are no
    conversations). n_leaves counts the childless nodes of the subtree, saved_tokens sums (n_convs - 1) * chars over it.

    A conversation's owned nodes (those of which it is the smallest member) form a chain, which hangs on another
    conversation's node or on the root. Chains without open branches give their sums to the node they hang on, round
    after round: as many rounds as chains hang on one another, each by a sum that combines before its shuffle.
    """
    paths = materialize(prefixes(rebuilt), "prefixes")
    nodes = materialize(paths.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")), "trie-nodes")
    owned = materialize(first_owned(convs, paths, nodes), "first-owned")
    least, n_all = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    least = F.lit(least).cast("long")

    # chain conv_id: depths first to turns; it hangs on node (up, depth first - 1), null for the root
    chains = owned.where("first <= turns")
    above = chains.where("first > 1").withColumn("depth", F.col("first") - 1).join(paths.select("conv_id", *KEY), ["conv_id", "depth"]).join(nodes.select(*KEY, F.col("owner").alias("up")), KEY)
    hung = above.select("conv_id", "first", "turns", "up").union(chains.where("first = 1").select("conv_id", "first", "turns", F.lit(None).cast("long").alias("up")))
    hung = materialize(hung, "chains")
    below = materialize(hung.groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hanging")), "hanging")
    own = nodes.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = own.join(hung.select(F.col("conv_id").alias("owner"), "turns"), "owner").join(below, ["owner", "depth"], "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("turns")).cast("long")
    own = materialize(own.select("owner", "depth", "n_convs", children.alias("n_children"), "saved", (children == 0).cast("long").alias("leaves")), "own-nodes")

    # sums of whole chains, from those without branches up; what hangs on each node is kept for the sums within a chain
    open_ = hung.join(own.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "conv_id")
    open_ = materialize(open_.select("conv_id", F.col("first"), "up", "saved", "leaves"), "open-chains")
    plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    given = []
    while not open_.isEmpty():
        ups = open_.select(F.col("up").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
        done = open_.join(ups, "conv_id", "left_anti").groupBy("up", "first").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        done = materialize(done, "chain-sums")
        given.append(done)
        more = done.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        rest = open_.join(ups, "conv_id", "left_semi").join(more, "conv_id", "left")
        after = materialize(rest.select("conv_id", "first", "up", plus("saved"), plus("leaves")), "open-chains")
        drop(open_)
        open_ = after
    hanging = own.select(F.col("owner"), "depth", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves")).limit(0)
    for done in given:
        hanging = hanging.union(done.select(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth"), "saved", "leaves"))
    hanging = materialize(hanging.groupBy("owner", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")), "hanging-sums")

    with_all = own.join(hanging, ["owner", "depth"], "left").select("owner", "depth", "n_convs", "n_children", plus("saved"), plus("leaves"))
    sums = _running(with_all, "owner", "depth", {"saved": F.sum("saved"), "leaves": F.sum("leaves")}, down=True)
    total = lambda c: (F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).alias(c)
    sums = sums.select("owner", "depth", "n_convs", "n_children", total("saved"), total("leaves"))
    up = hung.select(F.col("conv_id").alias("owner"), "first", "up")
    parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.coalesce(F.col("up"), least))
    inner = sums.join(up, "owner").select("owner", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "leaves", "saved")
    # the root's own row: what hangs on it is one row of each sum
    top = hanging.where("owner IS NULL").first()
    count = below.where("owner IS NULL").first()
    values = {"depth": 0, "parent_conv_id": None, "n_convs": n_all, "n_children": count.hanging if count else 0, "leaves": top.more_leaves if top else 1, "saved": top.more_saved if top else 0}
    roots = convs.sparkSession.range(1 if n_all else 0).select(least.alias("owner"), *[F.lit(v).cast("long").alias(c) for c, v in values.items()])

    last = convs.where("turns > 0").withColumn("depth", F.col("turns")).join(paths.select("conv_id", *KEY), ["conv_id", "depth"]).join(nodes.select(*KEY, "owner"), KEY).select("conv_id", "depth", "owner")
    none = convs.where("turns = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), least.alias("owner"))
    ends = _id_digests(last.union(none))
    empty = hashlib.sha256(b"").hexdigest()
    out = inner.union(roots).join(ends, ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
