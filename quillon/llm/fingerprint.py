"""Document fingerprints by SimHash, in built-in functions only: no Python on the executors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a fingerprint, and the blocks that the tables permute.
BITS, BLOCKS = 64, 6
#: Parts at most (a larger one spills), and rows that the bounds between them are taken from.
MAX_PARTS, MARK_ROWS = 16_384, 2_000_000
_LANE = 0x0000000100000001
_LEAST = -(1 << 63)


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One fingerprint (signed long ``fp``) per combination of ``keys``, of the words of the column ``text``.

    A word's 64-bit hash votes on each bit with the word's weight: its length less two, one at least, times its
    occurrences. Long words tell texts apart; the short ones that all texts of a language share count little. A bit is
    set if it has more than half of the weight. Texts without a word, null ones included, have the fingerprint 0. Votes
    are summed two bits to a long (a lane can't overflow: a text's weight is below 2^31), all in generated code, partial
    sums first.
    """
    words = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("w"))
    hashed = words.select(*keys, F.xxhash64("w").alias("h"), F.when(F.col("w") == "", 0).otherwise(F.greatest(F.char_length("w") - 2, F.lit(1))).cast("long").alias("weight"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANE)) * F.col("weight")).alias(f"v{j}") for j in range(32)]
    votes = hashed.groupBy(*keys).agg(F.sum("weight").alias("total"), *lanes)

    def bit(b: int) -> Column:
        lane = F.col(f"v{b % 32}")
        count = F.shiftrightunsigned(lane, 32) if b >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        value = (1 << b) if b < 63 else _LEAST
        return F.when(count * 2 > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))

    fp = bit(0)
    for b in range(1, BITS):
        fp = fp.bitwiseOR(bit(b))
    return votes.select(*keys, fp.alias("fp"))


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _part(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) at or below the key, by bisection."""
    width = 1
    while width <= len(bounds):
        width *= 2
    steps, w = [], width // 2
    while w:
        steps.append(w)
        w //= 2
    if not bounds:
        return F.lit(0)
    table = F.lit([*bounds, *[(1 << 63) - 1] * (width - len(bounds))])
    fits = lambda lo, w: (lo + w <= len(bounds)) & (F.element_at(table, F.least(lo + w, F.lit(len(bounds)))) <= key)
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, w: F.when(fits(lo, w), lo + w).otherwise(lo))


def _followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """part, rn, ghost, doc_id, text, next_text: rows in descending id within parts, each with the following row's text.

    Parts are ranges of ids, bounded by approximate quantiles of the id column (of about MARK_ROWS rows of a larger table), one per shuffle partition or input
    split, whichever are more (MAX_PARTS at most, so that the plan that holds the bounds doesn't grow with the table). An id that takes several quantiles (null ids count as
    one) is dealt to as many parts of its own, ranges of the text's hash. The first row of each part is also sent, as a
    ghost, to the end of the part before it; the very first ends the very last part.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))).withColumn("h", F.xxhash64("text"))
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()), MAX_PARTS)
    total = docs.count()
    seen = rows.sample(MARK_ROWS / total, seed=7) if total > MARK_ROWS else rows  # marks only balance the parts
    marks = seen.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    often = {k: marks.count(k) for k in set(marks) if marks.count(k) > 1}
    part = F.lit(n) - _part(F.col("key"), sorted(set(marks)))  # ascending as ids descend
    rows = rows.withColumn("part", part.cast("long") * (n + 1) + _share(F.col("key"), F.col("h"), often))
    heads = rows.groupBy("part").agg(F.max("key").alias("head"))  # a row per part
    first = rows.join(F.broadcast(heads), "part").where("key = head").groupBy("part", "head").agg(F.min("h").alias("h0"))
    around = Window.orderBy("part")  # over as many rows as there are parts
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = first.select(F.col("part").alias("of"), "head", "h0", F.coalesce(F.lag("part").over(around), F.last("part").over(whole)).alias("to"))
    ghosts = rows.join(F.broadcast(before), (F.col("part") == F.col("of")) & (F.col("key") == F.col("head")) & (F.col("h") == F.col("h0")))
    one = F.row_number().over(Window.partitionBy("of").orderBy("h"))  # of equal rows
    ghosts = ghosts.withColumn("k", one).where("k = 1").select("doc_id", "text", "key", "h", F.col("to").alias("part"), F.lit(1).alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", F.col("key").desc(), "h")
    lined = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    return lined.select("part", F.row_number().over(order).alias("rn"), "ghost", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def _share(key: Column, h: Column, often: dict[int, int]) -> Column:
    """0, or for an id with several quantiles the number (from 1, as the hash ascends) of its own part."""
    if not often:
        return F.lit(0)
    times = F.element_at(F.create_map(*[F.lit(x) for k, m in sorted(often.items()) for x in (k, m)]), key)
    high = F.shiftrightunsigned(h.bitwiseXOR(F.lit(_LEAST)), 40)
    return F.coalesce(F.floor(high * times / F.lit(float(1 << 24))) + 1, F.lit(0)).cast("int")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses.

    The edited text has the last third of the code points replaced by the first as many (or all) of the next row's text;
    rows go by descending id, equal ids by text hash, null ids last, and the last row is followed by the first. An id
    that takes several parts comes after those of the part that it ends. Null texts count as empty; a lone row follows itself; repeated rows have equal fingerprints; an empty table gives no
    rows; other columns are ignored.

    Plan: one shuffle of the texts, by part; look-ahead, word votes and the pivot all keep that distribution.
    """
    lined = _followed(docs, id_col, text_col)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n - cut)"), F.expr("substring(next_text, 1, cut)"))
    lined = lined.withColumn("n", n).withColumn("cut", cut).withColumn("edited", edited)
    own = ["part", "rn", "ghost", "doc_id", "n", "edited_sha256"]
    both = lined.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *own, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v")
    )
    fps = simhash(both.select(*own, F.col("v.which").alias("which"), F.col("v.t").alias("t")), [*own, "which"], "t")
    side = lambda k: F.max(F.when(F.col("which") == k, F.col("fp")))
    wide = fps.groupBy(*own).agg(side(0).alias("fp"), side(1).alias("edited_fp"))
    next_fp = F.lead("fp").over(Window.partitionBy("part").orderBy("rn"))
    return (
        wide.withColumn("next_fp", next_fp)
        .where("ghost = 0")
        .select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fp", "edited_fp",
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )


def block_keys(fp: Column, radius: int) -> Column:
    """The permuted tables' keys: for every choice of BLOCKS - radius blocks, the table's number and the bits of the chosen blocks.

    Two fingerprints within the radius agree in at least one choice.
    """
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(t).alias("tab"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(query_fp, fp, distance): the distinct fingerprints ``fp`` of the index within the radius of each distinct query's.

    Each pair is returned once, from the first table in which both agree; distances are verified inside the join. Copies
    are one row on either side; members are found by joining back on the fingerprint. Null fingerprints match nothing.
    """
    q = queries.where("fp IS NOT NULL").select(F.col("fp").alias("query_fp")).distinct()
    q = q.withColumn("k", F.explode(block_keys(F.col("query_fp"), radius))).select("query_fp", "k.tab", "k.bits")
    x = index.where("fp IS NOT NULL").select("fp").distinct()
    x = x.withColumn("k", F.explode(block_keys(F.col("fp"), radius))).select("fp", F.col("k.tab").alias("xtab"), F.col("k.bits").alias("xbits"))
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    agree = F.zip_with(block_keys(F.col("query_fp"), radius), block_keys(F.col("fp"), radius), lambda a, b: a == b)
    first = F.array_position(agree, F.lit(True)) - 1
    pairs = q.join(x, (F.col("tab") == F.col("xtab")) & (F.col("bits") == F.col("xbits")) & (distance <= radius) & (first == F.col("tab")))
    return pairs.select("query_fp", "fp", distance.alias("distance"))


def near_counts(rows: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """``rows`` (doc_id, fp and more) with near_docs: how many other rows have a fingerprint within the radius.

    Asked for the rows whose id is divisible by ``every``, against all rows; null for the others, null ids included.
    ``rows`` should be a written table, since it is read as queries, as index and as result. The index has one row per
    distinct fingerprint with its count, so copies make no key hot; only the queries are joined with their counts.
    """
    asked = rows.where(F.pmod(F.col("doc_id"), F.lit(every)) == 0)
    counts = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    pairs = within_radius(asked, counts, radius).join(counts, "fp")
    near = pairs.groupBy("query_fp").agg(F.sum("n").alias("n")).select(F.col("query_fp").alias("fp"), (F.col("n") - 1).alias("near_docs"))
    rest = rows.where(F.coalesce(F.pmod(F.col("doc_id"), F.lit(every)) != 0, F.lit(True)))
    return asked.join(near, "fp", "left").unionByName(rest.withColumn("near_docs", F.lit(None).cast("long")))
