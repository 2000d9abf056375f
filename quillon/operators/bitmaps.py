"""Filters as bitmaps over dense document numbers: one per value of a facet (tag, status, source) and bucket of 32,768 documents.

A filter of any number of values reads the bitmaps of these values alone, meets them in one grouping by bucket (an eighth
of a byte per document and value), and is tested with one join by bucket: there is no join per tag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metadata import FilterSpec
from quillon.runtime import written

#: Facet of every document.
ALL = "all"


@dataclass
class BitmapIndex:
    """numbers: doc_id, number; bitmaps: facet, bucket, bits."""

    numbers: DataFrame
    bitmaps: DataFrame


def numbered(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, number): dense numbers from 1 in order of doc_id; documents of ``known`` keep theirs and new ones follow. Null ids have none.

    Ids are dealt out by ranges and written once; a range is numbered where it stands, on from the sizes of those before it.
    """
    fresh = documents.select("doc_id").where("doc_id IS NOT NULL").distinct()
    start = 0
    if known is not None:
        fresh, start = fresh.join(known, "doc_id", "left_anti"), known.agg(F.max("number")).first()[0] or 0
    ranged = written(fresh.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "numbers")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))
    out = ranged.join(sizes.select("part", before.alias("before")), "part").select("doc_id", (within + F.col("before") + start).cast("long").alias("number"))
    return out if known is None else known.select("doc_id", "number").unionByName(out)


def _named(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def build(documents: DataFrame, document_tags: DataFrame, known: DataFrame | None = None) -> BitmapIndex:
    """The index of documents (doc_id, status, source_id) and their tags (doc_id, tag), as plans over written numbers."""
    numbers = written(numbered(documents, known), "document-numbers")
    facets = F.array_compact(F.array(F.lit(ALL), _named("status", F.col("status")), _named("source", F.col("source_id"))))
    rows = documents.select("doc_id", F.explode(facets).alias("facet")).unionByName(document_tags.where("tag IS NOT NULL").select("doc_id", _named("tag", F.col("tag")).alias("facet")))
    placed = rows.join(numbers, "doc_id").select("facet", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("at"))
    return BitmapIndex(numbers, written(placed.groupBy("facet", "bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "bitmaps"))


def combined(index: BitmapIndex, every: list[list[str]], none: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, allow, deny): documents with a facet of each group of ``every``, and those with one of ``none``.

    Groups are or-ed, then and-ed; a bucket without any document of a group isn't there. No group: all documents.
    """
    groups = every or [[ALL]]
    rows = index.bitmaps.where(F.col("facet").isin(sorted({f for g in groups for f in g} | set(none))))
    part_of = F.array_compact(F.array(*[F.when(F.col("facet").isin(g), i) for i, g in enumerate(groups)]))
    own = rows.withColumn("group", F.explode(part_of)).groupBy("bucket", "group").agg(F.bitmap_or_agg("bits").alias("bits"))
    allow = own.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("allow"), F.count(F.lit(1)).alias("have")).where(F.col("have") == len(groups)).drop("have")
    deny = rows.where(F.col("facet").isin(*none)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("deny"))
    return allow.join(deny, "bucket", "left")


def has_bit(bits: Column, number: Column) -> Column:
    """Whether a bucket's bitmap holds a number; a null bitmap holds none."""
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def keep(rows: DataFrame, found: DataFrame, number: str = "number") -> DataFrame:
    """Rows whose document number the filter lets through: one join by bucket, whose size Spark checks before it broadcasts."""
    met = rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(found, "bucket")
    return met.where(has_bit(F.col("allow"), F.col(number)) & ~has_bit(F.col("deny"), F.col(number))).select(*rows.columns)


def resolve(spec: FilterSpec, index: BitmapIndex) -> DataFrame | None:
    """(doc_id) of the documents that a filter lets through, as :func:`quillon.operators.metadata.resolve` gives it; None if it restricts nothing, no rows for an empty list."""
    if spec.is_empty:
        return None
    every = [[f"tag:{t}"] for t in spec.effective_tags]
    every += [[f"status:{spec.status}"]] if spec.status is not None else []
    every += [[f"source:{spec.source_id}"]] if spec.source_id is not None else []
    numbers = index.numbers
    if spec.doc_ids is not None:
        numbers = numbers.where(F.col("doc_id").isin(*spec.doc_ids)) if spec.doc_ids else numbers.where("false")
    return keep(numbers, combined(index, every, tuple(f"tag:{t}" for t in spec.tags_exclude))).select("doc_id")


def count(found: DataFrame) -> DataFrame:
    """(matched): documents let through, from the bitmaps alone: bits of ``allow`` less those that ``deny`` has too."""
    both = found.where("deny IS NOT NULL").select("bucket", F.explode(F.array("allow", "deny")).alias("bits")).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    n = found.select(F.bitmap_count("allow").alias("n")).unionByName(both.select((-F.bitmap_count("bits")).alias("n")))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"))
