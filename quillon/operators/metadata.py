"""Document metadata: filters, keyed table changes, and listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    """What a search is limited to. ``doc_ids=()`` is a filter that lets nothing through; None is none."""

    doc_ids: tuple | None = None
    tags_include: tuple[str, ...] = ()
    tags_exclude: tuple[str, ...] = ()
    source_id: object = None
    status: str | None = "active"
    domain: str | None = None
    source_type: str | None = None
    language: str | None = None
    version: str | None = None

    @property
    def is_empty(self) -> bool:
        """No restriction at all; the default status is one."""
        return self.doc_ids is None and not self.effective_tags and not self.tags_exclude and self.source_id is None and self.status is None

    @property
    def effective_tags(self) -> tuple[str, ...]:
        """Included tags with those derived from the classification."""
        derived = [f"{k}:{v.strip().lower()}" for k, v in (("domain", self.domain), ("source_type", self.source_type), ("lang", self.language)) if v]
        derived += [f"version:{self.version.strip()}"] if self.version else []
        return tuple(dict.fromkeys([*self.tags_include, *derived]))


def resolve(spec: FilterSpec, documents: DataFrame | None, document_tags: DataFrame | None) -> DataFrame | None:
    """(doc_id) of the documents that meet every part of the filter; None if it restricts nothing.

    ``documents``: doc_id, status, source_id; ``document_tags``: doc_id, tag. Without a documents table the explicit ids
    are all there is. All included tags (relational division), none of the excluded.
    """
    if spec.is_empty:
        return None
    if documents is None:
        return None if spec.doc_ids is None else _explicit(spec, document_tags)
    out = documents.where("doc_id IS NOT NULL").select("doc_id", "status", "source_id")
    if spec.status is not None:
        out = out.where(F.col("status") == spec.status)
    if spec.source_id is not None:
        out = out.where(F.col("source_id") == spec.source_id)
    out = out.select("doc_id").distinct()
    wanted = spec.effective_tags
    if wanted:
        have = document_tags.where(F.col("tag").isin(*wanted)).groupBy("doc_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted))
        out = out.join(have, "doc_id", "left_semi")
    if spec.tags_exclude:
        out = out.join(document_tags.where(F.col("tag").isin(*spec.tags_exclude)), "doc_id", "left_anti")
    if spec.doc_ids is not None:
        out = out.where(F.col("doc_id").isin(*spec.doc_ids)) if spec.doc_ids else out.where("false")
    return out


def _explicit(spec: FilterSpec, like: DataFrame | None) -> DataFrame | None:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    kind = like.schema["doc_id"].dataType.simpleString() if like is not None else "string"
    return spark.createDataFrame([(i,) for i in dict.fromkeys(spec.doc_ids)], f"doc_id {kind}")


def post_filter(hits: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Hits of the given documents alone, after a search; None lets all through, an empty table none."""
    return hits if docs is None else hits.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def filter_stats(documents: DataFrame, matched: DataFrame | None) -> DataFrame:
    """(total, matched): all documents and those that the filter lets through."""
    total = documents.agg(F.count(F.lit(1)).alias("total"))
    if matched is None:
        return total.withColumn("matched", F.col("total"))
    return total.crossJoin(matched.agg(F.count(F.lit(1)).alias("matched")))  # a row each


def derived_tags(domain: Column, source_type: Column, language: Column, version: Column) -> Column:
    """Tags that stand for the classification; absent parts give none."""
    made = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:"), F.lower(F.trim(c))))
    return F.array_compact(F.array(made("domain", domain), made("source_type", source_type), made("lang", language), F.when(F.trim(version) != "", F.concat(F.lit("version:"), F.trim(version)))))


def normal_tags(tags: Column) -> Column:
    """Trimmed, without empty and repeated ones, in their order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def all_tags(tags: Column, derived: Column) -> Column:
    return F.array_sort(F.array_union(tags, derived))


def search_documents(documents: DataFrame, document_tags: DataFrame, text: str) -> DataFrame:
    """Documents whose id, path or a tag is LIKE %text% (ASCII letters in any case; % and _ are wild), with their tags."""
    pattern = F.lit(f"%{text.lower()}%")
    like = lambda c: F.like(F.lower(c.cast("string")), pattern, F.lit("\\"))
    tagged = document_tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.max(like(F.col("tag"))).alias("hit"))
    out = documents.join(tagged, "doc_id", "left")
    return out.where(like(F.col("doc_id")) | like(F.coalesce("path", F.lit(""))) | F.coalesce("hit", F.lit(False))).drop("hit")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep_new: Column | None = None) -> DataFrame:
    """The table with rows of ``changes`` in place of those with equal keys; of repeated changes the last by ``keep_new`` (else any equal one)."""
    order = Window.partitionBy(*keys).orderBy(keep_new.desc() if keep_new is not None else F.xxhash64(*changes.columns))
    latest = changes.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return table.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def remove(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table without the rows of these ids; called for every table of a cascade."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def by_ids(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def assign_tags(document_tags: DataFrame, new: DataFrame) -> DataFrame:
    """The bridge with new (doc_id, tag) pairs; known ones are not repeated."""
    return document_tags.unionByName(new.select("doc_id", "tag").distinct().join(document_tags, ["doc_id", "tag"], "left_anti"))


def rename_tag(document_tags: DataFrame, old: str, new: str) -> DataFrame:
    return document_tags.withColumn("tag", F.when(F.col("tag") == old, F.lit(new)).otherwise(F.col("tag"))).distinct()


def list_documents(documents: DataFrame, document_tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their sorted tags and chunk counts; both sides are aggregated before they are joined."""
    tags = document_tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    n = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    out = documents.join(tags, "doc_id", "left").join(n, "doc_id", "left")
    return out.withColumn("tags", F.coalesce("tags", F.lit(""))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))


def list_tags(tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Every tag with the number of its documents, none included."""
    n = document_tags.groupBy("tag").agg(F.count_distinct("doc_id").alias("n_documents"))
    return tags.select("tag").distinct().join(n, "tag", "left").select("tag", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def list_sources(sources: DataFrame, documents: DataFrame) -> DataFrame:
    n = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return sources.select("source_id").distinct().join(n, "source_id", "left").select("source_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def new_by_content(registry: DataFrame, incoming: DataFrame, digest: str = "md5") -> DataFrame:
    """Incoming rows whose content no registered document has, the first of equal ones by doc_id."""
    fresh = incoming.join(registry.select(digest).distinct(), digest, "left_anti")
    first = Window.partitionBy(digest).orderBy("doc_id")
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
