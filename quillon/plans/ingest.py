"""The ingest plan: files to a published generation, without a row that raises."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import CommitConflict, GenerationUnavailable
from quillon.functions.text import fold
from quillon.operators import lifecycle, markdown
from quillon.providers import ColumnProvider
from quillon.runtime import written
from quillon.sources import files
from quillon.sources.segments import SegmentIndex, Snapshot
from quillon.sources.versions import VersionedStore

#: Tables of a generation with rows of documents, beside documents itself.
OF_DOCUMENTS = ("chunks", "vectors", "fts", "document_tags", "document_rows")
#: Ingests that are decided anew after another writer's commit, before one gives up.
TRIES = 8

_CLASS = ("title", "domain", "source_type", "language", "version")


def prepare(raw: DataFrame, strict: bool = False) -> DataFrame:
    """path, doc_id, md5, clean, front matter, ok and error of every file: validated, cleaned, and named by its front matter, else by its stem.

    ``raw``: path, doc_id, text, readable, md5 as :func:`quillon.sources.files.read_markdown` gives them. Of files that
    are well and have one id, the first by path has it; files that are not well claim no id.
    """
    clean = files.cleaned(raw)
    report = markdown.validate(raw, "path", "text", "readable")
    bad = markdown.blocked(report, strict).withColumn("blocked", F.lit(True))
    front = markdown.parse_front_matter(raw).withColumnRenamed("doc_id", "front_id")
    out = clean.join(front, "path", "left").join(bad, "path", "left")
    error = F.when(~F.col("readable"), "encoding").when(F.col("rejected"), "empty").when(F.coalesce("blocked", F.lit(False)), "validation")
    named = out.withColumn("doc_id", F.coalesce("front_id", "doc_id")).withColumn("error", error).withColumn("ok", error.isNull())
    marked = lifecycle.first_in_batch(named.withColumn("batch_id", F.lit(0))).drop("batch_id")
    return marked.withColumn("error", F.when(F.col("duplicate"), "duplicate_doc_id").otherwise(F.col("error"))).withColumn("ok", F.col("ok") & ~F.col("duplicate"))


@dataclass
class Stored:
    """What is stored, as the state readers see it; None where a table doesn't exist.

    documents: doc_id, path, content_hash, generation, run_id (null: stored before there were versions) and the
    classification (title, domain, source_type, language, version, tags); runs: run_id, doc_id, state, content_hash,
    path, chunk_ids; chunks: doc_id, chunk_id, text and, where known, model_version and embedding_dim; vectors, fts:
    doc_id, chunk_id, text_sha; ops: doc_id, phase.
    """

    documents: DataFrame | None = None
    runs: DataFrame | None = None
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    fts: DataFrame | None = None
    ops: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame | None:
        return getattr(self, name)


def _shas(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha"))


def _per_doc(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.groupBy("doc_id").agg(*aggregates)


def snapshot(ids: DataFrame, stored: Stored) -> DataFrame:
    """A row per id with what is stored of it, for :func:`quillon.operators.lifecycle.decide`; a join per table, each on doc_id.

    The version's hash and path are those of the run that the document's row names; the hashes of all committed runs
    under that id are compared with it. Stores are compared by chunk id and text hash, row counts included; a store that
    doesn't exist can't be verified.
    """
    row = ids.select("doc_id").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    if stored.documents is not None:
        own = [c for c in _CLASS if c in stored.documents.columns]
        tags = F.array_sort("tags") if "tags" in stored.documents.columns else none("array<string>")
        docs = stored.documents.select("doc_id", F.col("path").alias("documents_path"), F.col("content_hash").alias("documents_hash"), "run_id", F.struct(*[F.col(c) for c in own], tags.alias("tags")).alias("old_class"))
        row = row.join(docs, "doc_id", "left")
    else:
        row = row.select("doc_id", none("string").alias("documents_path"), none("string").alias("documents_hash"), none("string").alias("run_id"), none("string").alias("old_class"))
    row = row.withColumn("has_version", F.col("run_id").isNotNull())
    if stored.runs is not None:
        active = stored.runs.select(F.col("run_id").alias("r"), F.col("state").alias("run_state"), F.col("content_hash").alias("version_hash"), F.col("path").alias("run_path"), F.array_sort("chunk_ids").alias("run_chunks"))
        done = stored.runs.where("state = 'COMMITTED'")
        hashes = _per_doc(done, F.array_sort(F.collect_set("content_hash")).alias("all_hashes"), F.max_by("path", "run_id").alias("last_path"))
        named = done.groupBy(F.col("run_id").alias("r2")).agg(F.array_sort(F.collect_set("content_hash")).alias("own_hashes"))
        row = row.join(active, F.col("run_id") == F.col("r"), "left").join(named, F.col("run_id") == F.col("r2"), "left").join(hashes, "doc_id", "left")
        row = row.withColumn("committed_hashes", F.when(F.col("has_version"), F.col("own_hashes")).otherwise(F.col("all_hashes")))
        row = row.withColumn("owner_path", F.when(F.col("has_version"), F.col("run_path")).otherwise(F.coalesce("last_path", "documents_path")))
    else:
        row = row.select("*", none("string").alias("run_state"), none("string").alias("version_hash"), none("array<string>").alias("run_chunks"), none("array<string>").alias("committed_hashes"), F.col("documents_path").alias("owner_path"))
    counts = []
    for name in ("chunks", "vectors", "fts"):
        if stored[name] is not None:
            counts.append(f"n_{name}")
            row = row.join(_per_doc(stored[name], F.count(F.lit(1)).cast("int").alias(f"n_{name}")), "doc_id", "left")
        else:
            row = row.withColumn(f"n_{name}", F.lit(0))
    row = row.fillna(0, counts)
    if stored.chunks is not None:
        have = set(stored.chunks.columns)
        kinds = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in ("model_version", "embedding_dim")]
        model = F.struct(kinds[0].alias("version"), F.when(kinds[1] == "0", "").otherwise(kinds[1]).alias("dim"))
        held = _per_doc(stored.chunks.select("doc_id", "chunk_id", model.alias("model")), F.collect_set("model").alias("models"), F.array_sort(F.collect_list("chunk_id")).alias("ids"))
        refs = _per_doc(_shas(stored.chunks), F.array_sort(F.collect_list(F.struct("chunk_id", F.col("text_sha").alias("sha")))).alias("old_chunks"))
        row = row.join(held, "doc_id", "left").join(refs, "doc_id", "left")
        row = row.withColumn("mixed_models", F.coalesce(F.size("models") > 1, F.lit(False)))
        only = F.element_at("models", 1)
        row = row.withColumn("model", F.when((F.size("models") == 1) & (only["version"] != ""), only))
        row = row.withColumn("chunk_ids_differ", F.coalesce(F.col("run_chunks") != F.coalesce("ids", F.array().cast("array<string>")), F.lit(False)))
    else:
        row = row.select("*", none("array<struct<chunk_id:string,sha:string>>").alias("old_chunks"), F.lit(False).alias("mixed_models"), none("struct<version:string,dim:string>").alias("model"), F.lit(False).alias("chunk_ids_differ"))
    for name in ("vectors", "fts"):
        if stored[name] is not None and stored.chunks is not None:
            equal = lifecycle.store_diff(_shas(stored.chunks), stored[name]).select("doc_id", (~F.col("equal")).alias(f"{name}_differ"))
            row = row.join(equal, "doc_id", "left").fillna(False, [f"{name}_differ"])
        else:
            row = row.withColumn(f"{name}_differ", F.lit(False))
    if stored.ops is not None:
        open_ops = _per_doc(stored.ops.where("phase IN ('WRITING', 'COMMITTING', 'RESTORING')"), F.lit(True).alias("pending_op"))
        row = row.join(open_ops, "doc_id", "left").fillna(False, ["pending_op"])
    else:
        row = row.withColumn("pending_op", F.lit(False))
    return row.withColumn("vectors_known", F.lit(stored.vectors is not None)).withColumnRenamed("fts_differ", "fts_differs").select(
        "doc_id", "has_version", "pending_op", "run_state", "documents_hash", "version_hash", "committed_hashes", "documents_path", "owner_path", "mixed_models", "vectors_known", "vectors_differ", "fts_differs",
        "chunk_ids_differ", "n_chunks", "n_vectors", "n_fts", "old_chunks", "model", "old_class",
    )


def states(prepared: DataFrame, chunks: DataFrame, stored: Stored, force: bool = False, model: tuple[str, int] | None = None) -> DataFrame:
    """One row per document that is ready: what comes in, beside what is stored, for :func:`quillon.operators.lifecycle.decide`.

    ``model``: version and dimension that new vectors would have; unknown on either side counts as equal.
    """
    ready = prepared.where("ok")
    new = _per_doc(_shas(chunks), F.array_sort(F.collect_list(F.struct("chunk_id", F.col("text_sha").alias("sha")))).alias("new_chunks"))
    own = [c for c in _CLASS if c in ready.columns]
    tags = F.array_sort("tags") if "tags" in ready.columns else F.lit(None).cast("array<string>")
    incoming = ready.select("doc_id", "path", "md5", F.struct(*[F.col(c) for c in own], tags.alias("tags")).alias("new_class"))
    row = incoming.join(new, "doc_id", "left").join(snapshot(incoming, stored), "doc_id", "left")
    same_model = F.lit(None).cast("boolean") if model is None else F.when(F.col("model").isNotNull(), (F.col("model.version") == model[0]) & (F.col("model.dim") == str(model[1])))
    same_class = F.lit(True) if dict(row.dtypes)["old_class"] == "string" else F.col("old_class").isNull() | F.col("new_class").eqNullSafe(F.col("old_class"))
    return row.select(
        "*", F.col("new_chunks").eqNullSafe(F.col("old_chunks")).alias("chunks_equal"), same_model.alias("model_equal"), same_class.alias("class_equal"), F.lit(force).alias("force"),
    ).drop("old_chunks", "new_chunks", "model", "old_class", "new_class")


def read_stored(store: VersionedStore) -> Stored:
    """The tables of a store: documents as published, of the others the rows of the generation that each document's row names.

    ops are the journal's rows of generations that are claimed and neither published nor given up: their writer is at work or has died.
    """
    documents = store.read("documents")
    ops = journal(store).where("phase = 'WRITING'").select("doc_id", "phase") if store.open() else None
    if documents is None:
        return Stored(vectors=_NO_ROWS(store.spark), fts=_NO_ROWS(store.spark), ops=ops)
    now = documents.select("doc_id", "generation")
    live = {}
    for f in fields(Stored):
        if f.name in ("chunks", "vectors", "fts"):
            rows = store.history(f.name)
            live[f.name] = rows.join(now, ["doc_id", "generation"], "left_semi") if rows is not None else _NO_ROWS(store.spark)
    return Stored(documents=documents, runs=store.history("runs"), ops=ops, **live)


def _NO_ROWS(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id string, chunk_id string, text_sha string")


def journal(store: VersionedStore) -> DataFrame:
    """(doc_id, operation, generation, phase): what was begun for each document; DONE once its generation is published, GIVEN_UP once it never will be."""
    _, entry = store.state()
    have = [x for x in store._names(f"{store.root}/_ops") if x.startswith("generation=")]
    if not have:
        return store.spark.createDataFrame([], "doc_id string, operation string, generation long, phase string")
    rows = store.spark.read.option("basePath", f"{store.root}/_ops").schema("doc_id string, operation string, generation long").parquet(*[f"{store.root}/_ops/{x}" for x in have])
    phase = F.when(F.col("generation").isin([*entry["published"], *entry["settled"]]), "DONE").when(F.col("generation").isin(entry["given_up"]), "GIVEN_UP").otherwise("WRITING")
    return rows.withColumn("phase", phase)


def _begin(store: VersionedStore, docs: DataFrame, operation: str) -> int:
    """Claim a generation and journal the documents (doc_id) that it is about, before anything of it is written."""
    g = store.next_generation()
    docs.select("doc_id", F.lit(operation).alias("operation")).write.parquet(f"{store.root}/_ops/generation={g}")
    return g


def lexical(store: VersionedStore) -> tuple[SegmentIndex, Snapshot]:
    """The index of what is published, and the snapshot of it that belongs to the published documents."""
    index = SegmentIndex(store.spark, f"{store.root}/_lexical")
    return index, index.snapshot(store.state()[1]["extra"].get("lexical", 0))


def run(
    spark: SparkSession, folder: str, store: VersionedStore, force: bool = False, strict: bool = False, embed: ColumnProvider | None = None, model: tuple[str, int] | None = None, lease_minutes: float = 30.0,
) -> DataFrame:
    """Ingest a folder of Markdown: publish new and changed documents as one generation; returns (doc_id, path, decision, error).

    A generation holds only what is new: chunks, vectors (``embed`` adds the column embedding), index rows, tags, rows
    and runs; the documents table says for each document which generation counts, and is the one thing that is written
    anew. The lexical index gets a segment of the new chunks, and which of its commits counts is said by the same log
    entry, so a search sees a document as soon as, and never before, it is published.

    Documents that are refused or unchanged keep what is published. A generation is claimed and its documents journaled
    before it is written; a crash leaves the old state, and its documents refused as pending until the lease is over (or
    ``store.recover()`` says that the writer is dead). Where another writer publishes first, this one gives its
    generation up, reads the new state and decides again. Nothing new: no generation. Run and batch rows of files that
    failed are written with the generation, if there is one.
    """
    store.recover(lease_minutes)
    prepared = written(prepare(files.read_markdown(spark, folder), strict), "prepared")
    chunks = written(markdown.chunk_documents(prepared.where("ok").withColumnRenamed("clean", "body"), "doc_id", "body"), "chunks")
    for _ in range(TRIES):
        try:
            return _publish(store, prepared, chunks, force, embed, model)
        except CommitConflict:
            continue
    raise CommitConflict(f"{store.root}: {TRIES} ingests were overtaken by other writers")


def _publish(store: VersionedStore, prepared: DataFrame, chunks: DataFrame, force: bool, embed: ColumnProvider | None, model: tuple[str, int] | None) -> DataFrame:
    """One try of an ingest from the state as it is now."""
    base, entry = store.state()
    stored = read_stored(store)
    decided = written(lifecycle.decide(states(prepared, chunks, stored, force, model)).select("doc_id", "path", "decision", "reason"), "decided")
    outcome = prepared.select("doc_id", "path", "error").join(decided.select("path", "decision", "reason"), "path", "left").select("doc_id", "path", F.coalesce("decision", F.lit("FAILED")).alias("decision"), F.coalesce("error", F.when(F.col("decision").isin("INCOHERENT", "INSUFFICIENT_EVIDENCE", "NOT_OWNER"), F.col("reason"))).alias("error"))
    accepted = decided.where("decision IN ('CREATE', 'REPLACE')").select("doc_id")
    if accepted.isEmpty():
        return outcome
    g = _begin(store, accepted, "ingest")
    new = chunks.join(accepted, "doc_id", "left_semi")
    if model is not None:
        new = new.withColumn("model_version", F.lit(model[0])).withColumn("embedding_dim", F.lit(model[1]))
    vectors = _shas(new) if embed is None else _shas(new).join(embed(new).select("chunk_id", "embedding"), "chunk_id", "left")
    run_id = F.concat_ws("-", F.lpad(F.lit(str(g)), 9, "0"), "doc_id")
    front = prepared.where("ok").join(accepted, "doc_id", "left_semi")
    listed = new.groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    runs = front.join(listed, "doc_id", "left").select(
        run_id.alias("run_id"), "doc_id", F.lit("COMMITTED").alias("state"), F.col("md5").alias("content_hash"), "path", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.current_timestamp().alias("started_at"),
    )
    state = F.when(F.col("decision").isin("CREATE", "REPLACE"), "COMMITTED").when(F.col("decision").startswith("NOOP"), "SKIPPED").otherwise("FAILED")
    batch = outcome.select(F.lit(g).cast("long").alias("batch_id"), "doc_id", "path", state.alias("state"), "error")
    tags = front.select("doc_id", F.explode("all_tags").alias("tag"))
    old = stored.documents
    row = front.select("doc_id", "path", F.col("md5").alias("content_hash"), *_CLASS, "tags", run_id.alias("run_id"), F.lit(g).cast("long").alias("generation"))
    # what each document comes after: where its run goes back to
    before = row.withColumn("previous", F.lit(None).cast("long")) if old is None else row.join(old.select("doc_id", F.col("generation").alias("previous")), "doc_id", "left")
    own = before.drop("generation")
    store.append({"chunks": new, "vectors": vectors, "fts": _shas(new), "document_tags": tags, "document_rows": own, "runs": runs, "batch_documents": batch, "batches": lifecycle.batch_status(batch)}, g)
    index, snap = lexical(store)
    written_new = store.read("chunks", g).select("chunk_id", "doc_id", "text")
    number = index.add(written_new, base=snap.number)
    store.publish({"documents": row if old is None else old.join(accepted, "doc_id", "left_anti").unionByName(row)}, g, base, {"lexical": number})
    return outcome


def published(store: VersionedStore, name: str = "chunks") -> DataFrame | None:
    """The rows of a table that count now: of each document those of the generation that its row names."""
    documents = store.read("documents")
    rows = store.history(name)
    return None if documents is None or rows is None else rows.join(documents.select("doc_id", "generation"), ["doc_id", "generation"], "left_semi")


# -- single documents


def delete_documents(store: VersionedStore, docs: DataFrame) -> int:
    """Delete documents (doc_id) that are published; returns how many. Only the table of documents is written anew, and tombstones in the index.

    Their rows stay in their generations, out of every reader's sight, until a compaction. Ids that aren't published are passed over.
    """
    base, _ = store.state()
    old = store.read("documents")
    if old is None:
        return 0
    gone = written(old.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id"), "deleted")
    n = gone.count()
    if n:
        g = _begin(store, gone, "delete")
        index, snap = lexical(store)
        number = index.remove(gone, base=snap.number)
        store.publish({"documents": old.join(gone, "doc_id", "left_anti")}, g, base, {"lexical": number}, "delete")
    return n


def roll_back_runs(store: VersionedStore, runs: DataFrame) -> int:
    """Undo runs (run_id), each of one document: it goes back to what it was before that run, or away if it was new.

    GenerationUnavailable, and nothing changes, where a run isn't its document's active one, or what came before it has
    been compacted away. Other documents' files aren't touched.
    """
    base, entry = store.state()
    old = store.read("documents")
    asked = written(runs.select("run_id").distinct(), "asked-runs")
    if old is None or asked.isEmpty():
        if asked.isEmpty():
            return 0
        raise GenerationUnavailable("nothing is published")
    active = old.select("doc_id", F.col("run_id").alias("active_run"), "generation")
    found = asked.join(active, F.col("run_id") == F.col("active_run"), "left")
    refused = found.where(~lifecycle.may_roll_back(F.col("run_id"), F.col("active_run"))).select("run_id").limit(3).collect()
    if refused:
        raise GenerationUnavailable(f"not active: {', '.join(r.run_id for r in refused)}")
    rows = store.history("document_rows")
    back = written(found.select("doc_id", "generation").join(rows.select("doc_id", "generation", "previous"), ["doc_id", "generation"]).select("doc_id", F.col("previous").alias("generation")), "rolled-back")
    lost = back.where(F.col("generation").isNotNull() & ~F.col("generation").isin(entry["published"])).limit(1).collect()
    if lost or back.count() != asked.count():
        raise GenerationUnavailable("what came before has been compacted away")
    g = _begin(store, back, "roll_back")
    kept = old.join(back, "doc_id", "left_anti")
    restored = rows.join(back.where("generation IS NOT NULL"), ["doc_id", "generation"], "left_semi").select(*old.columns)
    index, snap = lexical(store)
    number = index.remove(back.where("generation IS NULL"), base=snap.number)
    again = store.history("chunks").join(back.where("generation IS NOT NULL"), ["doc_id", "generation"], "left_semi").select("chunk_id", "doc_id", "text")
    number = index.add(again, base=number)
    store.publish({"documents": kept.unionByName(restored)}, g, base, {"lexical": number}, "roll_back")
    return back.count()


def compact(store: VersionedStore, keep: int = 2) -> list[str]:
    """Write what counts as one generation, merge the index, and delete what none of the last ``keep`` log entries counts on; returns what went.

    Reads after it touch one folder a table, however many generations there were. Runs can't be gone back behind it.
    """
    base, _ = store.state()
    old = store.read("documents")
    if old is None:
        return []
    g = _begin(store, old, "compact")
    tables = {}
    for name in OF_DOCUMENTS:
        rows = published(store, name)
        if rows is not None:
            rows = rows.drop("generation")
            tables[name] = rows.withColumn("previous", F.lit(None).cast("long")) if name == "document_rows" else rows
    runs = store.history("runs")
    if runs is not None:
        tables["runs"] = runs.join(old.select("run_id"), "run_id", "left_semi").drop("generation")
    for name in ("batches", "batch_documents"):
        rows = store.history(name)
        if rows is not None:
            tables[name] = rows.drop("generation")
    index, snap = lexical(store)
    number = index.merge(base=snap.number) or snap.number
    tables["documents"] = old.withColumn("generation", F.lit(g).cast("long"))
    store.publish(tables, g, base, {"lexical": number}, "compact", only=True)
    gone = store.vacuum(keep)
    named = [store.state(n)[1]["extra"].get("lexical", 0) for n in store.log.numbers() if store.log.entry(n) is not None]
    return gone + [f"_lexical/{x}" for x in index.vacuum(0, tuple(named))]


# -- repairs and migrations


def documents_from_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with rows made up for chunks that have none: the title is the path of the document's first chunk."""
    first = chunks.groupBy("doc_id").agg(F.min_by("heading_path", F.struct("line_start", "chunk_id")).alias("title"))
    made = first.join(documents.select("doc_id"), "doc_id", "left_anti").withColumn("status", F.lit("active"))
    return documents.unionByName(made, allowMissingColumns=True)


def backfill_sparse(chunks: DataFrame, sparse: DataFrame) -> DataFrame:
    """Sparse weights (chunk_id, token, weight) with term counts for chunks that have none; the dense dimension is not touched."""
    lacking = chunks.join(sparse.select("chunk_id").distinct(), "chunk_id", "left_anti")
    words = F.filter(F.split(fold(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    made = lacking.select("chunk_id", F.explode(words).alias("token")).groupBy("chunk_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return sparse.unionByName(made)


def config_diff(built: dict, wanted: dict) -> list[tuple[str, object, object]]:
    """(setting, built with, wanted) where an index was built under other settings."""
    return [(k, built.get(k), wanted.get(k)) for k in sorted({*built, *wanted}) if built.get(k) != wanted.get(k)]


def repair(chunks: DataFrame, vectors: DataFrame, fts: DataFrame, model: tuple[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, vectors and index rows after repair: unknown model data filled in, vectors without a chunk dropped, one index row per chunk, made from the chunk's text."""
    version = F.when(F.coalesce("model_version", F.lit("")) == "", model[0]).otherwise(F.col("model_version"))
    dim = F.when(F.coalesce("embedding_dim", F.lit(0)) == 0, model[1]).otherwise(F.col("embedding_dim"))
    full = chunks.withColumn("model_version", version).withColumn("embedding_dim", dim)
    return full, vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"), _shas(chunks).dropDuplicates(["chunk_id"]).select(*[c for c in ("doc_id", "chunk_id", "text_sha") if c in fts.columns])
