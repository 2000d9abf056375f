"""Ingest state: batches and runs, ownership decisions, versions, integrity, cache and feedback."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULTS, Settings

# Kinds of feedback.
FEEDBACK_KINDS = ("relevant", "irrelevant", "useful", "not_useful", "wrong_doc", "outdated", "duplicate", "bad_citation")


# -- batches and runs

def batch_status(rows: DataFrame) -> DataFrame:
    """(batch_id, counters, status): no failure COMPLETED, else anything done PARTIAL, else FAILED."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    out = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), *map(count, ("COMMITTED", "SKIPPED", "FAILED", "ROLLED_BACK")))
    bad, good = F.col("failed") + F.col("rolled_back"), F.col("committed") + F.col("skipped")
    return out.withColumn("status", F.when(bad == 0, "COMPLETED").when(good > 0, "PARTIAL").otherwise("FAILED"))


def stale_runs(runs: DataFrame, now: Column, minutes: int = DEFAULTS.stale_minutes) -> DataFrame:
    """Runs in progress that began over ``minutes`` ago."""
    return runs.where((F.col("state") == "IN_PROGRESS") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def resumable(rows: DataFrame, order: str = "updated_at") -> DataFrame:
    """Documents whose last state asks for another try, with one more try counted."""
    last = Window.partitionBy("batch_id", "doc_id").orderBy(F.col(order).desc(), F.col("retry_count").desc())
    latest = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return latest.where(F.col("state").isin("PENDING", "FAILED", "ROLLED_BACK")).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + 1)


def latest_incomplete(batches: DataFrame) -> DataFrame:
    """The youngest batch that is not completed: one row, or none."""
    return batches.where(F.col("status").isin("IN_PROGRESS", "PARTIAL", "FAILED")).orderBy(F.col("started_at").desc(), F.col("batch_id").desc()).limit(1)


def first_in_batch(prepared: DataFrame) -> DataFrame:
    """Rows with ``duplicate``: of equal doc_ids in a batch the first by path is taken, the others fail.

    With a column ``ok``, only rows that are claim an id, and only they can be duplicates.
    """
    keys = ["batch_id", "doc_id", *(["ok"] if "ok" in prepared.columns else [])]
    late = F.row_number().over(Window.partitionBy(*keys).orderBy("path")) > 1
    return prepared.withColumn("duplicate", late & F.col("ok") if "ok" in prepared.columns else late)


# -- ownership

def decide(state: DataFrame) -> DataFrame:
    """Add decision and reason to rows of stored state joined with what comes in; the first rule that holds decides.

    Stored: has_version, pending_op, run_state, documents_hash, version_hash, committed_hashes (array), documents_path,
    owner_path, mixed_models, vectors_known, vectors_differ, fts_differs, chunk_ids_differ, n_chunks, n_vectors, n_fts.
    Incoming: path, chunks_equal, model_equal (null: unknown, counts as equal), class_equal, force.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    both = lambda a, b: c(a).isNotNull() & c(b).isNotNull()
    committed = F.coalesce(c("committed_hashes"), F.array().cast("array<string>"))
    equal = yes(c("chunks_equal")) & F.coalesce(c("model_equal"), F.lit(True)) & yes(c("class_equal"))
    own = yes(c("path") == c("owner_path"))
    force = yes(c("force"))
    vectors_bad = ~yes(c("vectors_known"))
    stores_differ = yes(c("vectors_differ")) | yes(c("fts_differs"))
    several = F.size(committed) > 1
    paths_differ = both("documents_path", "owner_path") & (c("documents_path") != c("owner_path"))
    unlisted = c("documents_hash").isNotNull() & (F.size(committed) > 0) & ~F.array_contains(committed, F.coalesce(c("documents_hash"), F.lit("")))
    version, none = yes(c("has_version")), (F.coalesce(c("n_chunks"), F.lit(0)) == 0) & c("documents_hash").isNull()
    broken = [
        (yes(c("pending_op")), "pending_operation"),
        (version & (F.coalesce(c("run_state"), F.lit("")) != "COMMITTED"), "run_not_committed"),
        (version & c("version_hash").isNull(), "hash_missing"),
        (version & both("documents_hash", "version_hash") & (c("documents_hash") != c("version_hash")), "document_hash"),
        (version & several, "several_hashes"),
        (version & (F.size(committed) > 0) & ~F.array_contains(committed, F.coalesce(c("version_hash"), F.lit(""))), "version_hash"),
        (version & paths_differ, "path"),
        (version & unlisted, "document_hash_unknown"),
        (version & yes(c("mixed_models")), "mixed_models"),
        (version & vectors_bad, "vectors_unverifiable"),
        (version & stores_differ, "stores_differ"),
        (version & yes(c("chunk_ids_differ")), "chunk_ids"),
        (~version & none & (stores_differ | (F.coalesce(c("n_vectors"), F.lit(0)) + F.coalesce(c("n_fts"), F.lit(0)) > 0)), "orphans"),
    ]
    legacy = ~version & ~none
    legacy_broken = [(several, "several_hashes"), (paths_differ, "path"), (unlisted, "document_hash_unknown"), (yes(c("mixed_models")), "mixed_models"), (vectors_bad, "vectors_unverifiable"), (stores_differ, "stores_differ")]
    rule = None
    for when, reason in broken:
        rule = (F.when if rule is None else rule.when)(when, F.struct(F.lit("INCOHERENT").alias("decision"), F.lit(reason).alias("reason")))
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    rule = rule.when(~version & none, out("CREATE", "new"))
    rule = rule.when(legacy & c("owner_path").isNull(), out("INSUFFICIENT_EVIDENCE", "no_owner"))
    for when, reason in legacy_broken:
        rule = rule.when(legacy & when, out("INCOHERENT", reason))
    rule = rule.when(version & own & equal & ~force, out("NOOP_OWNER", "unchanged")).when(legacy & own & equal, out("NOOP_OWNER", "unchanged"))
    rule = rule.when(own, out("REPLACE", "changed")).when(equal, out("NOOP_EQUIVALENT_OTHER_SOURCE", "same_content"))
    rule = rule.when(version, out("NOT_OWNER", "other_source")).otherwise(out("INSUFFICIENT_EVIDENCE", "other_source"))
    return state.withColumn("__d", rule).select(*state.columns, "__d.decision", "__d.reason")


# -- versions

def obsolete_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, chunk_id) that the old generation has and the new one of the same document lacks."""
    touched = new.select("doc_id").distinct()
    return old.join(touched, "doc_id", "left_semi").join(new.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti").select("doc_id", "chunk_id")


def publish(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pointer table (doc_id, generation, ...) after a publish: accepted documents move on by one generation."""
    new = incoming.join(current.select("doc_id", F.col("generation").alias("g")), "doc_id", "left").withColumn("generation", F.coalesce("g", F.lit(0)) + 1).drop("g")
    return current.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def recovery(ops: DataFrame) -> DataFrame:
    """What an interrupted operation needs: WRITING and RESTORING go back, COMMITTING goes on."""
    return ops.where("phase <> 'DONE'").withColumn("action", F.when(F.col("phase").isin("WRITING", "RESTORING"), "RESTORE").when(F.col("phase") == "COMMITTING", "RECOMMIT"))


def may_roll_back(run_id: Column, active_run: Column) -> Column:
    """Only the active run may be rolled back."""
    return F.coalesce(run_id == active_run, F.lit(False))


# -- integrity

def integrity(chunks: DataFrame, vectors: DataFrame, fts: DataFrame, documents: DataFrame, document_tags: DataFrame, runs: DataFrame, now: Column, model: str, dim: int) -> DataFrame:
    """(check_name, key): one row per finding.

    chunks: chunk_id, doc_id, model_version, embedding_dim; vectors, fts: chunk_id, doc_id; documents: doc_id, language;
    document_tags: doc_id, tag; runs: run_id, state, started_at. Unknown model data (null, '' or 0) is no mismatch.
    """
    row = lambda df, name, key: df.select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("key"))
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "0") == F.lit(False)
    lang = documents.where("language IS NOT NULL").select("doc_id", F.concat(F.lit("lang:"), F.lower("language")).alias("tag"))
    marked = lambda df, key, name: df.select(key, F.lit(name).alias("store"))
    # ids of three stores side by side, then of documents: one grouping each tells which have what
    ids = marked(chunks, "chunk_id", "c").unionByName(marked(vectors, "chunk_id", "v")).unionByName(marked(fts, "chunk_id", "f"))
    ids = ids.groupBy("chunk_id").agg(*[F.count_if(F.col("store") == k).alias(k) for k in "cvf"])
    cases = [(F.col("v") * (F.col("c") == 0).cast("int"), "vector_without_chunk"), (F.col("c") * (F.col("v") == 0).cast("int"), "chunk_without_vector"), ((F.col("f") > 1).cast("int"), "duplicate_fts"), ((F.col("c") > 1).cast("int"), "duplicate_chunk")]
    listed = F.flatten(F.array(*[F.array_repeat(F.lit(name), n.cast("int")) for n, name in cases]))
    owners = marked(chunks, "doc_id", "c").unionByName(marked(documents, "doc_id", "d")).unionByName(marked(document_tags, "doc_id", "t"))
    owners = owners.groupBy("doc_id").agg(*[F.count_if(F.col("store") == k).alias(k) for k in "cdt"])
    alone = [(F.col("d") * (F.col("c") == 0).cast("int"), "document_without_chunks"), (((F.col("c") > 0) & (F.col("d") == 0)).cast("int"), "chunks_without_document"), (((F.col("t") > 0) & (F.col("d") == 0)).cast("int"), "tag_orphan")]
    listed_owner = F.flatten(F.array(*[F.array_repeat(F.lit(name), n.cast("int")) for n, name in alone]))
    wrong = F.array_compact(F.array(
        F.when(~known("model_version"), "missing_model"), F.when(known("model_version") & (F.col("model_version") != model), "model_mismatch"),
        F.when(known("embedding_dim") & (F.col("embedding_dim") != dim), "dim_mismatch"),
    ))
    each = lambda df, names, key: df.select(F.explode(names).alias("check_name"), F.col(key).cast("string").alias("key"))
    parts = [
        each(ids, listed, "chunk_id"),
        each(chunks, wrong, "chunk_id"),
        each(owners, listed_owner, "doc_id"),
        row(lang.join(document_tags, ["doc_id", "tag"], "left_anti"), "missing_derived_tag", "doc_id"),
        row(stale_runs(runs, now), "stale_run", "run_id"),
        row(runs.where("state = 'FAILED'"), "failed_run", "run_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Findings that are reported but don't count as issues.
QUIET = ("chunks_without_document", "missing_derived_tag", "missing_model")


def store_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, equal): whether two stores hold the same chunks with the same texts (chunk_id, doc_id, text_sha), row counts included."""
    a = left.groupBy("doc_id", "chunk_id", "text_sha").agg(F.count(F.lit(1)).alias("n"))
    b = right.groupBy("doc_id", "chunk_id", "text_sha").agg(F.count(F.lit(1)).alias("m"))
    both = a.join(b, ["doc_id", "chunk_id", "text_sha"], "full_outer")
    return both.groupBy("doc_id").agg(F.min(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("equal"))


def config_issues(settings: Settings = DEFAULTS, model_version: str = "1") -> list[str]:
    """What is wrong with settings that must be sane."""
    tests = {
        "embedding_dim must be above 0": settings.embedding_dim > 0, "model_version is empty": bool(model_version), "top_k must be above 0": settings.top_k > 0,
        "rrf_k must be above 0": settings.rrf_k > 0, "sparse_coverage must be from 0 to 1": 0 <= settings.sparse_coverage <= 1,
    }
    return [k for k, good in tests.items() if not good]


def health_counts(chunks: DataFrame, vectors: DataFrame, fts: DataFrame, sparse: DataFrame, runs: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """One row of counts for :func:`doctor`; chunks, vectors, fts and sparse have chunk_id, findings are :func:`integrity`'s.

    The id sets are unioned with flags and grouped once; nothing is read twice.
    """
    mark = lambda df, name: df.select("chunk_id", F.lit(name).alias("store"))
    every = mark(chunks, "c").unionByName(mark(vectors, "v")).unionByName(mark(fts, "f")).unionByName(mark(sparse.select("chunk_id").distinct(), "s"))
    per = every.groupBy("chunk_id").agg(*[F.count_if(F.col("store") == k).alias(k) for k in "cvfs"])
    total = per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_vectors"), F.count_if((F.col("c") > 0) & (F.col("f") == 0)).alias("fts_missing"),
        F.count_if((F.col("c") == 0) & (F.col("f") > 0)).alias("fts_orphans"), F.count_if((F.col("c") > 0) & (F.col("s") > 0)).alias("n_sparse"),
    )
    grave = F.col("check_name").isin("vector_without_chunk", "chunk_without_vector", "duplicate_chunk")
    light = F.col("check_name").isin("model_mismatch", "dim_mismatch")
    found = findings.agg(F.count_if(grave).alias("n_grave"), F.count_if(light).alias("n_light"))
    state = runs.agg(F.count_if(F.col("state") == "FAILED").alias("n_failed"), F.count_if((F.col("state") == "IN_PROGRESS") & (F.col("started_at") < now - F.expr(f"INTERVAL {DEFAULTS.stale_minutes} MINUTES"))).alias("n_stale"))
    return total.crossJoin(found).crossJoin(state)  # a row each


def doctor(counts: DataFrame, issues: list[str] | None = None, n_hits: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(check_name, status) of eight checks, OK, WARN or FAIL, from :func:`health_counts`, :func:`config_issues` and the hits of a test query (None: not asked)."""
    c = F.col
    empty = c("n_chunks") == 0
    checks = {
        "config": F.lit("FAIL" if (config_issues(settings) if issues is None else issues) else "OK"),
        "docstore": F.when(empty, "WARN").otherwise("OK"),
        "vectors": F.when(c("n_vectors") == 0, "WARN").otherwise("OK"),
        "fts": F.when(empty, "WARN").when(c("fts_missing") == c("n_chunks"), "FAIL").when((c("fts_missing") > 0) | (c("fts_orphans") > 0), "WARN").otherwise("OK"),
        "coverage": F.when(empty | (c("n_sparse") / c("n_chunks") < settings.sparse_coverage), "WARN").otherwise("OK"),
        "reconcile": F.when(c("n_grave") > 0, "FAIL").when(c("n_light") > 0, "WARN").otherwise("OK"),
        "ingest": F.when(c("n_stale") > 0, "FAIL").when(c("n_failed") > 0, "WARN").otherwise("OK"),
        "test_query": F.lit("WARN" if n_hits is None else "OK" if n_hits else "FAIL"),
    }
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("status")) for k, v in checks.items()])).alias("r")).select("r.check_name", "r.status")


def diagnose(chunks: DataFrame, sparse: DataFrame, fts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(section, key, n, total): coverage of each document, spans that several chunks of a document share, model versions, and the stores' sizes.

    chunks: chunk_id, doc_id, line_start, line_end, model_version; the others: chunk_id.
    """
    have = sparse.select("chunk_id").distinct().withColumn("has", F.lit(1))
    row = lambda df, section, key, n, total: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), total.cast("long").alias("total"))
    one = F.lit(1)
    per = chunks.join(have, "chunk_id", "left").groupBy("doc_id").agg(F.sum(F.coalesce("has", F.lit(0))).alias("n"), F.count(one).alias("t"))
    spans = chunks.groupBy("doc_id", "line_start", "line_end").agg(F.count(one).alias("n")).where("n > 1")
    models = chunks.groupBy(F.coalesce(F.nullif(F.trim("model_version"), F.lit("")), F.lit("(unknown)")).alias("m")).agg(F.count(one).alias("n"))
    parts = [
        row(per, "document", F.col("doc_id"), F.col("n"), F.col("t")),
        row(spans, "shared_span", F.concat_ws(":", "doc_id", "line_start", "line_end"), F.col("n"), F.lit(None)),
        row(models, "model", F.col("m"), F.col("n"), F.lit(None)),
        *[row(df.agg(F.count(one).alias("n")), "store", F.lit(name), F.col("n"), F.lit(None)) for name, df in (("chunks", chunks), ("fts", fts), ("vectors", vectors))],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- cache

def config_hash(settings: dict) -> str:
    """SHA-256 of the settings as canonical JSON: sorted keys, compact."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def corpus_fingerprint(chunks: DataFrame, runs: DataFrame, revision: int = 0, run_id: str = "run_id") -> DataFrame:
    """(corpus_fp): number of chunks, largest run (0 without any) and the metadata's revision; it changes with every ingest, deletion and change of tags."""
    last = runs.agg(F.coalesce(F.max(run_id).cast("string"), F.lit("0")).alias("r"))
    both = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(last)  # a row each
    return both.select(F.concat_ws(":", "n", "r", F.lit(str(revision))).alias("corpus_fp"))


def cache_keys(queries: DataFrame, settings: dict, text: str = "text") -> DataFrame:
    """Queries with cache_key: normalised query and every setting that changes the result."""
    from quillon.functions.text import query_hash

    return queries.withColumn("cache_key", F.sha2(F.concat(query_hash(F.col(text)), F.lit(config_hash(settings))), 256))


def cache_lookup(queries: DataFrame, cache: DataFrame, fingerprint: str, now: int, ttl: int = DEFAULTS.cache_ttl_seconds) -> DataFrame:
    """Queries with ``hit``: same key, same corpus fingerprint, and younger than the time to live."""
    live = cache.where((F.col("corpus_fp") == fingerprint) & (F.lit(now) - F.col("created") < ttl)).select("cache_key", F.lit(True).alias("hit")).distinct()
    return queries.join(live, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_set(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries (the cache's columns): each replaces what its key has; of several with one key the last created stays."""
    one = new.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "cache_key"]), "created").alias("e")).select("cache_key", "e.*")
    return cache.join(one.select("cache_key"), "cache_key", "left_anti").select(*cache.columns).unionByName(one.select(*cache.columns))


def cache_invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the entries of these keys (cache_key)."""
    return cache.join(keys.select("cache_key").distinct(), "cache_key", "left_anti").select(*cache.columns)


def cache_clear(cache: DataFrame) -> DataFrame:
    """No entries, the same columns."""
    return cache.limit(0)


def cache_touch(cache: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """Cache rows with the counters of their hits moved on."""
    n = hits.where("hit").groupBy("cache_key").agg(F.count(F.lit(1)).alias("__n"))
    out = cache.join(n, "cache_key", "left")
    return out.withColumn("hits", F.col("hits") + F.coalesce("__n", F.lit(0))).withColumn("last_access", F.when(F.col("__n") > 0, F.lit(now)).otherwise(F.col("last_access"))).drop("__n")


def cache_vacuum(cache: DataFrame, fingerprint: str, now: int, ttl: int = DEFAULTS.cache_ttl_seconds) -> DataFrame:
    return cache.where((F.col("corpus_fp") == fingerprint) & (F.lit(now) - F.col("created") < ttl))


def cache_stats(cache: DataFrame, now: int, ttl: int = DEFAULTS.cache_ttl_seconds) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count_if(F.lit(now) - F.col("created") >= ttl).alias("expired"), F.count_distinct("corpus_fp").alias("fingerprints"))


# -- feedback

def feedback_valid(events: DataFrame) -> DataFrame:
    return events.where(F.col("feedback").isin(*FEEDBACK_KINDS))


def feedback_add(events: DataFrame, new: DataFrame, settings: dict, text: str = "query_text") -> DataFrame:
    """The log with new events of known kinds, numbered on from its last id in the order of their text, chunk and kind, with their query and settings hashes.

    Events of an unknown kind are not added; ``new`` is one batch, small enough to be numbered in one task.
    """
    from quillon.functions.text import query_hash

    normal = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    made = feedback_valid(new).withColumn("normalized_query", normal).withColumn("query_hash", query_hash(F.col(text))).withColumn("retrieval_config_hash", F.lit(config_hash(settings)))
    last = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    order = Window.orderBy(text, "chunk_id", "feedback")
    made = made.crossJoin(last).withColumn("id", (F.col("last") + F.row_number().over(order)).cast("long")).drop("last")  # one row
    return events.unionByName(made, allowMissingColumns=True)


def feedback_clear(events: DataFrame) -> tuple[DataFrame, int]:
    """The empty log, and how many events went."""
    return events.limit(0), events.count()


def feedback_list(events: DataFrame, where: Column | None = None, limit: int = 100) -> DataFrame:
    """Newest first; the limit is the listing's own."""
    out = events if where is None else events.where(where)
    return out.orderBy(F.col("id").desc()).limit(limit)


def feedback_stats(events: DataFrame) -> DataFrame:
    """(feedback, n, queries, chunks): totals under the null kind, and each kind."""
    return events.rollup("feedback").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_hash").alias("queries"), F.count_distinct("chunk_id").alias("chunks"))


def feedback_analysis(rows: DataFrame) -> DataFrame:
    """Share of useful answers and mean score of useful and other ones."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(F.col("useful").cast("double")), 4).alias("useful_percent"),
        F.avg(F.when(F.col("useful"), F.col("final_score"))).alias("mean_useful"), F.avg(F.when(~F.col("useful"), F.col("final_score"))).alias("mean_other"),
    )


def top_chunks(rows: DataFrame, column: str = "chunks_retrieved", n: int = 5) -> DataFrame:
    """The n chunk keys that answers used most, from a JSON list of keys."""
    each = rows.select(F.explode(F.from_json(column, "array<string>")).alias("chunk_key"))
    return each.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk_key").limit(n)
