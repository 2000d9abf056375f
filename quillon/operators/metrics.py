"""Retrieval quality, latency and comparison metrics as set operations over (variant, qid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The regression gate's limits (metric, kind of change, limit, severity).
GATE = (
    ("recall@5", "drop", 0.02, "FAIL"),
    ("recall@10", "drop", 0.03, "WARN"),
    ("recall@30", "drop", 0.03, "WARN"),
    ("ndcg@10", "drop", 0.02, "FAIL"),
    ("mrr", "drop", 0.03, "FAIL"),
    ("latency_p95", "rise", 0.25, "WARN"),
    ("latency_p99", "rise", 0.30, "WARN"),
)


def grade(hits: DataFrame, doc_grades: DataFrame, chunk_grades: DataFrame | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add ``grade`` to hits (keys, chunk_id, doc_id, pos).

    A chunk's own grade (qid, chunk_id, grade) overrides; a document's grade (qid, doc_id, grade) counts once, at its
    first hit, and not at all after a chunk of it was judged.
    """
    out = hits.join(doc_grades.select("qid", "doc_id", F.col("grade").alias("doc_grade")), ["qid", "doc_id"], "left")
    if chunk_grades is None:
        out = out.withColumn("chunk_grade", F.lit(None).cast("int"))
    else:
        out = out.join(chunk_grades.select("qid", "chunk_id", F.col("grade").alias("chunk_grade")), ["qid", "chunk_id"], "left")
    before = Window.partitionBy(*keys, "doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("chunk_grade").isNotNull() | F.col("doc_grade").isNotNull()
    seen = F.coalesce(F.max(counts).over(before), F.lit(False))
    value = F.when(F.col("chunk_grade").isNotNull(), F.col("chunk_grade")).when(~seen, F.coalesce("doc_grade", F.lit(0))).otherwise(0)
    return out.withColumn("grade", value)


def recall_at(hits: DataFrame, doc_grades: DataFrame, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, recall): share of the relevant documents (grade > 0) among the first k; none relevant: 0."""
    relevant = doc_grades.where("grade > 0").groupBy("qid").agg(F.count_distinct("doc_id").alias("relevant"))
    good = doc_grades.where("grade > 0").select("qid", "doc_id").distinct()
    found = hits.where(F.col("pos") <= k).join(good, ["qid", "doc_id"], "left_semi").groupBy(*keys).agg(F.count_distinct("doc_id").alias("found"))
    every = hits.select(*keys).distinct()
    share = F.when(F.col("relevant") > 0, F.coalesce("found", F.lit(0)) / F.col("relevant")).otherwise(0.0)
    return every.join(found, list(keys), "left").join(relevant, "qid", "left").select(*keys, F.coalesce(share, F.lit(0.0)).alias("recall"))


def reciprocal_rank(hits: DataFrame, doc_grades: DataFrame, chunk_grades: DataFrame | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, mrr): one over the position of the first hit whose chunk grade, or else document grade, is above 0; repeats count."""
    out = hits.join(doc_grades.select("qid", "doc_id", F.col("grade").alias("g")), ["qid", "doc_id"], "left")
    if chunk_grades is not None:
        out = out.join(chunk_grades.select("qid", "chunk_id", F.col("grade").alias("cg")), ["qid", "chunk_id"], "left").withColumn("g", F.coalesce("cg", "g"))
    return out.groupBy(*keys).agg(F.coalesce(1.0 / F.min(F.when(F.col("g") > 0, F.col("pos"))), F.lit(0.0)).alias("mrr"))


def ndcg_at(graded: DataFrame, doc_grades: DataFrame, k: int, chunk_grades: DataFrame | None = None, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, ndcg): linear gain over log2; the ideal is all of a query's chunk and document grades in descending order."""
    gain = graded.where(F.col("pos") <= k).groupBy(*keys).agg(F.sum(F.col("grade") / F.log2(F.col("pos") + 1)).alias("dcg"))
    every = doc_grades.select("qid", "grade")
    if chunk_grades is not None:
        every = every.unionByName(chunk_grades.select("qid", "grade"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc()))
    ideal = every.where("grade > 0").withColumn("r", rank).where(F.col("r") <= k).groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("idcg"))
    out = gain.join(ideal, "qid", "left")
    return out.select(*keys, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def nearest_rank(value: str | Column, p: float) -> Column:
    """The percentile by nearest rank, rounded to two places."""
    text = value if isinstance(value, str) else None
    return F.round(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {text})"), 2)


def floor_rank(value: str, p: int) -> Column:
    """The value at index floor(p/100 * (n - 1)): the timing log's percentile."""
    listed = F.sort_array(F.collect_list(value))
    return F.element_at(listed, F.floor(F.lit(p) / 100 * (F.size(listed) - 1)).cast("int") + 1)


def latency_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(nearest_rank(value, 50).alias("p50"), nearest_rank(value, 95).alias("p95"), nearest_rank(value, 99).alias("p99"), F.round(F.avg(value), 2).alias("mean"))


def timing_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentiles of a timing log; lists of one key must fit a task, so keys are phases of a bounded log."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), floor_rank(value, 50).alias("p50"), floor_rank(value, 95).alias("p95"), floor_rank(value, 99).alias("p99")
    )


def signal_coverage(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the hits that each signal found."""
    return hits.groupBy(*keys).agg(*[F.avg(F.col(f"{s}_rank").isNotNull().cast("double")).alias(f"{s}_coverage") for s in ("dense", "bm25", "sparse") if f"{s}_rank" in hits.columns])


def diversity_stats(hits: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Distinct documents among the first k, and the most chunks of one document."""
    per = hits.where(F.col("pos") <= k).groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_docs"), F.max("n").alias("max_chunks_same_doc"))


def rollup(per_query: DataFrame, metrics: list[str], by: str = "variant", category: str = "category") -> DataFrame:
    """Means per variant (category null) and per category, in one pass over grouping sets; four places."""
    out = per_query.rollup(by, category).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], F.grouping_id().alias("level"))
    return out.where("level < 3").select(by, F.when(F.col("level") == 0, F.coalesce(category, F.lit("unknown"))).alias(category), "n_queries", *metrics)


def calibrate(ranked: DataFrame, grid: DataFrame) -> DataFrame:
    """Fuse the same three rankings under every configuration (config_id, rrf_k, dense_w, bm25_w, sparse_w): rankings are computed once."""
    share = lambda rank, w: F.coalesce(F.col(w) / (F.col("rrf_k") + F.col(rank)), F.lit(0.0))
    every = ranked.crossJoin(F.broadcast(grid))  # a grid of some hundred rows
    every = every.withColumn("rrf_score", share("dense_rank", "dense_w") + share("bm25_rank", "bm25_w") + share("sparse_rank", "sparse_w"))
    far = F.lit((1 << 31) - 1)
    ties = [F.coalesce(c, far) for c in ("dense_rank", "bm25_rank", "sparse_rank")]
    order = Window.partitionBy("config_id", "qid").orderBy(F.round("rrf_score", 12).desc(), *ties, "chunk_id")
    return every.withColumn("pos", F.row_number().over(order))


def recommend(results: DataFrame) -> DataFrame:
    """(pick, config_id): the best by nDCG (then MRR, recall@5, p50, number), the best (recall@5, nDCG), and a balance that slow configurations lose by a tenth."""
    balance = (0.4 * F.col("ndcg@10") + 0.4 * F.col("mrr") + 0.2 * F.col("recall@5")) * F.when(F.col("p50") >= 20, 0.9).otherwise(1.0)
    rest = [F.col("`ndcg@10`"), F.col("mrr"), F.col("`recall@5`"), -F.col("p50"), -F.col("config_id")]
    best = lambda *first: F.max_by("config_id", F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*first, *rest])]))
    one = results.agg(best().alias("ndcg"), best(F.col("`recall@5`"), F.col("`ndcg@10`")).alias("recall"), best(F.round(balance, 12)).alias("balanced"))
    return one.select(F.expr("stack(3, 'best_ndcg', ndcg, 'best_recall', recall, 'balanced', balanced) AS (pick, config_id)"))


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, baseline, current, change, severity): strict limits; a metric that the baseline lacks is passed over, one that the run lacks warns."""
    spark = current.sparkSession
    limits = spark.createDataFrame(list(GATE), "metric string, kind string, lim double, level string")
    both = F.broadcast(limits).join(baseline.select("metric", F.col("value").alias("baseline")), "metric").join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    change = F.when(F.col("kind") == "drop", F.col("baseline") - F.col("current")).otherwise(F.when(F.col("baseline") > 0, (F.col("current") - F.col("baseline")) / F.col("baseline")))
    worse = F.when(F.col("current").isNull(), "WARN").when(F.round(change, 12) > F.col("lim"), F.col("level")).otherwise("OK")
    return both.select("metric", "baseline", "current", F.round(change, 6).alias("change"), worse.alias("severity"))


def gate_exit(rows: DataFrame) -> DataFrame:
    """(exit_code): 0 all well, 1 a warning, 2 a failure."""
    return rows.agg(F.coalesce(F.max(F.when(F.col("severity") == "FAIL", 2).when(F.col("severity") == "WARN", 1).otherwise(0)), F.lit(0)).alias("exit_code"))


def query_review(hits: DataFrame, doc_grades: DataFrame, k: int = 5) -> DataFrame:
    """(qid, displaced, intruders, over_represented, top_intruder) of each query's first k."""
    top = hits.where(F.col("pos") <= k)
    per = top.groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    good = doc_grades.where("grade > 0").select("qid", "doc_id", F.lit(1).alias("good"))
    mixed = per.join(good, ["qid", "doc_id"], "left")
    shown = mixed.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("good").isNull(), F.col("doc_id")))).alias("intruders"), F.array_sort(F.collect_list(F.when(F.col("n") > 2, F.col("doc_id")))).alias("over_represented"),
        F.min_by("doc_id", F.when(F.col("good").isNull(), F.struct((-F.col("n")).alias("n"), F.col("first")))).alias("top_intruder"), F.collect_list("doc_id").alias("shown"),
    )
    wanted = good.groupBy("qid").agg(F.collect_list("doc_id").alias("wanted"))
    return shown.join(wanted, "qid", "left").select("qid", F.array_sort(F.array_except(F.coalesce("wanted", F.expr("slice(shown, 1, 0)")), "shown")).alias("displaced"), "intruders", "over_represented", "top_intruder")


def answer_diagnostics(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, median, population deviation, extremes and interpolated p10 and p90."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"),
    )


def applicability(rows: DataFrame, flag: str, value: str) -> DataFrame:
    """Mean over all rows and over those to which the metric applies (a missing flag: it does), nulls left out."""
    applies = F.coalesce(F.col(flag), F.lit(True))
    return rows.agg(F.avg(value).alias("mean_all"), F.avg(F.when(applies, F.col(value))).alias("mean_applicable"), F.count_if(applies).alias("n_applicable"), F.count(F.lit(1)).alias("n_all"))


def diagnosis(length: Column, citations: Column, delta: Column, score: Column, in_corpus: Column) -> Column:
    """Why an answer scored low: the first cause that holds."""
    return (
        F.when(~in_corpus, "out_of_corpus").when(length > 2500, "too_long").when(length < 300, "too_short").when(citations > 8, "many_citations").when(delta > 0.05, "citation_noise").when(score < 0.60, "off_topic").otherwise("too_broad")
    )


def audit(out_of_corpus: Column, no_info: Column, hallucinated: Column, n_citations: Column, n_valid: Column, n_invalid: Column, level: Column, ambiguous: Column) -> Column:
    """PASS, WARN or FAIL of an answer's verification."""
    return (
        F.when(out_of_corpus, F.when(no_info, "PASS").otherwise("WARN")).when(hallucinated, "FAIL").when(n_citations == 0, "FAIL").when(n_invalid == n_citations, "FAIL").when(level == "LOW", "WARN")
        .when(ambiguous, F.when(n_valid >= 1, "PASS").otherwise("FAIL")).when(n_valid == n_citations, "PASS").otherwise("WARN")
    )
