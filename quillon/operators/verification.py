"""Checking answers against the chunks they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import CITATION

#: Weights of the trust score and its levels.
WEIGHTS = {"citation": 0.35, "retrieval": 0.30, "consistency": 0.25, "coverage": 0.10}
HIGH, MEDIUM = 0.75, 0.50


def citations(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(qid, cite_no, cite_index, doc_id, heading, line_start, line_end): an answer's citations in order, parts as text."""
    pattern = F.lit(CITATION)
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(text), pattern, F.lit(i)).alias(n) for i, n in enumerate(("cite_index", "doc", "head", "a", "b"), 1)])
    each = answers.select("qid", F.posexplode(parts).alias("cite_no", "c"))
    return each.select("qid", "cite_no", F.col("c.cite_index").alias("cite_index"), F.trim("c.doc").alias("doc_id"), F.trim("c.head").alias("heading"), F.col("c.a").alias("line_start"), F.col("c.b").alias("line_end"))


def fuzzy_path(cited: Column, path: Column) -> Column:
    """Equal, or the cited path is part of the chunk's, whatever the case."""
    return F.contains(F.lower(F.trim(path)), F.lower(F.trim(cited)))


def classify(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add status and chunk_id: the first chunk (by pos) of the same query and document whose path fits decides.

    Both line numbers equal: VALID; one: PARTIAL; none, or no such chunk: INVALID.
    """
    c = chunks.select("qid", F.trim(F.col("doc_id").cast("string")).alias("doc_id"), "chunk_id", "heading_path", "pos", F.col("line_start").cast("string").alias("ls"), F.col("line_end").cast("string").alias("le"))
    same = cited.join(c, ["qid", "doc_id"]).where(fuzzy_path(F.col("heading"), F.coalesce("heading_path", F.lit(""))))
    equal = (F.col("line_start") == F.col("ls")).cast("int") + (F.col("line_end") == F.col("le")).cast("int")
    verdict = F.when(equal == 2, "VALID").when(equal == 1, "PARTIAL").otherwise("INVALID")
    first = same.groupBy("qid", "cite_no").agg(F.min_by(F.struct(verdict.alias("status"), F.col("chunk_id")), "pos").alias("m"))
    out = cited.join(first, ["qid", "cite_no"], "left")
    return out.select(*cited.columns, F.coalesce("m.status", F.lit("INVALID")).alias("status"), F.col("m.chunk_id").alias("chunk_id"))


def consistency(text: Column) -> Column:
    """Score of a judge's ``KEY: value`` reply: 1, 0.5 (something unsupported or contradicted) or 0 (hallucination); null if unreadable.

    Keys are looked up whatever their case; of repeated ones the last counts.
    """
    lines = F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains(":"))

    def value(name: str) -> Column:
        own = F.filter(lines, lambda x: F.upper(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))) == name)
        return F.upper(F.trim(F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"^[^:]*:(.*)$", 1)))

    yes = {k: value(k).isin("SÍ", "SI") for k in ("UNSUPPORTED", "CONTRADICTIONS", "HALLUCINATIONS")}
    read = [F.coalesce(value(k).isin("SÍ", "SI", "NO"), F.lit(False)) for k in yes]
    return F.when(read[0] & read[1] & read[2], F.when(yes["HALLUCINATIONS"], 0.0).when(yes["UNSUPPORTED"] | yes["CONTRADICTIONS"], 0.5).otherwise(1.0))


def min_max(value: str, keys: tuple[str, ...] = ("qid",)) -> Column:
    """The value scaled to 0..1 within the query; a flat list is all ones."""
    w = Window.partitionBy(*keys)
    span = F.max(value).over(w) - F.min(value).over(w)
    return F.when(span > 0, (F.col(value) - F.min(value).over(w)) / span).otherwise(F.when(F.col(value).isNotNull(), 1.0))


def trust(answers: DataFrame, cited: DataFrame, chunks: DataFrame, score: str = "rerank_score", consistent: str = "consistency") -> DataFrame:
    """(qid, citation_score, retrieval_score, consistency_score, coverage_score, trust_score, trust_level) of every answer.

    Citations: the mean of VALID 1, PARTIAL 0.5, INVALID 0 (none: 0.5). Retrieval: the mean of the three best scaled
    scores (one: 1, none: 0.5). Coverage: citations with a chunk over all (none: 0). A missing consistency counts 0.5.
    """
    worth = F.when(F.col("status") == "VALID", 1.0).when(F.col("status") == "PARTIAL", 0.5).otherwise(0.0)
    c = cited.groupBy("qid").agg(F.avg(worth).alias("citation_score"), F.avg(F.col("chunk_id").isNotNull().cast("double")).alias("coverage_score"))
    scaled = chunks.where(F.col(score).isNotNull()).withColumn("scaled", min_max(score))
    r = scaled.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("scaled"), asc=False), 1, 3).alias("best"))
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")
    out = answers.join(c, "qid", "left").join(r, "qid", "left").select(
        "qid", F.coalesce("citation_score", F.lit(0.5)).alias("citation_score"), F.coalesce(mean, F.lit(0.5)).alias("retrieval_score"),
        F.coalesce(F.col(consistent), F.lit(0.5)).alias("consistency_score"), F.coalesce("coverage_score", F.lit(0.0)).alias("coverage_score"),
    )
    total = sum((F.lit(w) * F.col(f"{n}_score") for n, w in WEIGHTS.items()), F.lit(0.0))
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    return out.withColumn("trust_score", F.round(total, 6)).withColumn("trust_level", F.when(F.col("trust_score") >= HIGH, "HIGH").when(F.col("trust_score") >= MEDIUM, "MEDIUM").otherwise("LOW"))


def warnings(n_citations: Column, n_invalid: Column, hallucinated: Column, unsupported: Column, degraded: Column, spread: Column) -> Column:
    """Codes of what a reader should know, in order."""
    return F.array_compact(F.array(
        F.when(n_citations == 0, F.lit("no_citations")), F.when(n_invalid > 0, F.lit("invalid_citations")), F.when(hallucinated, F.lit("hallucination")),
        F.when(unsupported, F.lit("unsupported")), F.when(degraded, F.lit("degraded")), F.when(spread < 0.5, F.lit("low_spread")),
    ))


def evidence_map(cited: DataFrame) -> DataFrame:
    """(qid, evidence): citation number to chunk, document, lines and status."""
    value = F.struct("chunk_id", "doc_id", F.concat_ws("-", "line_start", "line_end").alias("lines"), "status")
    first = cited.groupBy("qid", "cite_index").agg(F.min_by(value, "cite_no").alias("v"))
    return first.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cite_index", "v")))).alias("evidence"))


def bar(share: Column, width: int = 10) -> Column:
    """A share from 0 to 1 as a bar."""
    filled = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def summary_text(cited: DataFrame, scores: DataFrame, chunks: DataFrame, score: str = "rerank_score") -> DataFrame:
    """(qid, block): an answer's verification as lines of text: what was retrieved with scaled scores, citations, consistency, trust.

    ``cited`` from :func:`classify`, ``scores`` from :func:`trust`, ``chunks`` as these had them.
    """
    scaled = chunks.withColumn("s", min_max(score))
    line = F.concat(F.lit("  ["), F.col("pos").cast("string"), F.lit("] "), F.col("doc_id").cast("string"), F.lit(" | "), F.concat_ws("-", "line_start", "line_end"), F.lit("  "), F.format_number(F.col("s") * 10, 1), F.lit("/10 "), bar(F.col("s")))
    listed = scaled.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda r: r["x"]), "\n").alias("list"))
    counts = cited.groupBy("qid").agg(F.count_if(F.col("status") == "VALID").alias("v"), F.count(F.lit(1)).alias("n"))
    rows = scores.join(listed, "qid", "left").join(counts, "qid", "left").fillna(0, ["v", "n"])
    agreed = F.when(F.col("consistency_score") >= 1, "OK").when(F.col("consistency_score") > 0, "WARN").otherwise("FAIL")
    block = F.concat_ws(
        "\n", F.lit("Verification"), F.col("list"), F.concat(F.lit("  Citations: "), F.col("v").cast("string"), F.lit("/"), F.col("n").cast("string")), F.concat(F.lit("  Consistency: "), agreed),
        F.concat(F.lit("  Trust: "), F.format_number("trust_score", 2), F.lit(" "), F.col("trust_level")),
    )
    return rows.select("qid", block.alias("block"))
