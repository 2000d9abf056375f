"""Reading documents, manifests and suites; writing reports. Paths are anything that Spark can open."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import SuiteInvalid
from quillon.functions.text import clean_markdown

# File names that count as Markdown.
MARKDOWN = "*.{md,mdown,markdown}"

MANIFEST = "doc_id string, hash string, path string, size long, ingested_at string, cleaned_path string"
SUITE = (
    "id string, text string, category string, language string, suite string, validated boolean, expected_behavior string, "
    "doc_relevance map<string,int>, chunk_relevance map<string,int>"
)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, raw_size, readable, text, md5, doc_id (file stem) of every Markdown file of a folder (not below) or of one file, by path.

    A file that is no UTF-8 has a null text and readable false; nothing is raised per row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", MARKDOWN).load(path)
    text = F.expr("try_validate_utf8(cast(content AS string))")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", F.col("length").alias("raw_size"), text.isNotNull().alias("readable"), text.alias("text"), F.md5("content").alias("md5"), F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id")
    )


def cleaned(files: DataFrame) -> DataFrame:
    """Files with images embedded as base64 taken out, and the percentage that this saved; blank ones are marked, not raised."""
    out = files.withColumn("clean", clean_markdown(F.col("text")))
    before = F.octet_length("text")
    saved = F.when(before > 0, (1 - F.octet_length("clean") / before) * 100).otherwise(0.0)
    return out.withColumn("size_reduction", saved).withColumn("rejected", F.trim(F.coalesce("text", F.lit(""))) == "")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines manifest: unreadable lines are passed over, the last line of a document counts."""
    raw = spark.read.schema(MANIFEST).json(path)
    last = Window.partitionBy("doc_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.xxhash64("hash", "path"))
    return raw.where("doc_id IS NOT NULL").withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upsert_manifest(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with new entries; those with an unchanged hash keep the old line."""
    changed = new.join(manifest.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")
    return manifest.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed, allowMissingColumns=True)


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """A query suite from YAML or JSON: a list, or a mapping with ``queries``. An empty one is an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    rows = found.get("queries", []) if isinstance(found, dict) else found or []
    if not rows:
        raise SuiteInvalid(f"no queries in {path}")
    names = [c.strip().split(" ")[0] for c in SUITE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SUITE)


def suite_filter(suite: DataFrame, name: str | None = None, validated_only: bool = False) -> DataFrame:
    """Queries of a suite; a missing suite is ``official``, a missing mark counts as validated."""
    out = suite if name is None else suite.where(F.coalesce("suite", F.lit("official")) == name)
    return out.where(F.coalesce("validated", F.lit(True))) if validated_only else out


def eval_samples(suite: DataFrame) -> DataFrame:
    """Validated queries with the documents that a good answer uses: those of grade 2 and above."""
    wanted = F.array_sort(F.map_keys(F.map_filter("doc_relevance", lambda k, v: v >= 2)))
    return suite_filter(suite, "official", True).withColumn("expected_doc_ids", F.coalesce(wanted, F.array().cast("array<string>")))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def runs_overview(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, n_errors, mean_trust over rows without an error) of the evaluation runs under a path, newest name first."""
    rows = spark.read.schema("query_id string, trust_score double, error string").json(path).select("*", F.col("_metadata.file_name").alias("file"))
    ok = F.coalesce("error", F.lit("")) == ""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("n_errors"), F.avg(F.when(ok, F.col("trust_score"))).alias("mean_trust")).orderBy(F.desc("file"))


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table, for reports."""
    found = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])


ANSWER_FEEDBACK = "question string, rewritten_query string, hyde_used boolean, chunks_retrieved string, final_score double, score_level string, useful boolean, timestamp string"


def save_answer_feedback(rows: DataFrame, path: str) -> None:
    """More entries of the log of judged answers; the chunks are a JSON list of keys."""
    names = [c.split(" ")[0] for c in ANSWER_FEEDBACK.split(", ")]
    rows.select(*names).write.mode("append").json(path)


def read_answer_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER_FEEDBACK).json(path)


def write_index_config(spark: SparkSession, settings: dict[str, object], path: str) -> None:
    """What an index was built with, beside it, for :func:`quillon.plans.ingest.config_diff`."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").text(path)


def read_index_config(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path).first()[0])
