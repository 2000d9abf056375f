"""The corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents, in their order and with their types. For all stages: an empty table stays empty; repeated rows are
judged alike; columns beside doc_id, text, lang and n_chars travel as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontam, langid, neardup, substr
from quillon.llm.queries import tokenizer_file
from quillon.llm.store import materialize, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from all labelled rows; a row goes if its text is null or has no letter, or if it is long enough
    to tell and its best cosine is below what labelled texts score (half of what all but a hundredth of them reach).

    Ties go to the first language in alphabetical order, so they decide no row. Where no row is labelled, none can be judged: all stay.
    """
    prototypes = langid.fit(docs)
    return langid.keep_known(docs, prototypes, least=langid.rejection(docs, prototypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id.

    Null texts and texts without words are one component. Of rows with that smallest id, the one with the smallest text
    hash stays; a component of null ids alone keeps one row.
    """
    return neardup.dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 13-word window of an earlier document go from the text; n_chars follows the text.

    All rows stay. Null texts stay null; rows with a null id lose nothing and count for no other; rows with equal ids
    don't count as earlier for one another.
    """
    return substr.rewrite(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null texts stay, and so do all rows where the benchmark is empty; rows are told apart by id and text, null ids too.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, decoded again, as digests: a row per row; a null text counts as empty."""
    return bpe.digests(docs, tokenizer_file())


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Language profiles and SimHash are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder before the next one reads it, and
    what it needed in between is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
