"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: a lost executor costs a re-read, never a rerun of the
stages before, and no task depends on a machine's own disk.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scopes that are open, each with the tables written since it began.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and one machine runs everything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    root = shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")
    return {f.rsplit("/", 1)[0] for f in df.inputFiles() if root in f}


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    for folder in _folders(df):
        _delete(df.sparkSession, folder)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but those put into the list that this gives."""
    written: list[str] = []
    kept: list[DataFrame] = []
    _scopes.append(written)
    try:
        yield kept
    finally:
        _scopes.remove(written)
        names = {f.rstrip("/").rsplit("/", 1)[-1] for df in kept for f in _folders(df)}
        for folder in written:
            if folder.rsplit("/", 1)[-1] not in names:
                _delete(spark, folder)
