"""Session helpers shared by the whole package."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import SharedFolderMissing

#: A batch that Spark hands to Python ends at this many rows or bytes, whichever comes first: what a worker holds follows these, not the input.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Rows of ids and numbers that are sent to all executors rather than that a table of the corpus is shuffled to meet them.
BROADCAST_ROWS = 1 << 18

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Bound the Arrow batches, and let Python workers import this package where it is not installed (single-machine runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where none is set and one machine runs everything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise SharedFolderMissing("spark.checkpoint.dir must name a folder that all machines share")
    own = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`written` gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """A table that :func:`written` gave, to be broadcast while it has BROADCAST_ROWS rows at most; beyond, Spark decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
