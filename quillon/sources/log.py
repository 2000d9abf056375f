"""A commit log: numbered entries, each put by one writer only, in the folder that all machines share.

The entry with the highest number is the state. A writer that has read entry n puts entry n + 1; of two writers one fails
with :class:`~quillon.errors.CommitConflict` and starts over from the new state. An entry is one small file, whole or
unreadable: an unreadable one (its writer died in it) is passed over and its number not used again.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from quillon.errors import CommitConflict


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, path = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def stamp(spark: SparkSession, name: str) -> tuple:
    """Name, size and time of a file, or of each file in a folder: another where a table was written anew."""
    fs, path = _path(spark, name)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def put_if_absent(spark: SparkSession, name: str, text: str) -> None:
    """Create a small file; CommitConflict where there is one of that name already."""
    fs, path = _path(spark, name)
    fs.mkdirs(path.getParent())
    if fs.getScheme() == "file":  # creating and renaming replace what is there on a plain disk; a hard link doesn't
        target = path.toUri().getPath()
        own = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(own, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            raise CommitConflict(f"{name} is there already") from None
        finally:
            os.unlink(own)
        return
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise CommitConflict(f"{name} is there already") from None
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, name: str) -> str:
    fs, path = _path(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class CommitLog:
    """Entries 1, 2, ... of one folder. Every entry is the whole state, so a reader reads one file."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return sorted(int(x[:-5]) for x in names_in(self.spark, self.folder) if x.endswith(".json") and x[:-5].isdigit())

    def entry(self, number: int) -> dict | None:
        """An entry; None where it can't be read."""
        try:
            return json.loads(read_text(self.spark, self._file(number)))
        except (Py4JJavaError, ValueError):
            return None

    def last(self) -> tuple[int, dict]:
        """The highest number used, and the state: the last entry that can be read, empty if there is none."""
        numbers = self.numbers()
        for n in reversed(numbers):
            entry = self.entry(n)
            if entry is not None:
                return numbers[-1], entry
        return (numbers[-1] if numbers else 0), {}

    def put(self, number: int, entry: dict) -> int:
        put_if_absent(self.spark, self._file(number), json.dumps(entry, sort_keys=True))
        return number
