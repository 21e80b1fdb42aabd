"""Files beside tables: a scratch folder, small texts, listings, through whatever file system Spark has."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one is made here only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (base or _own_folder()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside send Python workers so many rows at once at most, for rows that are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, most) if before > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Files:
    """Whole small files and listings on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a new file as a whole: readers see all of it or none. False if it is there already."""
        hidden = self._path(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        done = not self._fs.exists(target) and bool(self._fs.rename(hidden, target))
        if not done:
            self._fs.delete(hidden, False)
        return done

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(name), True))
