"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
ASCII_SPACE = r"[\x20\x09-\x0D]"
ASCII_WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many narrow rows may be broadcast (a few MB).
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where the session names none and all of it runs on one machine a folder is made here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (base or _own_folder()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    Unlike a local checkpoint the table outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files as they end, not some time after.

    For queries whose result is small or written, so that nothing reads the files again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_scratch(spark: SparkSession, folder: str | None = None) -> bool:
    """Deletes all tables that operators wrote to the scratch folder; results not yet written are lost.

    Returns whether there was anything. Only names that scratch_path makes are deleted.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder or scratch_folder(spark)}/*-{'[0-9a-f]' * 32}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(path) or []
    return any([files.delete(f.getPath(), True) for f in found])


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else df: the join then shuffles
    and adaptive execution splits its skewed partitions. df must be cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
