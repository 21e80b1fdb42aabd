"""Incremental feeds with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import changed, merge, without_repeats


def files(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Number and sum of values per tumbling window and key; rows later than `late` are dropped."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = at.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_available(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Handles all that is there now, in batches, and stops; a rerun goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what the stream yields for all that is there now as Parquet files."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merging(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, content: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges into the latest snapshot and writes the next one.

    write must be idempotent in the batch number, so that a repeated batch has no effect. A batch
    that holds a key with different contents fails with ValueError before anything is written.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(merge(read(), without_repeats(batch, key, content), key, content).drop("merge_action"), number)

    return each


def due(records: DataFrame, state: DataFrame, id_col: str, hash_col: str, time: str, cutoff: str) -> DataFrame:
    """Records strictly after the cutoff date that are new, changed or failed."""
    recent = records.where(F.to_date(time) > F.lit(cutoff).cast("date"))
    return changed(recent, state, id_col, hash_col)
