"""Token counts behind a digest cache.

A text's key is the digest of its normalised content with the digest of the tokenizer's file.
Keys are joined to the counts stored in the cache folder; each distinct key that misses is
encoded once, however many documents share it, and appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, scratch_path
from .tokenizing import version, word_counter

LIMIT = 2048
CACHE = "tokenizer string, digest binary, n_tokens long"


def spaces_as_one(text: Column) -> Column:
    """Normalisation that cannot change a count where the tokenizer drops white space."""
    return F.trim(F.regexp_replace(text, f"{ASCII_SPACE}+", " "))


def stored(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The rows of a cache folder; none if there is no such folder yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_dir: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Null text is empty and has no tokens. cache_dir: a shared folder that is read first and
    appended to; None takes a new one. The folder may hold a key twice (two runs at once):
    counts of one key are equal, and one is used. An empty table gives no rows and stores
    nothing; other columns are ignored; rows may repeat.
    """
    spark = docs.sparkSession
    cache_dir = cache_dir or scratch_path(spark, "token-counts")
    key = version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    normal = spaces_as_one(text)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(normal, 256)).alias("digest"), normal.alias("text"),
    )
    marks = cut(texts.drop("text"), "token-marks")

    def known() -> DataFrame:
        rows = stored(spark, cache_dir).where(F.col("tokenizer") == key)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"))
    missing = cut(first.join(known(), "digest", "left_anti").withColumnRenamed("digest", "d"), "token-misses")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last = word_counter(tokenizer_path), None
        for b in batches:
            found = []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1)):
                if digest != last:  # the join leaves rows that repeat id and text side by side
                    found.append((digest, counter.count(t.as_py())))
                last = digest
            kinds = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds.field(k).type) for k in (0, 1)], schema=kinds)

    # one text a key: the row of its smallest id, which spreads copies' keys evenly
    ours = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("d"))
    once = texts.join(missing, ours, "left_semi").select("digest", "text")
    new = once.mapInArrow(encoded, "digest binary, n_tokens long")
    # where the join is done in another way such rows may be encoded twice: their key is stored once
    new = new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select(F.lit(key).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)
    # of distinct keys, and written, so that the last join has exchanges whose hot keys can be split
    counts = cut(first.select("digest").join(known(), "digest"), "token-known")
    return marks.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
