"""Top rows, first and last rows, rollups and running sums per key.

Where a third of all rows may share a key, extremes are taken with max_by / min_by, which
combine before the shuffle, and not with a window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scans


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with `rank`; Spark limits each group before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest `by`, which must be unique within it."""
    row = F.max_by(F.struct("*"), F.struct(*by)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(row).select("row.*")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; every row whose key is null stays."""
    keyed = latest_first(rows.where(F.col(key).isNotNull()), key, order)
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def latest_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    row = F.min_by(F.struct("*"), F.struct(*order)).alias("row")
    return rows.groupBy(F.col(key).alias("__key")).agg(row).select("row.*")


def with_top_values(
    groups: DataFrame, rows: DataFrame, keys: list[str], value: str, order: list[Column], k: int, name: str
) -> DataFrame:
    """groups (a row per key) with the array of values of each key's first k rows, empty if it has none.

    Only those k rows are collected. A null key is a key like any other.
    """
    values = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(value).alias("__v")))), lambda r: r["__v"])
    lists = top_of_each(rows, keys, order, k).groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(values.alias("__values"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    found = F.coalesce("__values", F.array().cast(lists.schema["__values"].dataType))
    return groups.join(lists, same, "left").select(*groups.columns, found.alias(name))


def running_sum(rows: DataFrame, key: str, value: str, order: list[str], name: str = "balance") -> DataFrame:
    """Balance after each entry of a ledger; a hot key's entries are spread (see scans)."""
    return scans.running_sum(rows, key, F.col(value), order, name)


def sliding_count(rows: DataFrame, key: str, time: str, seconds: int, name: str = "recent") -> DataFrame:
    """Events of the key within the last `seconds`, the event itself included, older edge not."""
    return scans.sliding_count(rows, key, time, seconds * 1_000_000, name)


def sessions(rows: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key: start, end, n; a pause of gap_seconds or more parts them."""
    return scans.sessions(rows, key, time, gap_seconds * 1_000_000)


def stratified(rows: DataFrame, stratum: str, id_col: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum in the order of a digest of their ids; reruns agree."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string")))
    return top_of_each(rows, [stratum], [digest, F.col(id_col)], k)
