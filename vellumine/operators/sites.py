"""Links and the companies, hosts and sources behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_host


def domains_of(host: Column) -> Column:
    """The host and every domain above it, longest first; empty for no host."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(F.coalesce(host, F.lit("")) != "", tails).otherwise(F.array().cast("array<string>"))


def company_profiles(rows: DataFrame, id_col: str, url: str, name: str, profiles: DataFrame) -> DataFrame:
    """id and profile of rows whose host is under a profile's domain and whose name has its alias.

    profiles: ordinal, profile, domain, alias (lower case). Of several the smallest ordinal wins;
    rows without one are left out. Hosts meet domains by equality, so no pairs are tried in vain.
    """
    domain = F.explode(domains_of(url_host(F.col(url)))).alias("domain")
    own = rows.select(F.col(id_col), F.lower(F.col(name)).alias("__name"), domain)
    met = own.join(profiles, "domain").where(F.contains(F.col("__name"), F.col("alias")))
    return met.groupBy(id_col).agg(F.min_by("profile", "ordinal").alias("profile"))


def shared_hosts(rows: DataFrame, url: str, path: Column) -> DataFrame:
    """Hosts whose links have two or more different paths: host, n, paths, first and last path."""
    named = rows.select(url_host(F.col(url)).alias("host"), path.alias("__path")).where("host != ''")
    out = named.groupBy("host").agg(
        F.count("*").alias("n"), F.count_distinct("__path").alias("paths"),
        F.min("__path").alias("first_path"), F.max("__path").alias("last_path"),
    )
    return out.where("paths > 1")


def source_names(rows: DataFrame, source: str, platform: Column, default: Column) -> DataFrame:
    """A source's name: its platform if all rows that name one name the same, else the default."""
    kinds = rows.groupBy(source).agg(
        F.count_distinct(platform).alias("__n"), F.min(platform).alias("__name"), F.min(default).alias("__default")
    )
    return kinds.select(source, F.when(F.col("__n") == 1, F.col("__name")).otherwise(F.col("__default")).alias("name"))


def filled_vectors(
    rows: DataFrame, id_col: str, text: str, vector: str, load: Callable[[], Callable[[list[str]], np.ndarray]], size: int
) -> DataFrame:
    """id and vector of every row; null vectors are made from the texts by an encoder.

    load runs once a task; its encoder gets the texts of a batch and must return rows of `size`
    finite numbers, else the task fails. Null text is empty.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for f in frames:
            made = np.asarray(encode(f["__text"].fillna("").tolist()), dtype=np.float32)
            if made.shape != (len(f), size) or not np.isfinite(made).all():
                raise ValueError(f"the encoder must return {size} finite numbers a text")
            yield pd.DataFrame({id_col: f[id_col], vector: list(made)})

    kind = rows.schema[id_col].dataType.simpleString()
    missing = rows.where(F.col(vector).isNull()).select(id_col, F.col(text).cast("string").alias("__text"))
    made = missing.mapInPandas(each, f"{id_col} {kind}, {vector} array<float>")
    there = rows.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<float>").alias(vector))
    return there.unionByName(made)
