"""Quality gates over collected batches, failure rollups, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_top_values

ACCEPT, FALLBACK, SKIP = "ACCEPT", "FALLBACK", "SKIP"
PARSER_EMPTY, STALE = "PARSER_EMPTY", "STALE_PUBLISHED_AT"


def gate(
    rows: DataFrame,
    keys: list[str],
    problems: dict[str, Column],
    stale: Column,
    harmless: list[str] = (),
    expected: DataFrame | None = None,
) -> DataFrame:
    """n, reasons (sorted) and decision of each group.

    SKIP if every row is stale (its only reason then is STALE_PUBLISHED_AT); FALLBACK if any row
    has a problem that isn't harmless; else ACCEPT, with the harmless ones as reasons. expected:
    a row per group that should have rows; one that has none falls back as PARSER_EMPTY. A
    problem or staleness that is null doesn't hold.
    """
    flags = [F.max(F.when(F.coalesce(c, F.lit(False)), F.lit(n))).alias(f"__{n}") for n, c in problems.items()]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.coalesce(stale, F.lit(False))).alias("__stale"), *flags)
    if expected is not None:
        renamed = groups.withColumnsRenamed({k: f"__key_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
        groups = expected.select(*keys).distinct().join(renamed, same, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty = F.col("n") == 0
    found = F.array_sort(F.array_compact(F.array(*[F.col(f"__{n}") for n in problems])))
    grave = F.lit(False)
    for n in problems:
        grave = grave | (F.col(f"__{n}").isNotNull() if n not in harmless else F.lit(False))
    reasons = F.when(empty, F.array(F.lit(PARSER_EMPTY))).when(F.col("__stale"), F.array(F.lit(STALE))).otherwise(found)
    decision = F.when(empty, FALLBACK).when(F.col("__stale"), SKIP).when(grave, FALLBACK).otherwise(ACCEPT)
    return groups.select(*keys, "n", reasons.alias("reasons"), decision.alias("decision"))


def gaps(failures: DataFrame, keys: list[str], who: str, sample: str, k: int = 3, order: list[Column] | None = None) -> DataFrame:
    """Failures per key, most first: n, distinct who, and the first k samples by `order` (else the smallest)."""
    groups = failures.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(who).alias("n_who"))
    samples = failures.where(F.col(sample).isNotNull())
    if order is None:
        samples = samples.select(*keys, sample).distinct()
    return with_top_values(groups, samples, keys, sample, order or [F.col(sample)], k, "samples")


def gap_page(gaps: DataFrame, keys: list[str], number: int, size: int) -> DataFrame:
    """A page of the report: by falling n, then by the keys."""
    return gaps.orderBy(F.col("n").desc(), *keys).offset((number - 1) * size).limit(size)


def failure_kind(message: Column, kinds: dict[str, str], other: str = "OTHER") -> Column:
    """Kind of the first prefix that the message starts with."""
    out = F.when(message.isNull(), F.lit(other))
    for prefix, kind in kinds.items():
        out = out.when(message.startswith(prefix), F.lit(kind))
    return out.otherwise(F.lit(other))


def counted(rows: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """Rows per key with one column per value of `by`."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values])
