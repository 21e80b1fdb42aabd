"""Faceted browsing: predicates in which a missing fact passes, order, pages, totals, values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import haystack, hit_score


@dataclass(frozen=True)
class FacetQuery:
    """A browse request; every given part is ANDed. Column names are those of the catalogue."""

    any_of: dict[str, list] = field(default_factory=dict)  # null passes
    only: dict[str, list] = field(default_factory=dict)  # null fails
    overlap: dict[str, list] = field(default_factory=dict)  # an empty or null array passes
    span: tuple[str, str, float | None, float | None] | None = None  # low column, high column, from, to
    since: tuple[str, datetime] | None = None
    unknown: str | None = None  # excludes since
    search: tuple[list[str], list[str]] | None = None  # columns, terms

    def __post_init__(self) -> None:
        if self.since and self.unknown:
            raise ValueError("a date can't be both recent and unknown")


def predicate(q: FacetQuery) -> Column:
    parts: list[Column] = [F.lit(True)]
    parts += [F.col(c).isNull() | F.col(c).isin(v) for c, v in q.any_of.items()]
    parts += [F.col(c).isin(v) for c, v in q.only.items()]
    for c, v in q.overlap.items():
        wanted = F.array(*map(F.lit, v))
        empty = F.coalesce(F.size(c), F.lit(0)) <= 0
        parts.append(empty | F.coalesce(F.arrays_overlap(F.col(c), wanted), F.lit(False)))
    if q.span:
        low, high, least, most = q.span
        if least is not None:
            parts.append(F.col(high).isNull() | (F.col(high) >= least))
        if most is not None:
            parts.append(F.col(low).isNull() | (F.col(low) <= most))
    if q.since:
        parts.append(F.col(q.since[0]) >= F.lit(q.since[1]))
    if q.unknown:
        parts.append(F.col(q.unknown).isNull())
    if q.search:
        text = haystack(*map(F.col, q.search[0]))
        parts.append(reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in q.search[1])))
    return reduce(lambda a, b: a & b, parts)


def filtered(items: DataFrame, q: FacetQuery) -> DataFrame:
    return items.where(predicate(q))


def relevance(q: FacetQuery) -> Column:
    columns, wanted = q.search or ([], [])
    return hit_score(haystack(*map(F.col, columns)), F.array(*map(F.lit, wanted))) if wanted else F.lit(0.0)


def by_relevance(items: DataFrame, q: FacetQuery, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the filtered items with `score`, best first, equals by `order` (whose last column is unique)."""
    scored = filtered(items, q).withColumn("score", relevance(q))
    return page(scored, [F.col("score").desc(), *order], number, size)


def page(items: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order; the last column of `order` must be unique."""
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def totals(items: DataFrame, q: FacetQuery) -> DataFrame:
    """total (of the filter) and pool_total in one scan."""
    return items.agg(F.count_if(predicate(q)).alias("total"), F.count("*").alias("pool_total"))


def values(items: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column with the number of rows that have them."""
    return items.select(F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
