"""Groups of rows that may be one: verdicts, merged rows, references that would clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME_ID, SAME_URL, SAME_FACTS = "SAME_ID", "SAME_URL", "SAME_FACTS"
ID_CONFLICT, FACT_CONFLICT = "ID_CONFLICT", "FACT_CONFLICT"


def verdicts(rows: DataFrame, key: str, source_id: str, url: str, facts: str) -> DataFrame:
    """key, n, verdict and mergeable of every group of two or more.

    One id, and at most one url or equal facts: SAME_ID, else ID_CONFLICT. Without one id: one url
    (SAME_URL), equal facts (SAME_FACTS), else FACT_CONFLICT. Blank ids and urls count as none; urls
    come in normal form. All by counts that combine before the shuffle.
    """
    there = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    n = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(there(source_id)).alias("ids"), F.count_distinct(there(url)).alias("urls"),
        (F.count_distinct(facts) + F.max(F.col(facts).isNull().cast("int"))).alias("contents"),
    )
    same = F.col("contents") == 1
    verdict = (
        F.when((F.col("ids") == 1) & ((F.col("urls") <= 1) | same), SAME_ID)
        .when(F.col("ids") == 1, ID_CONFLICT)
        .when(F.col("urls") == 1, SAME_URL)
        .when(same, SAME_FACTS)
        .otherwise(FACT_CONFLICT)
    )
    fine = F.col("verdict").isin(SAME_ID, SAME_URL, SAME_FACTS)
    return n.where("n > 1").select(key, "n", verdict.alias("verdict")).withColumn("mergeable", fine)


def merged(
    rows: DataFrame,
    key: str,
    id_col: str,
    rank: list[Column],
    earliest: list[str] = (),
    latest: list[str] = (),
    first_known: list[str] = (),
    opened: str | None = None,
) -> DataFrame:
    """One row per key: the winner's (greatest rank, then smallest id) with what the others add.

    earliest and latest take the least and greatest value; first_known the winner's value, or
    where that is null the one of the smallest id that has one; `opened` is OPEN if any row is.
    """
    order = F.struct(*rank, (-F.col(id_col)).alias("__id")) if rank else (-F.col(id_col))
    parts = [F.max_by(F.struct("*"), order).alias("__row")]
    parts += [F.min(c).alias(f"__min_{c}") for c in earliest] + [F.max(c).alias(f"__max_{c}") for c in latest]
    parts += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(id_col))).alias(f"__first_{c}") for c in first_known]
    if opened:
        parts.append(F.max(F.coalesce(F.col(opened) == "OPEN", F.lit(False))).alias("__open"))
    groups = rows.groupBy(F.col(key).alias("__key")).agg(*parts)

    def value(c: str) -> Column:
        own = F.col("__row")[c]
        if c in earliest:
            return F.col(f"__min_{c}")
        if c in latest:
            return F.col(f"__max_{c}")
        if c in first_known:
            return F.coalesce(own, F.col(f"__first_{c}"))
        return F.when(F.col("__open"), "OPEN").otherwise(own) if c == opened else own

    return groups.select(*[value(c).alias(c) for c in rows.columns])


def merged_values(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key and value, one row for each distinct value of an array column in each group."""
    return rows.select(key, F.explode(values).alias("value")).distinct()


def reference_conflicts(references: DataFrame, winners: DataFrame, id_col: str, owners: list[str]) -> DataFrame:
    """winner and column of groups that would refer twice to one owner once they are merged.

    winners: id_col and winner of every row of a group. Any of the owner columns clashes by itself.
    """
    moved = references.join(winners, id_col)
    each = [moved.select("winner", F.lit(c).alias("owner"), F.col(c).cast("string").alias("value")) for c in owners]
    every = each[0]
    for one in each[1:]:
        every = every.unionByName(one)
    twice = every.where(F.col("value").isNotNull()).groupBy("winner", "owner", "value").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("winner", "owner").agg(F.count("*").alias("clashes"))
