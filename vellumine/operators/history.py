"""State from event logs: versions, replays, bridges, feedback, refunds, completion checks.

Versions are a scan that spreads hot keys, everything else is an aggregate that combines before
the shuffle, so a key with a third of all rows is no burden to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def versioned(saves: DataFrame, key: str, order: list[str], facts: list[str]) -> DataFrame:
    """Saves that changed a fact, with `version` from 1; null equals null. `order` is unique within a key."""
    kept = scans.changes(saves, key, order, facts)
    return scans.running_sum(kept, key, F.lit(1), order, "version").withColumn("version", F.col("version").cast("int"))


def replays(requests: DataFrame, key: str, fingerprint: str, order: list[str]) -> DataFrame:
    """Requests with `outcome`: FIRST of its key, REPLAY (same fingerprint), or CONFLICT."""
    first = F.min_by(F.struct(*order, fingerprint), F.struct(*order)).alias("__first")
    firsts = requests.groupBy(F.col(key).alias("__key")).agg(first)
    joined = requests.join(firsts, F.col(key).eqNullSafe(F.col("__key")))
    is_first = F.struct(*order).eqNullSafe(F.struct(*[F.col("__first")[c] for c in order]))
    same = F.col(fingerprint).eqNullSafe(F.col("__first")[fingerprint])
    outcome = F.when(is_first, "FIRST").when(same, "REPLAY").otherwise("CONFLICT")
    return joined.withColumn("outcome", outcome).drop("__key", "__first")


def bridged(events: DataFrame, keys: list[str], action: str, order: list[str], adds: str, removes: str) -> DataFrame:
    """Keys whose last add or remove is an add, with the time (first of order) of it."""
    own = events.where(F.col(action).isin(adds, removes))
    last = own.groupBy(*keys).agg(F.max_by(F.struct(action, order[0]), F.struct(*order)).alias("__last"))
    return last.where(F.col("__last")[action] == adds).select(*keys, F.col("__last")[order[0]].alias(order[0]))


def settled(events: DataFrame, keys: list[str], time: str, deleted: Column, feedback: Column, order: list[str]) -> DataFrame:
    """deleted_at (of the first deletion) and feedback (the last one given) of each key."""
    return events.groupBy(*keys).agg(
        F.min(F.when(deleted, F.col(time))).alias("deleted_at"),
        F.max_by(feedback, F.when(feedback.isNotNull(), F.struct(*order))).alias("feedback"),
    )


def refund_errors(ledger: DataFrame, reference: str, debit: Column, refund: Column) -> DataFrame:
    """References with a problem: refunded more than once, or without a debit."""
    n = ledger.groupBy(reference).agg(F.count_if(debit).alias("debits"), F.count_if(refund).alias("refunds"))
    problem = F.when((F.col("debits") == 0) & (F.col("refunds") > 0), "UNMATCHED").when(F.col("refunds") > 1, "REPEATED")
    return n.withColumn("problem", problem).where("problem is not null")


def completion_errors(rows: DataFrame, run: str, item: str, matched: Column, owner: str, most: int) -> DataFrame:
    """Runs that may not be completed, with sorted reasons."""
    runs = rows.groupBy(run).agg(
        F.count("*").alias("n"), F.count_distinct(item).alias("items"), F.count_distinct(owner).alias("owners"),
        F.min(F.coalesce(matched, F.lit(False))).alias("all_matched"),
    )
    checks = {
        "OWNERS": F.col("owners") > 1, "REPEATED": F.col("items") < F.col("n"), "TOO_MANY": F.col("n") > most,
        "UNMATCHED": ~F.col("all_matched"),
    }
    reasons = F.array_compact(F.array(*[F.when(holds, name) for name, holds in checks.items()]))
    return runs.select(run, "n", reasons.alias("reasons")).where(F.size("reasons") > 0)


def renamed_if_unnamed(sources: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Dimension rows: a new name only where the old one is just the key; new keys are added."""
    old, new = sources.select(key, name), names.select(key, F.col(name).alias("__new"))
    shown = F.when(F.col(name).isNull() | (F.col(name) == F.col(key).cast("string")), F.coalesce("__new", name))
    return old.join(new, key, "full_outer").select(key, shown.otherwise(F.col(name)).alias(name))
