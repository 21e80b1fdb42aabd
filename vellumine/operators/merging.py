"""Identity and content keys, idempotent merge, duplicate reconciliation, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_top_values

OPEN = "OPEN"


def canonical(*columns: Column) -> Column:
    """One text of several facts, a JSON list: null differs from empty, order counts, separators are escaped."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def digest(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def identity_key(scope: Column, source_id: Column, url: Column, facts: list[Column]) -> Column:
    """Digest of the strongest evidence: source id, else url, else all facts; a blank one counts as none.

    Give normal forms: identity.identifier, text.normal_url, identity.plain.
    """
    return (
        F.when(F.trim(source_id) != "", digest(F.lit("id"), scope, source_id))
        .when(F.trim(url) != "", digest(F.lit("url"), scope, url))
        .otherwise(digest(F.lit("facts"), scope, *facts))
    )


def conflicts(batch: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that a batch holds with different contents; such a batch must not be merged."""
    n = F.count_distinct(content) + F.max(F.col(content).isNull().cast("int"))
    return batch.groupBy(key).agg(n.alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull())


def without_repeats(batch: DataFrame, key: str, content: str) -> DataFrame:
    """The batch with one row a key (all rows whose key is null stay); ValueError if a key has two contents."""
    odd = conflicts(batch, key, content).limit(3).collect()
    if odd:
        raise ValueError(f"conflicting contents of {key}: {[r[key] for r in odd]}")
    keyed = batch.where(F.col(key).isNotNull())
    columns = batch.columns
    row = F.min(F.struct(*columns)).alias("__row")  # of rows with one content the smallest, so reruns agree
    once = keyed.groupBy(F.col(key).alias("__key")).agg(row).select(*[F.col("__row")[c].alias(c) for c in columns])
    return once.unionByName(batch.where(F.col(key).isNull()))


def merge(
    target: DataFrame,
    batch: DataFrame,
    key: str,
    content: str,
    keep: list[str] = (),
    provenance: list[str] = (),
    status: str | None = None,
    invalidated: list[str] = (),
) -> DataFrame:
    """New snapshot of target: all columns and merge_action.

    Rows of batch are CREATED, UPDATED or UNCHANGED; rows it doesn't have are KEPT, never closed.
    A row is updated if its content differs, a column of `provenance` does, or `status` isn't
    OPEN, which it then becomes. Columns in `keep` hold their old value where the new one is
    null; those in `invalidated` (as vectors made from the facts) hold it while the content is
    the same, else they are null. Null keys match nothing: such rows are CREATED or KEPT.
    """
    old = target.withColumn("__there", F.lit(True)).alias("o")
    new = batch.withColumn("__came", F.lit(True)).alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, came = F.col("__there").isNotNull(), F.col("__came").isNotNull()
    same_content = F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}"))

    def value(c: str) -> Column:
        if c in invalidated:
            return F.when(~came | same_content, F.col(f"o.{c}"))
        if c == status:
            return F.when(came, F.lit(OPEN)).otherwise(F.col(f"o.{c}"))
        incoming = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.col(f"n.{c}")
        return F.when(came, incoming).otherwise(F.col(f"o.{c}"))

    same = same_content
    for c in provenance:
        same = same & F.col(f"o.{c}").eqNullSafe(value(c))
    if status:
        same = same & F.col(f"o.{status}").eqNullSafe(F.lit(OPEN))
    action = F.when(~came, "KEPT").when(~there, "CREATED").when(same, "UNCHANGED").otherwise("UPDATED")
    return joined.select(*[value(c).alias(c) for c in target.columns], action.alias("merge_action"))


def union_ignoring_order(a: Column, b: Column) -> Column:
    """Sorted distinct values of two arrays; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def completeness(*columns: Column) -> Column:
    """How many of the facts are there (not null, not blank)."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), 1).otherwise(0)
    return total


def duplicate_report(rows: DataFrame, key: str, id_col: str, rank: list[Column], k: int = 3) -> DataFrame:
    """Groups of two or more: key, winner (greatest rank, then id), n, and the k smallest ids; memberships has all.

    Only those k ids are collected, whatever a group's size.
    """
    winner = F.max_by(id_col, F.struct(*rank, F.col(id_col))).alias("winner")
    groups = rows.groupBy(key).agg(winner, F.count("*").alias("n")).where("n > 1")
    ids = rows.select(key, id_col).where(F.col(id_col).isNotNull()).distinct()
    return with_top_values(groups, ids, [key], id_col, [F.col(id_col)], k, "ids")


def memberships(rows: DataFrame, key: str, id_col: str, rank: list[Column]) -> DataFrame:
    """id_col and winner (as in duplicate_report) of every row in a group of two or more, without arrays.

    The join is null-safe (a null key is one group), and so shuffles apart from the aggregate:
    a hot group's rows can be split.
    """
    winner = F.max_by(id_col, F.struct(*rank, F.col(id_col)))
    groups = rows.groupBy(F.col(key).alias("__key")).agg(winner.alias("winner"), F.count("*").alias("__n")).where("__n > 1")
    members = rows.select(F.col(key), F.col(id_col)).where(F.col(id_col).isNotNull())
    return members.join(groups, F.col(key).eqNullSafe(F.col("__key"))).select(id_col, "winner").distinct()


def repointed(references: DataFrame, winners: DataFrame, id_col: str, unique: list[str], order: list[str] = ()) -> DataFrame:
    """References moved to their group's winner (id_col, winner).

    Of those that then agree in `unique` the first by `order` (then by all columns) stays.
    """
    moved = references.join(winners, id_col, "left").withColumn(id_col, F.coalesce("winner", id_col)).drop("winner")
    row = F.min_by(F.struct("*"), F.struct(*order, *moved.columns)).alias("__row")
    kept = moved.groupBy(*[F.col(c).alias(f"__{c}") for c in unique]).agg(row)
    return kept.select(*[F.col("__row")[c].alias(c) for c in moved.columns])


def changed(records: DataFrame, state: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Records that are new, differ from the state's hash, or failed last time."""
    s = state.select(F.col(id_col), F.col(hash_col).alias("__hash"), F.col("status").alias("__status"))
    due = F.col("__hash").isNull() | (F.col("__hash") != F.col(hash_col)) | (F.col("__status") == "FAILED")
    return records.join(s, id_col, "left").where(due).drop("__hash", "__status")


def filled(primary: DataFrame, fallback: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column from primary, or where it is null from fallback."""
    f = fallback.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return primary.join(f, key, "left").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])
