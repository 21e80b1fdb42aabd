"""Lists that clients see: groups by newest, saved items, runs, rows by id, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans
from .ranking import with_top_values


def group_page(
    rows: DataFrame, key: str, newest: str, title: str, order: list[Column], number: int, size: int, k: int = 3
) -> DataFrame:
    """One page of groups: key, n, newest, the titles of the first k rows; newest first, null last, then by key.

    The page is cut before titles are looked up, so only its groups' rows are ranked.
    """
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(newest).alias("newest"))
    page = groups.orderBy(F.col("newest").desc_nulls_last(), key).offset((number - 1) * size).limit(size)
    mine = rows.join(F.broadcast(page.select(key)), key, "left_semi")  # at most `size` keys
    return with_top_values(page, mine, [key], title, order, k, "titles")


def by_ids(rows: DataFrame, id_col: str, ids: list, columns: list[str]) -> DataFrame:
    """position and columns of the rows with the given ids, in the order of the list; unknown ids are left out."""
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    wanted = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], f"position int, __id {kind}")
    found = rows.join(F.broadcast(wanted), F.col(id_col) == F.col("__id"))  # as long as the request
    return found.select("position", *columns).orderBy("position")


def one(rows: DataFrame, id_col: str, value: object) -> DataFrame:
    return rows.where(F.col(id_col) == F.lit(value)).limit(1)


def saved_list(saved: DataFrame, items: DataFrame, sources: DataFrame, item: str, source: str, columns: list[str]) -> DataFrame:
    """What each user saved, newest first, with the item's facts (gone items drop out) and its source's, if known."""
    listed = saved.join(items, item).join(sources, source, "left")
    placed = scans.running_sum(listed, "user_id", F.lit(1), ["saved_at", item], "position", falling=True)
    return placed.select("user_id", F.col("position").cast("int").alias("position"), item, *columns)


def run_page(runs: DataFrame, created: str, id_col: str, number: int, size: int) -> DataFrame:
    """A page of runs, newest first, then by id, with the total of all in each row."""
    total = runs.agg(F.count("*").alias("total"))
    page = runs.orderBy(F.col(created).desc(), id_col).offset((number - 1) * size).limit(size)
    return page.join(F.broadcast(total))  # one row


def detail_view(rows: DataFrame, hidden: list[str]) -> DataFrame:
    """All columns but the internal ones."""
    return rows.drop(*hidden)


def progress(done: Column, total: Column, start: int = 50, span: int = 40) -> Column:
    """Percent of a run whose last part goes from start to start + span; start where there is nothing to do."""
    share = F.floor(F.lit(span) * done / total)
    return F.when(total > 0, F.lit(start) + share).otherwise(F.lit(start)).cast("long")


def evaluator_input(candidate: dict[str, Column], profile: dict[str, Column], checks: Column) -> Column:
    """JSON of what an evaluator gets: candidate, profile and the checks of its constraints."""
    parts = [F.struct(*[c.alias(n) for n, c in part.items()]).alias(name) for name, part in (("job", candidate), ("profile", profile))]
    return F.to_json(F.struct(*parts, checks.alias("checks")))


def attributed(failures: DataFrame, rows: DataFrame, number: str, record: str) -> DataFrame:
    """Failures with the record that their row number stands for; a number without a row stays, with none."""
    return failures.join(rows.select(number, record), number, "left")


def backfill_errors(rows: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows with reasons: the columns whose value no parent has (name: table and its key). Null refers to nothing."""
    out, names = rows, []
    for n, (column, (parent, key)) in enumerate(parents.items()):
        out = out.join(parent.select(F.col(key).alias(f"__p{n}")).distinct(), F.col(column) == F.col(f"__p{n}"), "left")
        names.append(F.when(F.col(column).isNotNull() & F.col(f"__p{n}").isNull(), F.lit(column)))
    out = out.withColumn("reasons", F.array_compact(F.array(*names))).where(F.size("reasons") > 0)
    return out.select(*rows.columns, "reasons")


def as_of(snapshots: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot that each request names by owner, id and version; requests without one stay, with nulls."""
    asked = requests.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    others = [c for c in snapshots.columns if c not in keys]
    return asked.join(snapshots, same, "left").select(*[F.col(f"__{k}").alias(k) for k in keys], *others)
