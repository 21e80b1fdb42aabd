"""Scans along a key's order in which a hot key is spread over many tasks.

The order is cut into bins at quantiles of all rows, so no bin has much more than its share of
them. What one bin must know of those before it (a sum, a last row) is aggregated per key and
bin, carried from bin to bin - a key has at most BINS rows there - and joined back. The scans
themselves then run per (key, bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 64


def place(column: Column, kind: str) -> Column:
    """A number in the order of a number, date or timestamp."""
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    return F.unix_date(column).cast("long") if kind == "date" else column


def binned(rows: DataFrame, by: Column, name: str = "__bin", bins: int = BINS, apart: int = 0) -> tuple[DataFrame, list]:
    """rows with their bin's number (null comes first, in bin -1), and the bounds between bins.

    Bounds are approximate quantiles, at least `apart` from each other; rows of one value are
    never parted. One more pass over `by` finds them.
    """
    wanted = [k / bins for k in range(1, bins)]
    found = rows.agg(F.percentile_approx(by, wanted, 1000).alias("q")).first()["q"] or []
    bounds: list = []
    for q in sorted(set(found)):
        if not bounds or q - bounds[-1] > apart:
            bounds.append(q)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(by < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return rows.withColumn(name, F.when(by.isNull(), -1).otherwise(search(0, len(bounds)))), bounds


def _with(rows: DataFrame, per_bin: DataFrame, key: str) -> DataFrame:
    """rows with the columns that per_bin has for their key and bin; null is a key like any other."""
    other = per_bin.withColumnsRenamed({key: "__key", "__bin": "__of"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bin") == F.col("__of"))).drop("__key", "__of")


def _by(rows: DataFrame, column: str) -> Column:
    return place(F.col(column), rows.schema[column].dataType.simpleString())


def running_sum(rows: DataFrame, key: str, value: Column, order: list[str], name: str, bins: int = BINS, falling: bool = False) -> DataFrame:
    """rows with the sum of value up to each, in the order of the columns; the first may fall.

    The columns should tell a key's rows apart. A null value adds nothing.
    """
    by = _by(rows, order[0])
    parted, _ = binned(rows.withColumn("__value", value), -by if falling else by, bins=bins)
    sums = parted.groupBy(key, "__bin").agg(F.sum("__value").alias("__sum"))
    upto = W.partitionBy(key).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(key, "__bin", F.sum("__sum").over(upto).alias("__before"))
    first = F.col(order[0]).desc_nulls_first() if falling else F.col(order[0])
    own = W.partitionBy(key, "__bin").orderBy(first, *order[1:]).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.sum("__value").over(own)
    total = F.when(here.isNull(), F.col("__before")).otherwise(here + F.coalesce("__before", F.lit(0)))
    return _with(parted, carried, key).withColumn(name, total).drop("__value", "__bin", "__before")


def sliding_count(rows: DataFrame, key: str, time: str, width: int, name: str, bins: int = BINS) -> DataFrame:
    """rows with the number of the key's rows within the last `width` of the time's unit, itself included.

    Bins are wider than that, so a row is seen by its own and at most the next one. Rows
    without a time count each other.
    """
    by = _by(rows, time)
    parted, bounds = binned(rows.withColumn("__at", by), F.col("__at"), bins=bins, apart=width)
    reach = parted.select("*", F.lit(True).alias("__own"))
    if bounds:
        following = F.get(F.array(*map(F.lit, bounds)), F.col("__bin"))
        late = (F.col("__bin") >= 0) & (F.col("__at") + width > following)
        reach = reach.unionByName(parted.where(late).withColumn("__bin", F.col("__bin") + 1).withColumn("__own", F.lit(False)))
    span = W.partitionBy(key, "__bin").orderBy("__at").rangeBetween(-(width - 1), 0)
    return reach.withColumn(name, F.count("*").over(span)).where("__own").drop("__at", "__bin", "__own")


def sessions(rows: DataFrame, key: str, time: str, gap: int, bins: int = BINS) -> DataFrame:
    """key, session_start, session_end, n: a pause of `gap` or more of the time's unit parts sessions.

    Rows without a time belong to no session.
    """
    kept = rows.where(F.col(time).isNotNull()).select(key, F.col(time).alias("__time"), _by(rows, time).alias("__at"))
    parted, _ = binned(kept, F.col("__at"), bins=bins)
    upto = W.partitionBy(key).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    ends = parted.groupBy(key, "__bin").agg(F.max("__at").alias("__end"))
    ends = ends.select(key, "__bin", F.max("__end").over(upto).alias("__before"))
    order = W.partitionBy(key, "__bin").orderBy("__at")
    before = F.coalesce(F.lag("__at").over(order), F.col("__before"))
    starts = F.when(F.coalesce(F.col("__at") - before >= gap, F.lit(True)), F.col("__at"))
    marked = _with(parted, ends, key).withColumn("__new", starts)
    known = F.last("__new", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, 0))
    pieces = marked.withColumn("__start", known).groupBy(key, "__bin", "__start").agg(
        F.min("__time").alias("session_start"), F.max("__time").alias("session_end"), F.count("*").alias("n")
    )
    # the piece at a bin's head goes on with the last session begun before
    begun = pieces.groupBy(key, "__bin").agg(F.max("__start").alias("__last"))
    begun = begun.select(key, "__bin", F.last("__last", ignorenulls=True).over(upto).alias("__carried"))
    whole = _with(pieces, begun, key).withColumn("__start", F.coalesce("__start", "__carried"))
    out = whole.groupBy(key, "__start").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"))
    return out.drop("__start")


def changes(rows: DataFrame, key: str, order: list[str], facts: list[str], bins: int = BINS) -> DataFrame:
    """The rows whose facts differ from those of the key's row before (null equals null), and each key's first.

    The columns of the order should tell a key's rows apart.
    """
    parted, _ = binned(rows, _by(rows, order[0]), bins=bins)
    now = F.struct(*facts)
    lasts = parted.groupBy(key, "__bin").agg(F.max_by(now, F.struct(*order)).alias("__facts"))
    bins_in_order = W.partitionBy(key).orderBy("__bin")
    carried = lasts.select(key, "__bin", F.lag("__facts").over(bins_in_order).alias("__facts"))
    own = W.partitionBy(key, "__bin").orderBy(*order)
    before = F.coalesce(F.lag(now).over(own), F.col("__facts"))
    changed = before.isNull() | ~now.eqNullSafe(before)
    return _with(parted, carried, key).withColumn("__changed", changed).where("__changed").drop("__changed", "__facts", "__bin")
