"""Comparing the rows of each bucket in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side

Batches = Iterator[pa.RecordBatch]


def in_cells(rows: DataFrame, keys: DataFrame, row_id: str, block: int) -> DataFrame:
    """rows (with a column `key`) dealt to cells of at most 2 * block rows, sorted by cell.

    A bucket of more than `block` rows is split into blocks by a hash of row_id, and every
    pair of its blocks becomes a cell of its own, so all pairs still meet, in many tasks.
    Adds `i`, `j` (the cell) and `side` (the row's block). keys: the same keys, narrow and
    cheap to compute, from which the large buckets are counted with map-side sums.
    """
    large = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    dealt = rows.join(small_side(large), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(row_id), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    return dealt.drop("other", "blocks").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def cells(batches: Batches, columns: list[str], most: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Whole cells of sorted rows as columns, several cells at a time; a cell is never cut."""
    held: list[pa.RecordBatch] = []
    n = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        return {c: t.column(c).to_numpy() if c not in ("vec", "sigs") else t.column(c) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        t = joined(held)
        starts = cell_starts(t.column("key").to_numpy(), t.column("i").to_numpy(), t.column("j").to_numpy())
        last = int(starts[-1])
        if last:
            yield arrays(t.slice(0, last))
        rest = t.slice(last)
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield arrays(joined(held))


def cell_starts(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.flatnonzero(new)


def pairs_in_cells(x: dict[str, np.ndarray], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (s, t), s < t, of all pairs to compare, some millions at a time.

    Rows of a diagonal cell are compared with each other, others only across the two blocks.
    """
    starts = cell_starts(x["key"], x["i"], x["j"])
    n = len(x["key"])
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    crossed = x["i"] != x["j"]
    step, at = 1, np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        s, t = at, at + step
        use = ~crossed[s] | (x["side"][s] != x["side"][t])
        found.append((s[use], t[use]))
        held += int(use.sum())
        if held >= most:
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            found, held = [], 0
        step += 1
    if held:
        yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


Compare = Callable[[Batches], Batches]
