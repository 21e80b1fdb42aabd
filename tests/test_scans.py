"""Scans in bins against plain windows, with a hot key, null keys and times, and ties."""

from collections import deque

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumine.operators import history, ranking, scans


@pytest.fixture(scope="module")
def events(spark):
    """3 000 rows, half of them of one key; some times null, many equal."""
    h = F.crc32(F.col("id").cast("string"))
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 != 0, h % 40).cast("int").alias("k"),
        F.when(h % 97 != 0, F.timestamp_seconds(h % 5000)).alias("t"), (h % 19 - 9).alias("v"), F.when(h % 3 != 0, h % 2).alias("f"),
    )
    return rows


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("bins", [1, 7, 64])
def test_running_sum(events, bins):
    plain = F.sum("v").over(W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0))
    got = scans.running_sum(events, "k", F.col("v"), ["t", "id"], "s", bins=bins)
    assert got.columns == [*events.columns, "s"] and rows(got, "id", "s") == rows(events.withColumn("s", plain), "id", "s")
    down = F.count("*").over(W.partitionBy("k").orderBy(F.col("t").desc_nulls_first(), "id"))
    assert rows(scans.running_sum(events, "k", F.lit(1), ["t", "id"], "s", bins=bins, falling=True), "id", "s") == rows(events.withColumn("s", down), "id", "s")


@pytest.mark.parametrize("bins, width", [(1, 60), (64, 1), (64, 60), (64, 700), (8, 100_000)])
def test_sliding_count(events, bins, width):
    at = F.unix_micros("t")
    plain = F.count("*").over(W.partitionBy("k").orderBy(at).rangeBetween(-(width * 1_000_000 - 1), 0))
    got = scans.sliding_count(events, "k", "t", width * 1_000_000, "n", bins=bins)
    assert rows(got, "id", "n") == rows(events.withColumn("n", plain), "id", "n")


@pytest.mark.parametrize("bins, gap", [(1, 60), (64, 1), (64, 40), (5, 300), (64, 10_000)])
def test_sessions(events, bins, gap):
    by, order = {}, events.where("t is not null").orderBy("t").select("k", "t").collect()
    for r in order:
        own = by.setdefault(r["k"], deque())
        if not own or (r["t"] - own[-1][1]).total_seconds() >= gap:
            own.append([r["t"], r["t"], 0])
        own[-1][1:] = [r["t"], own[-1][2] + 1]
    want = sorted(((k, *s) for k, ss in by.items() for s in ss), key=str)
    assert rows(scans.sessions(events, "k", "t", gap * 1_000_000, bins=bins), "k", "session_start", "session_end", "n") == want


@pytest.mark.parametrize("bins", [1, 64])
def test_changes(events, bins):
    w = W.partitionBy("k").orderBy("t", "id")
    plain = events.withColumn("c", F.lag(F.lit(1)).over(w).isNull() | ~F.lag("f").over(w).eqNullSafe(F.col("f"))).where("c")
    assert rows(scans.changes(events, "k", ["t", "id"], ["f"], bins=bins), "id") == rows(plain, "id")
    versions = history.versioned(events, "k", ["t", "id"], ["f"])
    assert rows(versions, "id", "version") == rows(plain.withColumn("version", F.row_number().over(w)), "id", "version")


def test_a_hot_key_is_spread(events):
    parted, bounds = scans.binned(events, F.unix_micros("t"))
    most = parted.groupBy("k", "__bin").count().agg(F.max("count")).first()[0]
    assert len(bounds) > 50 and most <= 3000 / 64 * 3
    plan = ranking.running_sum(events, "k", "v", ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    assert all("__bin" in line for line in plan.splitlines() if "Window" in line and "sum(" in line)


def test_empty_tables(events):
    none = events.where("false")
    assert scans.running_sum(none, "k", F.col("v"), ["t", "id"], "s").collect() == [] and scans.sliding_count(none, "k", "t", 5, "n").collect() == []
    assert scans.sessions(none, "k", "t", 5).collect() == [] and scans.changes(none, "k", ["t"], ["f"]).collect() == []
    unknown = events.withColumn("t", F.lit(None).cast("timestamp"))
    assert scans.sliding_count(unknown, "k", "t", 5, "n").count() == 3000 and scans.sessions(unknown, "k", "t", 5).collect() == []
