"""The bucketed table against merging the whole table, and what its batches touch."""

import pytest
from pyspark.sql import functions as F

from vellumine.operators import merging
from vellumine.operators.snapshots import ConflictError, Snapshots
from vellumine.streaming import feeds

SCHEMA = "k long, c string, note string, s string, v int"
FIRST = [(i, f"c{i}", None if i % 3 else "old", "OPEN", i) for i in range(200)] + [(None, "n", "x", "OPEN", 0)]
SECOND = [(3, "c3", "new", "OPEN", None), (4, "other", None, "OPEN", 9), (500, "c500", None, None, 1), (None, "m", None, "OPEN", 0), (4, "other", None, "OPEN", 9)]
RULES = {"keep": ["note"], "provenance": ["note"], "status": "s", "invalidated": ["v"]}


def store(spark, path, **more):
    return Snapshots(spark, str(path), "k", "c", buckets=8, **RULES, **more)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {p.name for p in path.rglob("*.parquet")}


def test_two_batches_equal_a_merge_of_the_table(spark, tmp_path):
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (FIRST, SECOND))
    s = store(spark, tmp_path / "t")
    assert s.merge(one, 0) == {"CREATED": 201}
    before = files(tmp_path)
    counts = s.merge(two, 1)
    assert counts["CREATED"] == 2 and counts["UPDATED"] == 2 and "UNCHANGED" not in counts
    first = merging.merge(one.where("false"), one, "k", "c", **RULES).drop("merge_action")
    second = merging.merge(first, merging.without_repeats(two, "k", "c"), "k", "c", **RULES)
    assert rows(s.read()) == rows(second.drop("merge_action")) and rows(s.read(1)) == rows(first)
    assert set(s.manifest(1)["folders"].values()) & set(s.manifest(2)["folders"].values())  # untouched buckets keep their files
    assert before < files(tmp_path)
    assert sorted(r["k"] or -1 for r in s.outcomes().where("merge_action in ('CREATED', 'UPDATED')").collect()) == [-1, 3, 4, 500]
    assert rows(s.lookup([3, 500, 77, 999]).select("k")) == [(3,), (500,), (77,)]


def test_a_batch_counts_once(spark, tmp_path):
    s = store(spark, tmp_path / "t")
    s.merge(spark.createDataFrame(FIRST, SCHEMA), 5)
    seen = files(tmp_path)
    assert s.merge(spark.createDataFrame(SECOND, SCHEMA), 5) == {} and s.merge(spark.createDataFrame(SECOND, SCHEMA), 4) == {}
    assert files(tmp_path) == seen and s.versions() == [1]
    keyed = [r for r in FIRST if r[0] is not None][:50]
    assert set(s.merge(spark.createDataFrame(keyed, SCHEMA), 6)) == {"UNCHANGED", "KEPT"}
    assert s.manifest(1)["folders"] == s.manifest()["folders"] and s.manifest()["batch"] == 6
    assert s.merge(spark.createDataFrame([], SCHEMA), 7) == {} and s.manifest()["batch"] == 7


def test_failures_leave_the_table(spark, tmp_path):
    s = store(spark, tmp_path / "t")
    with pytest.raises(ValueError, match="nothing was merged"):
        s.read()
    s.merge(spark.createDataFrame(FIRST, SCHEMA), 0)
    with pytest.raises(ValueError, match="conflicting"):
        s.merge(spark.createDataFrame([(1, "a", None, None, 1), (1, "b", None, None, 1)], SCHEMA), 1)
    other = store(spark, tmp_path / "t")
    real = other.manifest
    stale = real()
    s.merge(spark.createDataFrame(SECOND, SCHEMA), 1)
    other.manifest = lambda version=None: stale if version is None else real(version)
    with pytest.raises(ConflictError):
        other.merge(spark.createDataFrame([(1, "z", None, None, 1)], SCHEMA), 2)
    assert s.manifest()["batch"] == 1 and s.read().where("c = 'z'").count() == 0
    with pytest.raises(ValueError, match="no version"):
        s.read(9)


def test_stream_and_expiry(spark, tmp_path):
    s = store(spark, tmp_path / "t")
    source = str(tmp_path / "in")
    for n, part in enumerate((FIRST, SECOND, [(7, "seven", None, "OPEN", 1)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        feeds.run_available(feeds.files(spark, source, spark.createDataFrame([], SCHEMA)), s.sink(), str(tmp_path / "checkpoint"))
        assert len(s.versions()) == n + 1
    want = rows(s.read())
    assert dict((r[0], r[1]) for r in want)[7] == "seven"
    assert s.expire(1) > 0 and s.versions() == [3] and rows(s.read()) == want
    named = set(s.manifest()["folders"].values())
    assert {str(p.parent.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*.parquet")} == named
    assert s.read().select(F.col("k")).count() == 203
