import pytest
from compare import DATA, TABLES, spark_rows, sql_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumine.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, str(DATA)))
    if name in ORACLES:
        assert got == sql_rows(ORACLES[name])
    else:
        assert got[1]


def test_small_forms_equal_sql_for_large_keys(spark, tmp_path):
    """Dates of the year 2200 and later are no dates, in the SQL too."""
    for t in set(TABLES) - {"part"}:
        (tmp_path / f"{t}.parquet").symlink_to(DATA / f"{t}.parquet")
    part = spark.read.parquet(f"{DATA}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 83_900)
    part.toPandas().to_parquet(tmp_path / "part.parquet")
    got = QUERIES["q88_small_forms"](spark, str(tmp_path))
    assert got.where("p_partkey > 84005").count() > 0 and got.where("at is not null").agg(F.max("p_partkey")).first()[0] == 84_005
    assert spark_rows(got) == sql_rows(ORACLES["q88_small_forms"], tmp_path)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_limiter_against_plain_loop(spark):
    rows = [(r["user_id"], r["ts"], r["event_id"]) for r in spark.read.parquet(f"{DATA}/events.parquet").collect()]
    want, taken = {}, {}
    for user, ts, event in sorted(rows):
        mine = [t for t in taken.get(user, []) if (ts - t).total_seconds() < 86_400]
        want[event] = len(mine) < 3
        taken[user] = mine + [ts] * want[event]
    got = {r["event_id"]: r["accepted"] for r in QUERIES["q51_limiter"](spark, str(DATA)).collect()}
    assert got == want
