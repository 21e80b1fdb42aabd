"""The paged source against the rows that were recorded, and the pages it read."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumine.operators.rank_directory import RankDirectory
from vellumine.sources import paged


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paged") / "replies")
    rows = spark.range(260).select(
        (F.col("id") % 2).alias("kind"), F.concat(F.lit('r"'), F.lpad(F.col("id").cast("string"), 4, "0")).alias("rid"),
        F.timestamp_seconds(F.col("id") * 10).alias("at"), (F.col("id") / 4).alias("share"),
        F.when(F.col("id") % 5 != 0, F.array(F.lit("a"), F.col("id").cast("string"))).alias("tags"), (F.col("id") % 3 == 0).alias("odd"),
    )
    paged.register(spark)
    paged.record(rows, path, F.col("kind"), F.col("rid"), F.col("at"), size=10)
    return path, rows


def scan(spark, path, **options):
    return spark.read.format("paged").options(path=path, **options).load()


def reads(folder):
    return sum(len(f.read_bytes()) for f in folder.iterdir()) if folder.exists() else 0


def test_whole_table_and_schema(spark, recorded):
    path, rows = recorded
    got = scan(spark, path)
    assert got.schema.simpleString() == "struct<record_id:string,last_modified:timestamp,kind:double,rid:string,at:timestamp,share:double,tags:array<string>,odd:boolean>"
    want = rows.select("rid", "at", F.col("kind").cast("double"), "rid", "at", "share", "tags", "odd")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.rdd.getNumPartitions() == 2
    some = scan(spark, path, fields="odd, share", view="1")
    assert some.columns == ["record_id", "last_modified", "odd", "share"] and some.count() == 130


def test_scan_stops_at_cutoff_and_limit(spark, recorded, tmp_path):
    path, _ = recorded
    assert scan(spark, path, audit=str(tmp_path / "all")).count() == 260
    assert reads(tmp_path / "all") == 26
    late = scan(spark, path, audit=str(tmp_path / "some")).where(F.col("last_modified") > datetime(1970, 1, 1, 0, 39, 50)).where("odd is not null")
    assert sorted(r["record_id"] for r in late.collect()) == [f'r"{i:04}' for i in range(240, 260)]
    assert reads(tmp_path / "some") == 4  # ten records of each view are newer; the eleventh is on the next page
    assert scan(spark, path, audit=str(tmp_path / "few"), view="0", limit="25").count() == 25
    assert reads(tmp_path / "few") == 3


def test_full_packs_are_a_file_and_read_in_parts(spark, tmp_path):
    paged.register(spark)
    rows = spark.range(600).select((F.col("id") % 2).alias("kind"), F.concat(F.lit("r\t\n"), F.col("id")).alias("rid"), F.timestamp_seconds("id").alias("at"))
    path = tmp_path / "replies"
    paged.record(rows, str(path), F.col("kind"), F.col("rid"), F.col("at"), size=1)
    view = path / "view=1"
    assert len(list(view.glob("pages=*"))) == 9 and len(list(view.glob("token=*"))) == 12
    assert all(len(list(p.glob("*.txt"))) == 1 for p in view.glob("pages=*"))
    got = scan(spark, str(path), audit=str(tmp_path / "all"))
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r["rid"] for r in got.collect()) == sorted(r["rid"] for r in rows.collect())
    assert reads(tmp_path / "all") == 600
    late = scan(spark, str(path), audit=str(tmp_path / "late")).where(F.col("last_modified") > datetime(1970, 1, 1, 0, 9, 49))
    assert sorted(r["rid"] for r in late.collect()) == sorted(f"r\t\n{i}" for i in range(590, 600))
    assert reads(tmp_path / "late") == 14  # five newer ones and the next of each view; one page of each part behind
    assert sorted(r["rid"] for r in scan(spark, str(path), view="1", limit="280").collect()) == sorted(f"r\t\n{i}" for i in range(41, 600, 2))
    replies = paged.Replies(str(path))
    assert [token for token, _ in replies.pages("1", "250", "256")] == [str(i) for i in range(250, 256)]
    (view / "token=255").mkdir()  # a page of its own counts before a packed one
    (view / "token=255" / "part-0").write_text('{"items": [], "has_more": false}')
    with pytest.raises(paged.PagedError, match="ends before token 256"):
        list(replies.pages("1", "250", "256"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    paged.register(spark)
    rows = spark.range(45).select(F.lit("v").alias("view"), F.col("id").cast("string").alias("rid"), F.timestamp_seconds("id").alias("at"))
    path, out, seen = (str(tmp_path / n) for n in ("replies", "out", "checkpoint"))
    paged.record(rows.where("id < 33"), path, F.col("view"), F.col("rid"), F.col("at"), size=10, newest_first=False)

    def run():
        stream = spark.readStream.format("paged").options(path=path, view="v", pages="2").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(int(r[0]) for r in spark.read.parquet(out).select("record_id").collect())

    assert run() == list(range(33))
    # the view grows: its last page fills up and others follow
    page = tmp_path / "replies" / "view=v" / "token=3"
    old = next(p for p in page.iterdir() if p.suffix == ".txt")
    item = lambda i: {"record_id": str(i), "last_modified": i * 1000, "fields": {}}
    for crc in page.glob(".*.crc"):
        crc.unlink()
    old.write_text(json.dumps({"items": [item(i) for i in range(30, 40)], "has_more": True, "page_token": "4"}))
    (page.parent / "token=4").mkdir()
    (page.parent / "token=4" / "part-0.txt").write_text(json.dumps({"items": [item(i) for i in range(40, 45)], "has_more": False}))
    assert run() == list(range(45))


@pytest.mark.parametrize(
    "replies, error",
    [
        ({"0": {"items": [], "has_more": True, "page_token": "0"}}, "invalid page token"), ({"0": {"items": [], "has_more": True}}, "invalid page token"),
        ({"0": {"items": [{"fields": {}}]}}, "no record_id"), ({"0": {"items": [], "has_more": True, "page_token": "9"}}, "no reply"), ({"0": []}, "no page"),
    ],
)
def test_replies_that_contradict(tmp_path, replies, error):
    for token, reply in replies.items():
        (tmp_path / "view=v" / f"token={token}").mkdir(parents=True)
        (tmp_path / "view=v" / f"token={token}" / "part-0").write_text(json.dumps(reply))
    schema = paged.StructType([paged.StructField(paged.ID, paged.StringType())])
    with pytest.raises(paged.PagedError, match=error):
        for _, reply in paged.Replies(str(tmp_path)).pages("v"):
            list(paged.rows_of(reply, schema))


def test_odd_values(spark, tmp_path):
    item = {"record_id": "a", "last_modified": None, "fields": {"n": "x", "t": {"k": [1]}, "d": True, "l": [1, None, "z"]}}
    pages = {"v": {"items": [item, {"record_id": "b", "fields": None}]}, "_fields": {"items": [{"field_name": n, "type": t} for n, t in (("n", "number"), ("t", "text"), ("d", "datetime"), ("l", "list"), ("u", "new"))]}}
    for view, reply in pages.items():
        (tmp_path / f"view={view}" / "token=0").mkdir(parents=True)
        (tmp_path / f"view={view}" / "token=0" / "part-0").write_text(json.dumps(reply))
    paged.register(spark)
    got = sorted(map(tuple, scan(spark, str(tmp_path)).collect()))
    assert got == [("a", None, None, '{"k": [1]}', None, ["1", None, "z"], None), ("b", *[None] * 6)]


def test_pages_of_a_rank_directory(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("position_note"))
    order = [F.col("k").desc(), F.col("id")]
    ranks = RankDirectory.build(rows, order, str(tmp_path / "r"), parts=16)
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert [r["id"] for r in ranks.page(37, 20).collect()] == want[720:740]
    assert [r["id"] for r in ranks.positions().orderBy("position").collect()] == want
    assert ranks.page(51, 20).collect() == [] and ranks.total == 1000
    assert len(ranks.parts_of(11, 15)) == 1 and len(ranks.parts_of(1, 1000)) == 16
    plan = ranks.page(3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__part" in plan and "Window" not in plan
    assert [r["id"] for r in RankDirectory(spark, str(tmp_path / "r")).page(1, 3).collect()] == want[:3]
    none = RankDirectory.build(rows.where("false"), order, str(tmp_path / "e"))
    assert none.page(1, 5).collect() == [] and none.positions().count() == 0
    with pytest.raises(ValueError):
        ranks.page(0, 5)
