"""Titles in cells: whole cells with odd brackets and labels, and job rows made from them."""

import json

import pytest
from pyspark.sql import functions as F

from vellumine.functions import titles as ti
from vellumine.operators import fallback

CELLS = {
    "后端工程师(一;二)；测试、测试": ["后端工程师(一;二)", "测试"],
    "\n》(（a)测试、": [],
    "（甲[乙;丙]丁）测试；销售": ["（甲[乙;丙]丁）测试", "销售"],
    "岗位：测试;销售": ["测试", "销售"],
    "：：测试": ["：测试"],
    "岗位：岗位名称：测试": ["测试"],
    "详见：测试;销售": ["测试", "销售"],
    "后端工程师 前端工程师": ["后端工程师", "前端工程师"],
    "软件工程师 实习 测试": ["软件工程师 实习", "测试"],
    "软件工程师 intern 测试": ["软件工程师 intern", "测试"],
    "软件工程师 上海": [],
    "1. 销售\n二、测试": ["销售\n二、测试"],
    "1. 销售\n2. 测试": ["销售", "测试"],
    "产品经理,Product manager": [],
    "Product manager,产品经理": ["Product manager,产品经理"],
    "AI,IT,短": ["AI", "IT", "短"],
    "测试 ; 测试": ["测试"],
    "测试": ["测试"],
    "a": [],
    "Ac me": [],
    "工程师" * 30: [],
    "x" * 70 + "(" + "y" * 70 + ")测试": [],
    "测试" + "(" + "y" * 90 + ")": ["测试" + "(" + "y" * 90 + ")"],
    " ;; ": [],
    "": [],
    None: [],
    "测试": ["测试"],
}


def test_cells(spark):
    rows = spark.createDataFrame([(c, i) for i, c in enumerate(CELLS)], "cell string, i int")
    got = {r["cell"]: r["t"] for r in rows.select("cell", ti.safe_titles(F.col("cell"), F.lit("acme")).alias("t")).collect()}
    assert {k: (got[k], v) for k, v in CELLS.items() if got[k] != v} == {}


def test_nothing_leaves_the_jvm(spark):
    plan = spark.range(1).select(ti.safe_titles(F.lit("a") + F.col("id"), F.lit("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text, want", [("a;b(c;d);e", ["a", "b(c;d)", "e"]), (" a ,, b", ["a", "b"]), ("a(b;c", ["a(b;c"]), ("a)b;c", ["a)b", "c"]), (None, [])])
def test_parts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ti.parts(F.col("t"))).first()[0] == want


def test_table_jobs(spark):
    rows = [
        ("r1", 3, "Acme", "测试；数据开发", "https://x.com/a"), (None, 4, "Acme", "测试", "mailto:a@b.c"), ("r2", 5, None, "测试", None),
        ("r3", 6, "Acme", "详见公告", None), ("r4", 7, "Acme", None, None), ("r5", 8, "测试", "测试", None), ("r1", 3, "Acme", "测试；数据开发", "https://x.com/a"),
    ]
    df = spark.createDataFrame([(*r, "t") for r in rows], "record string, n int, company string, cell string, url string, note string")
    reasons = F.array(F.lit("A"), F.lit("B"), F.lit("A"))
    got = fallback.table_jobs(df, "cell", "company", F.col("record"), F.col("n"), F.col("url"), reasons).collect()
    assert sorted((r["record"] or "", r["title"], r["job_url"], r["source_ref"]) for r in got) == [
        ("", "测试", None, "table-row:4"), *[("r1", "数据开发", "https://x.com/a", "record:r1")] * 2, *[("r1", "测试", "https://x.com/a", "record:r1")] * 2,
    ]
    assert all(r["source_job_id"].startswith("table-fallback:record:r1:" if r["record"] else "table-fallback:row:4:") for r in got)
    assert len({r["source_job_id"] for r in got}) == 3
    assert json.loads(got[0]["metadata"])["quality_reasons"] == ["A", "B"]
    assert fallback.table_jobs(df.where("false"), "cell", "company", F.col("record"), F.col("n"), F.col("url"), reasons).collect() == []
