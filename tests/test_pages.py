"""Links of pages, and embedded values by kind and from SQL."""

import pytest

from vellumine.sources import page_functions, payloads

LINK = "<a href='/job/7'>one engineer</a>"
PUSHED = 'x self.__next_f.push([1,"0:{\\"id\\": 1}"]) y'


def test_links_stay_with_their_page(spark):
    rows = [
        (1, "https://a.com/x", LINK + LINK.replace("one", "again")), (1, "https://b.com/y", "<p>none</p>"), (None, "https://c.com", LINK),
        (2, None, LINK), (3, "https://d.com", None), (4, "https://e.com", ""), (5, "https://f.com", LINK.replace("one engineer", "a &amp; <b>b</b> engineer")),
    ]
    pages = spark.createDataFrame([(*r, 9, "t") for r in rows], "id int, url string, html string, ordinal int, title string")
    got = sorted(map(str, payloads.linked_jobs(pages, "id", "url", "html").collect()))
    want = [(1, "one", "a.com", 0), (5, "a & b", "f.com", 0), (None, "one", "c.com", 0)]
    assert got == sorted(f"Row(id={i}, ordinal={n}, title='{t} engineer', detail_url='https://{h}/job/7', source_job_id='7')" for i, t, h, n in want)
    assert payloads.linked_jobs(pages.where("false"), "id", "url", "html").collect() == []
    assert "Exchange" not in payloads.linked_jobs(pages, "id", "url", "html")._jdf.queryExecution().executedPlan().toString()


def kinds(spark):
    rows = [
        (1, "NEXT", PUSHED), (1, "MOKA", "<input value='{&quot;b&quot;:1}' id='init-data'>"), (None, "PHENOM", "phApp.ddo = {a: 1}; phApp.ddo = [2]"),
        (3, "ZHAOPIN", None), (4, None, PUSHED), (5, "OTHER", PUSHED), (6, "MOKA", "<input id='init-data' value=''>"), (7, "NEXT", ""),
    ]
    return spark.createDataFrame(rows, "id int, kind string, html string")


WANT = [(1, 0, '{"b":1}'), (1, 0, '{"id": 1}'), (None, 0, "{a: 1}"), (None, 1, "[2]")]


def test_kinds_in_one_pass(spark):
    found = payloads.read_by_kind(kinds(spark), "id", "html", "kind")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(WANT, key=str)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert payloads.read_by_kind(kinds(spark).where("false"), "id", "html", "kind").collect() == []


def test_embedded_values_from_sql(spark):
    page_functions.register(spark)
    kinds(spark).createOrReplaceTempView("pages_of_kinds")
    got = spark.sql("SELECT * FROM embedded_values(TABLE(pages_of_kinds))")
    assert got.columns == ["id", "kind", "ordinal", "value"]
    assert sorted([(r["id"], r["ordinal"], r["value"]) for r in got.collect()], key=str) == sorted(WANT, key=str)
    one = spark.sql("SELECT id, value FROM embedded_values(TABLE(SELECT id, html FROM pages_of_kinds) PARTITION BY id, kind => 'NEXT') WHERE id = 4")
    assert [tuple(r) for r in one.collect()] == [(4, '{"id": 1}')]
    for bad in ("TABLE(SELECT id FROM pages_of_kinds)", "TABLE(SELECT id, html FROM pages_of_kinds), kind => 'X'", "TABLE(SELECT html, kind, 1 AS value FROM pages_of_kinds)"):
        with pytest.raises(Exception, match="kind is one of|needs columns|may not have"):
            spark.sql(f"SELECT * FROM embedded_values({bad})").collect()
