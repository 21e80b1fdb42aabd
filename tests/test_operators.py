import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumine.functions import text as tx
from vellumine.functions import vectors as vec
from vellumine.operators import facets, matching, merging, quality, ranking
from vellumine.plans import catalogue
from vellumine.sources import records, spreadsheet
from vellumine.streaming import feeds


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (lambda: tx.collapsed(F.col("t")), " a　  b\n", "a b"),
        (lambda: tx.terms(F.col("t")), "后端工程师 Java c 后端工程师 C++", ["后端工程师", "java", "c++"]),
        (lambda: tx.preview(F.col("t"), 5), "abcdefgh", "abcd…"),
        (lambda: tx.split_tags(F.col("t")), "b, a；b、c", ["b", "a", "c"]),
        (lambda: tx.split_tags(F.col("t")), None, []),
        (lambda: tx.years(F.col("t")), "2027届,2026届", [2026, 2027]),
        (lambda: tx.nfkc(F.col("t")), "ＡＢ①", "AB1"),
        (lambda: tx.normal_url(F.col("t")), "HTTPS://Ex.com:443/a/?b=2&a=1#x", "https://ex.com/a?a=1&b=2"),
        (lambda: tx.links(F.col("t")), "see https://a.cn/x, and https://a.cn/x.", ["https://a.cn/x"]),
        (lambda: tx.only_category(F.col("t"), {"campus": "校招", "intern": "实习"}), "校招和实习", None),
        (lambda: tx.only_category(F.col("t"), {"campus": "校招", "intern": "实习"}), "暑期实习", "intern"),
        (lambda: tx.html_text(F.col("t")), "<p>a<script>x()</script> <b>b</b></p>", "a b"),
    ],
)
def test_text(spark, make, text, want):
    assert one(spark, make(), t=text) == want


def test_salary(spark):
    got = one(spark, tx.salary_range(F.col("t")), t="15-25K·14薪")
    assert (got["low"], got["high"], got["months"]) == (15000, 25000, 14)
    assert one(spark, tx.salary_range(F.col("t")), t="面议")["low"] is None


def test_epoch(spark):
    assert one(spark, tx.epoch_timestamp(F.col("n")), n="1700000000") == one(spark, tx.epoch_timestamp(F.col("n")), n="1700000000000")


def test_cosine_of_zero_is_null(spark):
    row = spark.sql("SELECT array(0d, 0d) a, array(1d, 2d) b").select(vec.cosine(F.col("a"), F.col("b")), vec.cosine(F.col("b"), F.col("b"))).first()
    assert row[0] is None and row[1] == pytest.approx(1)


def test_missing_facts_pass_facets(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', array('x')), (2, null, null), (3, 'b', array()), (4, 'a', array('y')) t(id, c, tags)")
    q = facets.FacetQuery(any_of={"c": ["a"]}, overlap={"tags": ["x"]})
    assert [r["id"] for r in facets.filtered(rows, q).collect()] == [1, 2]
    with pytest.raises(ValueError):
        facets.FacetQuery(since=("t", datetime(2020, 1, 1)), unknown="t")


def test_fusion_ignores_input_order(spark):
    k = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.4)], "id long, score double")
    s = spark.createDataFrame([(3, 0.4), (4, 0.9)], "id long, score double")
    want = [(4, 0.45), (3, 0.4), (1, 0.25), (2, 0.2)]
    for a, b in ((k, s), (k.orderBy(F.desc("id")), s.orderBy(F.desc("id")))):
        assert [(r["id"], pytest.approx(r["score"])) for r in matching.fused(a, b, "id").collect()] == want
    with pytest.raises(ValueError):
        matching.Fusion(0.5, 0.6)


def test_merge_again_changes_nothing(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, content string, nature string")
    new = spark.createDataFrame([("b", "3", None), ("c", "4", "z")], "k string, content string, nature string")
    once = merging.merge(old, new, "k", "content", ["nature"])
    assert sorted((r["k"], r["nature"], r["merge_action"]) for r in once.collect()) == [("a", "x", "KEPT"), ("b", "y", "UPDATED"), ("c", "z", "CREATED")]
    twice = merging.merge(once.drop("merge_action"), new, "k", "content", ["nature"])
    assert {r["merge_action"] for r in twice.collect()} == {"KEPT", "UNCHANGED"}


def test_rows_without_key_survive_first_wins(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, n int")
    assert sorted(r["n"] for r in ranking.first_wins(rows, "k", ["n"]).collect()) == [1, 3, 4]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rollups_collect_only_what_they_show(spark):
    rows = spark.sql("SELECT if(id % 10 = 0, null, 'hot') k, if(id = 77, null, id % 500) s, id % 7 who FROM range(1000) UNION ALL SELECT 'none', null, 1")
    got = quality.gaps(rows, ["k"], "who", "s")
    assert "WindowGroupLimit" in plan_of(got) and "collect_set" not in plan_of(got)
    want = {None: (100, 7, [0, 10, 20]), "hot": (900, 7, [1, 2, 3]), "none": (1, 1, [])}
    assert {r["k"]: (r["n"], r["n_who"], r["samples"]) for r in got.collect()} == want
    rollup = catalogue.QUERIES["q06_group_rollup"](spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in plan_of(rollup)


def test_memberships_equal_report(spark):
    rows = spark.sql("SELECT id, if(id < 300, 'hot', if(id < 310, null, cast(id div 3 as string))) k, id % 5 r FROM range(400) UNION ALL SELECT 1, 'hot', 1")
    got = merging.memberships(rows, "k", "id", [F.col("r")])
    assert "collect" not in plan_of(got) and "Generate" not in plan_of(got)
    report = merging.duplicate_report(rows, "k", "id", [F.col("r")])
    assert "collect_set" not in plan_of(report)
    shown = {r["winner"]: (r["ids"], r["n"]) for r in report.collect()}
    members = {}
    for r in got.collect():
        members.setdefault(r["winner"], []).append(r["id"])
    assert shown == {w: (sorted(ids)[:3], len(ids) + (w == 299)) for w, ids in members.items()}  # id 1 comes twice
    assert "collect" not in plan_of(catalogue.QUERIES["q38_repoint"](spark, "/root/testdata/sf0.001"))


def test_envelope_and_json_ld(spark):
    rows = spark.createDataFrame([(1, '{"data":{"items":[{"id":7,"t":"A"},{"id":8}]}}'), (2, "no json")], "p int, body string")
    got = records.envelope(rows, "body", "$.data.items", {"id": "$.id", "title": "$.t"}).collect()
    assert [(r["p"], r["ordinal"], r["id"], r["title"]) for r in got] == [(1, 0, "7", "A"), (1, 1, "8", None)]
    page = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"A"}]}</script>'
    pages = spark.createDataFrame([(1, page), (2, None)], "p int, html string")
    assert [(r["p"], r["ordinal"]) for r in records.json_ld(pages, "p", "html").collect()] == [(1, 0)]


def test_spreadsheet(spark):
    row = ("2026-07-06", "示例科技", "民企", "/", "a", "上海, 南京", "2026/09/02", "2027届", "本科", "暑期", "x", None, "https://a.cn/1 https://a.cn/2")
    got = spreadsheet.typed(spreadsheet.from_values(spark, [("说明",), row])).collect()
    assert len(got) == 1 and got[0]["industry"] is None and got[0]["locations"] == ["上海", "南京"]
    assert got[0]["apply_links"] == ["https://a.cn/1", "https://a.cn/2"] and got[0]["graduation_years"] == [2027]


def test_xlsx(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels.format('<Relationship Id="r1" Target="worksheets/s.xml"/>'),
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>示例</t></si><si><r><t>上海,</t></r><r><t> 南京</t></r></si></sst>',
        "xl/worksheets/s.xml": f'''<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row>
            <row r="3"><c r="A3"><v>46209</v></c><c r="B3" t="s"><v>0</v></c><c r="F3" t="s"><v>1</v></c><c r="M3" t="inlineStr"><is><t>投递</t></is></c><c r="N3"/></row>
            </sheetData><hyperlinks><hyperlink ref="M3" r:id="h1"/></hyperlinks></worksheet>''',
        "xl/worksheets/_rels/s.xml.rels": rels.format('<Relationship Id="h1" Target="https://a.cn/apply" TargetMode="External"/>'),
    }
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    raw = spreadsheet.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    got = raw.collect()
    assert [(r["row_number"], r["updated_at"], r["company_name"], r["apply_url"]) for r in got] == [(3, "2026-07-06", "示例", "投递")]
    typed = spreadsheet.typed(raw).collect()
    # apply_url is the 13th column, M; a cell's link counts though its text holds none
    assert typed[0]["apply_links"] == ["https://a.cn/apply"] and typed[0]["locations"] == ["上海", "南京"]


def test_stream_merge_is_idempotent(spark, tmp_path):
    like = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, content string")
    like.write.parquet(str(tmp_path / "in"))
    at = {"snapshot": spark.createDataFrame([], like.schema)}

    def write(df, number):
        path = str(tmp_path / f"snapshot-{number}")
        df.write.mode("overwrite").parquet(path)
        at["snapshot"] = spark.read.parquet(path)

    each = feeds.merging(lambda: at["snapshot"], write, "k", "content")
    for _ in range(2):
        feeds.run_available(feeds.files(spark, str(tmp_path / "in"), like), each, str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, at["snapshot"].collect())) == [("a", "1"), ("b", "2")]
