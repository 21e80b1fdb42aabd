"""Rules over collected records on odd rows: nulls, blanks, ties, separators inside values, conflicting batches."""

import html
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumine.functions import articles as ar
from vellumine.functions import link_types
from vellumine.functions import text as tx
from vellumine.functions import titles as ti
from vellumine.functions import vectors as vec
from vellumine.operators import identity, listing, matching, merging, quality, ranking, reconcile
from vellumine.sources import payloads, records
from vellumine.streaming import feeds, limiter


def values(spark, make, *texts):
    """make(column) of each text, in one job."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["x"] for r in rows.select("k", make(F.col("t")).alias("x")).orderBy("k").collect()]


CASES = [
    (ar.tag_lines, {"<p>a&amp;b</p>\n <b>c ​d</b>": "a&b\nc d", "<br>": None, None: None, "x": "x"}),
    (ar.block_lines, {"a<b>b</b><p>c  d</p><script>x</script>": "ab\nc d", "&lt;p&gt;q&lt;/p&gt;r": "q\nr", None: None}),
    (ar.embedding_lines, {" a  b\r\n\r\n c ": "a b\nc", "": None, None: None}),
    (
        lambda t: ar.cell_links(t, F.lit(None).cast("string")),
        {
            "see https://a.cn/x，https://b.cn/y。 mailto:hr@x.com, or me@y.org!": ["https://a.cn/x", "https://b.cn/y", "mailto:hr@x.com", "me@y.org"],
            " plain text ": ["plain text"], "": [], None: [], "https://u:p@x.com/ https://u:p@x.com/": ["https://u:p@x.com/"],
        },
    ),
    (lambda t: ar.cell_links(t, F.lit("https://t.cn/a")), {"投递": ["https://t.cn/a"], None: ["https://t.cn/a"]}),
    (ar.canonical_email, {" ＡB@X.com": "ab@x.com", "no address": None, "a" * 250 + "@x.com": None, None: None}),
    (ar.route_identity, {"https://m.com/m/APPLY/o1/22?x": "apply/o1/22", "https://m.com/?u=/apply/o/1": None, None: None}),
    (ar.ms_date, {"/Date(86400000+0800)/": datetime(1970, 1, 2), "/Date(99999999999999)/": None, "2020": None, None: None}),
    (ar.iso_or_epoch, {"86400": datetime(1970, 1, 2), "1970-01-02T00:00:00Z": datetime(1970, 1, 2), "x": None, None: None}),
    (ar.flat_text, {'{"text":{"name":" a "}}': "a", '[1,{"value":2},null,[true]]': "1, 2", '"q"': "q", "p": "p", None: "", "false": ""}),
    (ar.is_education_gap, {"缺少本科学历": True, "x": False, None: False}),
    (lambda t: ar.page_id(t, F.lit("u"), F.lit("t")), {" 7 ": "7", "": "page-", None: "page-"}),
    (ti.unbracketed, {"a(b)": "a", "a（b）": "a", "a(b)c": "a(b)c", "a(b)c)": "a(b)c)", "(b)": "", None: None}),
    (lambda t: ti.safe_titles(t, F.lit("Acme")), {
        "后端工程师(一;二)；测试、测试": ["后端工程师(一;二)", "测试"], "Acme": [], "招聘": [], "后端工程师 前端工程师 实习": ["后端工程师", "前端工程师 实习"],
        "工程师" * 40: [], "1. 销售": ["销售"], None: [], "": [], "销售(未闭合;财务": ["销售(未闭合;财务"], "Product manager,产品经理": ["Product manager,产品经理"],
    }),
    (lambda t: payloads.attribute_json(t, "init-data"), {"<input id='init-data' value='{&quot;a&quot;:1}'>": '{"a":1}', "<p>": None, None: None}),
    (lambda t: payloads.link_to(t, "mokahr.com"), {"go <a href='https://app.mokahr.com/x?a=1&amp;b=2'>": "https://app.mokahr.com/x?a=1&b=2", "https://mokahr.com.evil.cn/": None, None: None}),
    (lambda t: payloads.absolute(t, F.lit("https://s.com/a/b?q")), {"c": "https://s.com/a/c", "/c": "https://s.com/c", "//h.com": "https://h.com", "#x": None, "javascript:x": None, None: None}),
    (lambda t: tx.salary_range(t)["high"], {"8千-1.5万": 15000, "15-25K·14薪": 25000, "1.5-2万": 20000, "面议": None}),
    (identity.plain, {"Ａ  b ": "a b", None: None}),
]


@pytest.mark.parametrize("make, cases", CASES, ids=range(len(CASES)))
def test_values(spark, make, cases):
    got = values(spark, make, *cases)
    want = list(cases.values())
    assert all(g == w or isinstance(w, str) and w == "page-" and g.startswith(w) for g, w in zip(got, want)), list(zip(got, want))


def test_mixed_units_of_salaries(spark):
    got = values(spark, tx.salary_range, "8千-1.5万", "15-25K", "1.5-2万", "100-200")
    assert [(r["low"], r["high"]) for r in got] == [(8000, 15000), (15000, 25000), (15000, 20000), (100, 200)]


def test_keys_do_not_collide(spark):
    pairs = [("a|b", "c", "x"), ("a", "b|c", "x"), (None, "c", "a\x1fb"), ("", "c", "a"), ("a", "", "a"), ("a", None, "b"), ("a\x1f", None, "a")]
    rows = spark.createDataFrame(pairs, "s string, i string, f string")
    keys = rows.select(merging.identity_key(F.col("s"), F.col("i"), F.lit(None).cast("string"), [F.col("f")]).alias("k")).collect()
    digests = rows.select(merging.digest(F.col("s"), F.col("i"), F.col("f")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == len({r["k"] for r in digests}) == len(pairs)


def test_scopes(spark):
    def scope(platform, url):
        return identity.scope([F.lit(platform).cast("string")], [F.lit(url).cast("string")], F.lit("S"), F.lit("g"))

    row = spark.range(1).select(scope(" P", None).alias("a"), scope("", "https://x.zhiye.com./j").alias("b"), scope(None, "https://notzhiye.com").alias("c")).first()
    assert tuple(row) == ("p:g", "host:x.zhiye.com:g", "s:g")


def test_metadata_merges(spark):
    rows = spark.sql("SELECT map('a', '1', 'b', '2') o, map('b', '3') n, array('x') ol, 'y' nn UNION ALL SELECT null, null, null, null")
    got = rows.select(
        identity.merged_metadata(F.col("o"), F.col("n")).alias("m"),
        identity.merged_ids(F.col("ol"), F.lit("X"), F.lit(None).cast("array<string>"), F.col("nn")).alias("ids"),
        identity.content_hash([F.lit("f")], F.col("n")).alias("h"),
    ).collect()
    assert got[0]["m"] == {"a": "1", "b": "3"} and got[0]["ids"] == ["x", "y"] and got[1]["m"] == {} and got[1]["ids"] is None
    assert got[0]["h"] != got[1]["h"]


def test_merge_of_null_keys_reopened_and_stale_vectors(spark):
    schema = "k string, content string, src string, status string, v string"
    old = spark.createDataFrame([(None, "1", "s", "OPEN", "o"), ("a", "1", "s", "CLOSED", "va"), ("b", "1", "s", "OPEN", "vb"), ("c", "1", "s", "OPEN", "vc"), ("d", "1", "s", "CLOSED", "vd")], schema)
    new = spark.createDataFrame([(None, "2", "s", "OPEN", None), (None, "2", "s", "OPEN", None), ("a", "1", "s", "OPEN", None), ("b", "1", "t", "OPEN", None), ("c", "2", "s", "OPEN", None), ("e", "1", "s", None, None)], schema)
    got = sorted(((r["k"] or "", r["merge_action"], r["status"], r["v"]) for r in merging.merge(old, new, "k", "content", provenance=["src"], status="status", invalidated=["v"]).collect()), key=str)
    assert got == sorted([
        ("", "KEPT", "OPEN", "o"), ("", "CREATED", "OPEN", None), ("", "CREATED", "OPEN", None), ("a", "UPDATED", "OPEN", "va"), ("b", "UPDATED", "OPEN", "vb"),
        ("c", "UPDATED", "OPEN", None), ("d", "KEPT", "CLOSED", "vd"), ("e", "CREATED", "OPEN", None),
    ], key=str)


def test_conflicting_batches_are_refused(spark):
    rows = spark.createDataFrame([("a", "1", 2), ("a", "1", 1), (None, "x", 3), (None, "y", 4)], "k string, content string, n int")
    assert sorted(r["n"] for r in merging.without_repeats(rows, "k", "content").collect()) == [1, 3, 4]
    with pytest.raises(ValueError, match="conflicting"):
        merging.without_repeats(rows.unionByName(rows.limit(1).withColumn("content", F.lit(None))), "k", "content")
    written = []
    each = feeds.merging(lambda: rows.limit(0), lambda df, n: written.append(n), "k", "content")
    with pytest.raises(ValueError):
        each(spark.createDataFrame([("a", "1", 1), ("a", "2", 1)], rows.schema), 0)
    assert not written


def test_repointed_keeps_the_first(spark):
    refs = spark.createDataFrame([(1, 5, "b"), (2, 5, "a"), (3, 6, "c")], "id int, user int, note string")
    winners = spark.createDataFrame([(2, 1)], "id int, winner int")
    got = merging.repointed(refs, winners, "id", ["id", "user"], ["note"])
    assert sorted(map(tuple, got.collect())) == [(1, 5, "a"), (3, 6, "c")]


def test_gate_of_all_groups(spark):
    rows = spark.createDataFrame([(1, "x", False), (2, "y", False), (3, "x", True), (None, "z", None)], "g int, p string, old boolean")
    problems = {"CONFLICT": F.col("p") == "x", "UNSAFE": F.col("p") == "y"}
    expected = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,), (4,)], "g int")
    got = {r["g"]: (r["n"], r["reasons"], r["decision"]) for r in quality.gate(rows, ["g"], problems, F.col("old"), ["CONFLICT"], expected).collect()}
    assert got == {
        1: (1, ["CONFLICT"], "ACCEPT"), 2: (1, ["UNSAFE"], "FALLBACK"), 3: (1, ["STALE_PUBLISHED_AT"], "SKIP"),
        4: (0, ["PARSER_EMPTY"], "FALLBACK"), None: (1, [], "ACCEPT"),
    }


def test_verdicts_and_merged_rows(spark):
    rows = spark.createDataFrame(
        [("a", 1, "i", "u", "f", None), ("a", 2, "i", "v", "f", "n"), ("b", 3, "i", "u", "f", "x"), ("b", 4, "i", "v", "g", "y"), ("c", 5, "", "u", "f", None), ("c", 6, "j", "u", "g", None),
         ("d", 7, "i", None, None, "p"), ("d", 8, "j", "", "f", "q"), ("e", 9, "i", None, "f", "r")],
        "k string, id int, sid string, url string, facts string, note string",
    )
    got = {r["k"]: (r["verdict"], r["mergeable"]) for r in reconcile.verdicts(rows, "k", "sid", "url", "facts").collect()}
    assert got == {"a": ("SAME_ID", True), "b": ("ID_CONFLICT", False), "c": ("SAME_ID", True), "d": ("FACT_CONFLICT", False)}
    merged = reconcile.merged(rows, "k", "id", [merging.completeness(F.col("sid"))], ["facts"], ["url"], ["note"], "sid")
    assert {r["id"]: (r["url"], r["note"]) for r in merged.collect()} == {1: ("v", "n"), 3: ("v", "x"), 6: ("u", None), 7: ("", "p"), 9: (None, "r")}
    assert sorted(map(tuple, reconcile.merged_values(spark.sql("SELECT 'a' k, array('x', 'y', 'x') v"), "k", "v").collect())) == [("a", "x"), ("a", "y")]


def test_reference_conflicts(spark):
    refs = spark.createDataFrame([(1, "u", "r1"), (2, "u", "r2"), (3, "w", "r3"), (4, None, "r3"), (5, "z", "r5")], "id int, user string, run string")
    winners = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id int, winner int")
    got = sorted(map(tuple, reconcile.reference_conflicts(refs, winners, "id", ["user", "run"]).collect()))
    assert got == [(1, "user", 1), (3, "run", 1)]


def test_lists(spark):
    rows = spark.createDataFrame([(1, "a", 5, "t1"), (2, "a", 7, "t2"), (3, "b", None, "t3"), (4, None, 9, "t4")], "id int, g string, at int, title string")
    page = listing.group_page(rows, "g", "at", "title", [F.col("at").desc_nulls_last(), F.col("id")], 1, 3, 1).collect()
    assert {r["g"]: (r["n"], r["newest"], r["titles"]) for r in page}["a"] == (2, 7, ["t2"])
    assert [r["position"] for r in listing.by_ids(rows, "id", [4, 9, 1, 4], ["id"]).collect()] == [0, 2, 3]
    assert listing.one(rows, "id", 3).count() == 1 and listing.one(rows, "id", None).count() == 0
    runs = listing.run_page(rows, "at", "id", 2, 2).collect()
    assert all(r["total"] == 4 for r in runs) and len(runs) == 2
    found = spark.range(1).select(listing.progress(F.lit(3), F.lit(7)).alias("a"), listing.progress(F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(found) == (67, 50)


def test_embedded_payloads(spark):
    page = """<script>self.__next_f.push([1,"5:{\\"id\\":1}"])</script><script>self.__next_f.push([1,"x"])</script>
    <script>window.__INITIAL_DATA__ = {"a": "}]", b: ['[', `{`]};</script> phApp.ddo = [1, 2"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    assert [r["value"] for r in payloads.embedded(pages, "id", "html", payloads.pushed).collect()] == ['{"id": 1}']
    assert [r["value"] for r in payloads.embedded(pages, "id", "html", payloads.after("__INITIAL_DATA__")).collect()] == ["{\"a\": \"}]\", b: ['[', `{`]}"]
    assert payloads.embedded(pages, "id", "html", payloads.after("phApp.ddo")).count() == 0
    assert payloads.literal_at("[" * 50_000, 0) is None


def test_methods_of_articles(spark):
    def kinds(content, images=0):
        made = ar.application_methods(F.lit("https://a.com/"), F.lit(content).cast("string"), F.lit(None).cast("array<string>"), F.lit(images))
        return spark.range(1).select(made.alias("m"), ar.application_status(made).alias("s"), ar.review_reasons(F.lit("announcement"), made).alias("r")).first()

    none = kinds(None)
    assert (none["m"], none["s"], none["r"]) == ([], "not_found", ["no_application_method"])
    assert kinds("请投递")["s"] == "unknown" and kinds("扫码", 2)["s"] == "qr" and kinds("加微信")["s"] == "wechat_contact"
    assert [m["value"] for m in kinds("报名 https://h.com/x https://a.com/#y 或 a@b.cn")["m"]] == ["https://h.com/x", "a@b.cn"]


def test_nearest_and_assembled(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [r["id"] for r in matching.nearest(items.where("id < 3"), "id", "v", [1.0, 0.1], 2).collect()] == [1, 2]
    assert [r["x"] for r in items.select(vec.is_vector(F.col("v"), 2).alias("x")).collect()] == [True, True, False, True]
    scores = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7)], "id int, score double")
    asked = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, matched boolean")
    assert [(r["id"], r["position"]) for r in matching.assembled(scores, asked, items, "id", 1).collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        matching.nearest_per_profile(spark.range(10_001).selectExpr("id profile", "array(1D) query"), items.selectExpr("id", "v vec"), 1)


def test_streams_append_and_are_due(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2026, 1, 2), "h1"), ("b", datetime(2026, 1, 1), "h2"), ("c", datetime(2026, 1, 3), "h3")], "id string, at timestamp, h string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feeds.append_available(feeds.files(spark, str(tmp_path / "in"), rows), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    state = spark.createDataFrame([("c", "h3", "OK"), ("a", "h1", "FAILED")], "id string, h string, status string")
    assert [r["id"] for r in feeds.due(rows, state, "id", "h", "at", "2026-01-01").collect()] == ["a"]


def test_limiter_decides_nothing_about_nobody(spark):
    rows = spark.createDataFrame([(None, datetime(2026, 1, 1), 1), ("u", datetime(2026, 1, 1), 2)], "k string, ts timestamp, id int")
    assert {r["id"]: r["accepted"] for r in limiter.accepted(rows, "k", "ts", "id", 1, 60).collect()} == {1: None, 2: True}


def test_only_references_of_texts_go_to_python(spark):
    texts = ["", None, "a", "&", "&&amp;", "&amp;amp;lt;", "x&ampy&amp;z&amp", "&notit;&notin;", "&#65;&#x42&#0;&#128;&#xD800;&#1114112;", "&#;&#x;&;& a", "a\n&lt;b&gt;\n", "&nbsp;😀&CounterClockwiseContourIntegral;&zz;😀&", "&é;&\tlt;", "&" + "q" * 40 + ";&lt;"]
    assert values(spark, ar.unescaped, *texts) == [None if t is None else html.unescape(t) for t in texts]
    plan = spark.createDataFrame([("x",)], "t string").select(ar.tag_lines(F.col("t")).alias("a"), ar.block_lines(F.col("t")).alias("b"))
    calls = re.findall(r"ArrowEvalPython \[(.*)", plan._jdf.queryExecution().optimizedPlan().toString())
    assert calls and all(c.count("array_distinct(") == c.count("unescaped") for c in "".join(calls).split("\n"))


def test_page_errors_and_first_of(spark):
    rows = spark.createDataFrame([("s", 1, "a", 3), ("s", 2, "a", 3), ("t", 1, "b", 1), ("u", 1, None, 1)], "src string, page int, item string, total int")
    got = {r["src"]: (r["missing_ids"], r["repeated_ids"], r["short_by"]) for r in records.page_errors(rows, "src", "page", "item", "total").collect()}
    assert got == {"s": (0, 1, 2), "u": (1, 0, 1)}
    assert spark.range(1).select(records.first_of(F.lit(None).cast("string"), F.lit(" "), F.lit(" x ")).alias("x")).first()["x"] == "x"
    assert values(spark, tx.haystack, " A b") == [" a b"]
    assert values(spark, lambda t: merging.union_ignoring_order(F.array(t), F.lit(None).cast("array<string>")), "x") == [["x"]]


def test_first_wins_of_the_library(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1)], "k string, n int")
    assert [r["n"] for r in ranking.first_wins(rows, "k", ["n"]).collect()] == [1]
    assert values(spark, link_types.link_type, "https://x.zhiye.com/") == ["BEISEN"]
