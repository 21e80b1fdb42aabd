import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vellumine.functions import link_types
from vellumine.functions import normalize as nm
from vellumine.operators import history, sites
from vellumine.sources import documents


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, text, want",
    [
        (nm.city, "ＲＥＭＯＴＥ", "远程"),
        (nm.city, " 上海　市 ", "上海"),
        (nm.city, "待定", None),
        (nm.city, None, None),
        (nm.locations, "上海市/上海，Berlin；berlin 、不限", ["上海", "Berlin"]),
        (nm.locations, None, []),
        (nm.tags, "秋招\n秋招、Ａ;a", ["秋招", "A"]),
        (nm.tags, "", []),
        (nm.company_nature, "中央国有企业 ", "央企"),
        (nm.company_nature, "合伙", None),
        (nm.recruitment_type, "校招 / 社招", None),
        (nm.recruitment_type, None, None),
        (nm.education, "硕士研究生或博士", "硕士"),
        (nm.education, "学历不限", None),
        (nm.education, None, None),
        (nm.title_list, "算法(视觉;语音)；测试、 测试", ["算法(视觉;语音)", "测试"]),
        (nm.title_list, None, []),
        (nm.bare_title, "1. 算法工程师（北京）", "算法工程师"),
        (lambda t: nm.first_tokens(t, 3), "后端 engineer, x", "后端 engineer"),
        (lambda t: nm.first_tokens(t, 9), "", ""),
        (lambda t: nm.company_group(t, F.lit(None).cast("string")), " ", "name:unknown"),
        (link_types.link_type, None, "UNKNOWN"),
        (link_types.link_type, "https://A.MokaHR.com./x", "MOKA"),
        (link_types.link_type, "https://x.com/?next=%zz", "UNKNOWN"),
        (link_types.link_type, "https://u:p@x.com/survey", "FORM_OR_SHORT"),
        (link_types.link_type, "https://[::1]/job", "UNKNOWN"),
    ],
)
def test_canonical(spark, make, text, want):
    assert one(spark, make, text) == want


def test_long_text_is_cut_at_its_tokens(spark):
    assert one(spark, lambda t: nm.first_tokens(t, 512), "ab, " * 50_000) == ("ab, " * 256).rstrip()


def test_versions_and_replays_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (None, 4, "a"), (None, 5, "b")], "k int, o int, f string")
    got = {(r["o"], r["version"]) for r in history.versioned(rows, "k", ["o"], ["f"]).collect()}
    assert got == {(1, 1), (3, 2), (4, 1), (5, 2)}
    outcomes = {r["o"]: r["outcome"] for r in history.replays(rows, "k", "f", ["o"]).collect()}
    assert outcomes == {1: "FIRST", 2: "REPLAY", 3: "CONFLICT", 4: "FIRST", 5: "CONFLICT"}
    assert history.versioned(rows.limit(0), "k", ["o"], ["f"]).count() == 0


def test_last_word_counts(spark):
    at = lambda d: datetime(2026, 1, d)
    rows = spark.createDataFrame([(1, at(1), 1, "add"), (1, at(2), 2, "del"), (2, at(1), 3, "add"), (3, at(1), 4, None)], "k int, ts timestamp, id int, what string")
    kept = history.bridged(rows, ["k"], "what", ["ts", "id"], "add", "del").collect()
    assert [(r["k"], r["ts"]) for r in kept] == [(2, at(1))]


def _docx(path, *paragraphs):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>!</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')


def test_documents(spark, tmp_path):
    _docx(tmp_path / "a.docx", "后端", "x &amp; y")
    (tmp_path / "b.txt").write_bytes("简历".encode("gb18030"))
    (tmp_path / "c.md").write_bytes(b"\xef\xbb\xbf# t")
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    found = documents.document_texts(spark, str(tmp_path)).collect()
    got = {r["path"].rpartition("/")[2]: (r["text"], r["problem"]) for r in found}
    assert got == {
        "a.docx": ("后端\t!\nx & y\t!", None),
        "b.txt": ("简历", None),
        "c.md": ("# t", None),
        "d.docx": (None, "BadZipFile"),
    }


def test_vectors_are_filled(spark):
    rows = spark.createDataFrame([(1, "ab", None), (2, None, None), (3, "x", [9.0, 9.0])], "id int, t string, v array<float>")
    load = lambda: lambda texts: [[len(t), 1] for t in texts]
    got = {r["id"]: r["v"] for r in sites.filled_vectors(rows, "id", "t", "v", load, 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [9.0, 9.0]}
    with pytest.raises(Exception, match="finite numbers"):
        sites.filled_vectors(rows, "id", "t", "v", load, 3).collect()


def test_profiles_of_odd_links(spark):
    rows = spark.createDataFrame([(1, "https://a.x.cn/1", "Acme Ltd"), (2, "https://x.cn.evil.com", "acme"), (3, None, None)], "id int, url string, name string")
    profiles = spark.createDataFrame([(0, "p", "x.cn", "acme")], "ordinal int, profile string, domain string, alias string")
    assert [tuple(r) for r in sites.company_profiles(rows, "id", "url", "name", profiles).collect()] == [(1, "p")]
