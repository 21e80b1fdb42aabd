import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from compare import DATA

import corpus_pipeline
from vellumine.llm import html_extract, language_id, mixing, sharding, simhash, sql
from vellumine.llm.dom import parse


def lines(html):
    return "\n".join(b.text for b in html_extract.by_elements(parse(html))).split("\n")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body><nav>Menu</nav><article><h1>A &amp; B</h1><p>One<b> two<p>Three</article><footer>f</footer>", ["A & B", "One two", "Three"]),
        ("<div class='sidebar'>s</div><p>text<br>more</p><div id='comments'><p>nice</p></div>", ["text more"]),
        ("<header>h</header><main><p>x&nbsp;y</p><aside>a</aside><form><p>f</p></form></main><p>after</p>", ["x y"]),
        ("<script>var t='</p>'</script><style>p{}</style><!-- c --><p>a</p>tail", ["a", "tail"]),
        ("<article><p>a<div class='ad'>buy</div><ul><li>x<li>y</ul></article>", ["a", "x", "y"]),
        ("plain text", ["plain text"]),
        ("", [""]),
        (None, [""]),
        ("<p>unclosed <a href='x>y", ["unclosed y"]),
    ],
)
def test_main_text(html, want):
    assert lines(html) == want


def test_branches_that_repeat_go(spark):
    page = "<div class='top'>Our shop sells things</div><div class='body'><p>Story {0} is about {0}</p><p>Then {0} ends</p></div>"
    rows = [(i, f"https://ex.com/{i}", page.format(f"n{i}"), 1) for i in range(20)] + [(90, None, None, 1), (91, "https://a.b/", "", 1)]
    rows += [(100 + i, "https://copies.com/", "<div><p>same text</p></div>", 1) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, low int")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"Story n{i} is about n{i}\nThen n{i} ends" for i in range(20))
    assert got[90]["text"] == got[91]["text"] == "" and got[90]["n_chars"] == 0
    assert all(got[100 + i]["text"] == "same text" for i in range(20))  # copies are no boilerplate
    assert html_extract.extract(pages.where("false")).count() == 0


def test_what_goes_may_be_joined(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "MOST_GONE", 0)
    test_branches_that_repeat_go(spark)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article class='post category-notice tag-sharing comment-open'><p>a</p></article><p>b</p>", ["a"]),
        ("<article><h2 id='related-work'>Related work</h2><p>a</p><h2 id='search'>Search</h2></article>", ["Related work", "a", "Search"]),
        ("<article><section id='search-algorithms'><p>a</p></section><div class='share'>s</div></article>", ["a"]),
        ("<article><div class='post-sidebar-left'><p>a</p></div><div class='social-share'>s</div></article>", ["a"]),
        ("<p>top</p><div class='post-sidebar-left'><article><p>a</p></article></div>", ["top", "a"]),
        ("<div class='post-sidebar-left'><h1>t</h1><p>a</p></div><div class='sidebar'>s</div>", ["t", "a"]),
        ("<div class='related-posts'><article>teaser</article></div><article><p>a</p></article>", ["a"]),
        ("<div class='sidebar'><article>teaser</article></div><p>a</p><div class='post-comments'>c</div>", ["a"]),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", ["So x=2 holds"]),
        ("<p><math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math></p>", ["x"]),
    ],
)
def test_names_of_noise(html, want):
    assert lines(html) == want


def extracted(spark, pages):
    """Texts by page id; pages are (id, host, html)."""
    rows = [(i, f"https://{host}/{i}", html) for i, host, html in pages]
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_keep_titles_and_repeated_lists_go(spark):
    copy = "<div><h1>Title</h1>" + "".join(f"<p>Paragraph {k}</p>" for k in range(12)) + "</div>"
    pages = [(i, "copies.com", copy) for i in range(10)]
    pages += [(100 + i, "two.com", copy.replace("Title", f"Title {i % 2}").replace("Par", f"{i % 2} par")) for i in range(40)]
    items = "<ul>" + "".join(f"<li>Item {k}</li>" for k in range(30)) + "</ul>"
    pages += [(200 + i, "list.com", f"{items}<div><p>Story {i}</p><p>End {i}</p></div>") for i in range(20)]
    # a branch goes whole, with the one item that only this page has
    pages += [(300 + i, "own.com", items[:-5] + f"<li>Own {i}</li></ul><div><p>Story {i} and what became of it</p></div>") for i in range(20)]
    got = extracted(spark, pages)
    text = "\n".join(["Title", *(f"Paragraph {k}" for k in range(12))])
    assert all(got[i] == text for i in range(10))
    assert all(got[100 + i].startswith(f"Title {i % 2}\n") and got[100 + i].count("\n") == 12 for i in range(40))
    assert all(got[200 + i] == f"Story {i}\nEnd {i}" for i in range(20))
    assert all(got[300 + i] == f"Story {i} and what became of it" for i in range(20))


def test_articles_keep_what_they_share(spark):
    article = "<div class='top'>Our shop</div><article><h1>T {0}</h1><h2>Summary</h2><p>Story {0}</p><ul><li>Same</li></ul></article>"
    bare = "<div class='top'>Our shop</div><div><p>Story {0}</p></div>"
    for n in (7, 50):  # fewer and more than LEAST_PAGES
        pages = [(i, "ex.com", article.format(i)) for i in range(n)] + [(100 + i, "ex.com", bare.format(i)) for i in range(n)]
        got = extracted(spark, pages)
        assert all(got[i] == f"T {i}\nSummary\nStory {i}\nSame" for i in range(n))
        assert n < html_extract.LEAST_PAGES or all(got[100 + i] == f"Story {i}" for i in range(n))


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 300 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(docs, none):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6, 7}
    assert all(got[i]["score"] == 0 for i in (4, 5, 6, 7)) and got[8]["lang_pred"] == "de"
    assert language_id.identify(none).count() == 0
    assert language_id.drop_undetermined(docs).columns == docs.columns


def test_mix_meets_targets(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sources = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        s = sources.setdefault(r["source"], [r["source_size"], r["target"], 0, 0, 0])
        s[2] += r["size"]
        s[3] += r["taken"]
        s[4] = max(s[4], r["size"])
    assert all(s[0] == s[2] and s[1] <= 3 * s[0] and abs(s[3] - s[1]) <= s[4] for s in sources.values())
    assert sum(s[1] for s in sources.values()) == pytest.approx(sum(s[0] for s in sources.values()))
    assert mixing.mix(none).count() == 0
    copies = {}
    for r in mixing.mixed_documents(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for r in rows:
        assert copies.get(r["doc_id"], 0) == r["copies"] * (2 if r["doc_id"] == 12 else 1)


def test_shards_fit(spark, docs, none):
    big = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    for limit in (200, 5000, 10**9):
        rows = sharding.assign_shards(big, limit=limit).collect()
        assert len(rows) == 3000
        sums = {}
        for r in rows:
            sums.setdefault(r["shard"], [0, r["shard_bytes"]])[0] += r["n_bytes"]
        assert all(a == b <= limit for a, b in sums.values())
        names = sorted(s for s in sums if s != "*")
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard holds another
    rows = sharding.assign_shards(docs, limit=1000).collect()
    assert len(rows) == docs.count()
    assert all(r["shard_bytes"] <= 1000 or r["n_bytes"] > 1000 for r in rows if r["n_bytes"])
    assert sharding.assign_shards(none).count() == 0


def test_written_shards(spark, tmp_path):
    big = spark.range(500).selectExpr("id as doc_id", "repeat('x', 10) as text")
    sharding.write_shards(big, str(tmp_path / "shards"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 500 and back.select("shard").distinct().count() > 4


def test_pipeline_stages(spark, docs):
    columns = docs.columns
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(DATA))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        df = out
    assert df.count() > 0


def test_pipeline_run_against_plain_steps(spark):
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' WHERE regexp_matches(text, '\\pL')").fetchall())
    keep = {}
    for i in sorted(texts, key=lambda i: (-len(texts[i]), i)):
        keep.setdefault("".join(texts[i].split()), i)
    ids = {r["doc_id"] for r in got}
    assert ids <= set(keep.values()) and all(r["round_trip"] for r in got)
    n = {}
    for r in got:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert max(n.values()) <= 3


def test_pipeline_run_equals_plain_steps(spark):
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' WHERE text IS NOT NULL").fetchall()
    texts = {i: t for i, t, _, _ in rows}
    bundles = {i: language_id.bundle(*np.unique(language_id.grams(t), return_counts=True)) for i, t in texts.items()}
    profiles = {}
    for i, _, lang, _ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            profiles[lang] = profiles.get(lang, 0) + bundles[i]
    known = {i for i, t in texts.items() if any(map(str.isalpha, t)) and max(p @ bundles[i] for p in profiles.values()) > 0}
    exact = {}
    for i in sorted(known, key=lambda i: (-len(texts[i]), i)):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i]), i)
    prints = {i: simhash.fingerprint(texts[i]) for i in exact.values()}
    root = {i: i for i in prints}
    changed = True
    while changed:
        near = [(i, min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)) for i in prints]
        changed = any(root[i] != r for i, r in near)
        root.update(near)
    documents = pd.DataFrame([r for r in rows if root.get(r[0]) == r[0]], columns=["doc_id", "text", "lang", "source"])
    mix = duckdb.connect().register("documents", documents).sql(sql.MIXING).fetchall()
    want = Counter({r[0]: r[4] // r[1] for r in mix if r[4]})
    assert Counter(r["doc_id"] for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in {r["doc_id"]: r for r in got}.values():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])
