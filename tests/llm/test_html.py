"""The site style tree against a plain recursion, and what it removes under names that say nothing."""

import math
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumine.llm import html_extract as he
from vellumine.llm.dom import parse

SCHEMA = "page_id long, url string, html string"


def plain_tree(pages):
    """Importance by path, straight from the definition; pages are (host, html)."""
    nodes = defaultdict(lambda: {"pages": 0, "texts": Counter(), "words": {}, "styles": Counter(), "shares": Counter()})
    for host, html in pages:
        page = parse(html, he.site_key(host))
        path = {0: (host,)}
        for k in range(1, len(page.keys)):
            path[k] = (*path[page.parents[k]], page.keys[k])
        below, texts, styles = defaultdict(set), set(), defaultdict(set)
        for b in page.blocks:
            at = (*path[b.node], "#text")
            texts.add((at, b.text))
            while len(at) > 1:
                below[at[:-1]].add(at)
                at = at[:-1]
        for k, style in page.styles:
            styles[path[k]].add(style)
        for at in {*below, *(t[0] for t in texts)}:
            nodes[at]["pages"] += 1
        for at, children in below.items():
            nodes[at]["styles"][tuple(sorted(styles[at]))] += bool(styles[at])
            for c in children:
                nodes[at]["shares"][c] += 1 / len(children)
        for at, text in texts:
            nodes[at]["texts"][text] += 1
            nodes[at]["words"][text] = len(text.split())

    def importance(at):
        n, m = nodes[at], nodes[at]["pages"]
        if at[-1] == "#text":
            total = sum(n["words"][t] * k for t, k in n["texts"].items())
            return 1 - sum(n["words"][t] * k * math.log(k) for t, k in n["texts"].items()) / total / math.log(m) if m > 1 else 1.0
        styles = {s: k for s, k in n["styles"].items() if s}
        s = sum(styles.values())
        own = 1.0 if m == 1 else -sum(k / s * math.log(k / s) for k in styles.values()) / math.log(s) if s > 1 else 0.0
        damped = he.DAMPING ** max(1, len(styles))
        return (1 - damped) * own + damped * sum(w / m * importance(c) for c, w in n["shares"].items())

    return sorted((n["pages"], len(at), round(importance(at), 4)) for at, n in nodes.items())


def test_importance_equals_plain_recursion(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    rows += [(1000 + i, "https://x.com", f"<div><p>same</p><ul><li>a{i}<li>b</ul>{'<table><tr><td>c' * (i % 3)}</div>t{i % 4}") for i in range(20)]
    want = plain_tree([(he.host_of(u), h) for _, u, h in rows])
    trees = he.style_trees(he.tree_nodes(he.page_features(he.parsed(spark.createDataFrame(rows, SCHEMA)))))
    got = [(r["pages"], r["n"], r["importance"]) for r in trees.select("pages", F.size("chain").alias("n"), "importance").collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted((a, b, round(c, 4)) for a, b, c in got), want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-4)


def test_tree_finds_menus_and_adverts_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    marked = he.low_nodes(he.style_trees(he.tree_nodes(he.page_features(he.parsed(pages))))).where(F.col("words").isNotNull()).cache()
    low, known = marked.where("low"), marked.where("known")
    # on every host with more than a few pages, leaves that elements call noise are low too, and none of main text is
    assert low.count() > 60 and low.where("kept").count() == 0
    big = known.where("pages >= 40 and not kept")
    assert big.where("low").count() >= 0.9 * big.count()
    marked.unpersist()


def neutral(html):
    """The page under names that say nothing, without landmarks."""
    html = re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1section>", html)
    return html.replace('<div class="ad">', '<div class="q">')


def test_neutral_names_lose_what_repeats(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.1/pages.parquet' WHERE url LIKE '%blog.tionsh.example.com%'").fetchall()
    got = he.extract(spark.createDataFrame([(i, u, neutral(h)) for i, u, h in rows], SCHEMA)).collect()
    with_marks = {r["page_id"]: r["text"].split("\n") for r in he.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    main = Counter(t for ts in with_marks.values() for t in ts)
    kept = noise = lost = 0
    for r in got:
        lines, own = Counter(r["text"].split("\n")), Counter(with_marks[r["page_id"]])
        kept += sum((lines & own).values())
        lost += sum((own - lines).values())
        noise += sum((lines - own).values())
    total_noise = sum(len(parse(h).blocks) for _, _, h in rows) - sum(main.values())
    assert lost <= 0.08 * (kept + lost) and noise <= 0.25 * total_noise


PAGE = """<div class=a><div class=b><span>Home</span></div><div class=b>Shop</div><div class=b>About us</div></div>
<div class=c><h1>Title {i}</h1><p>Story {i} tells of {i} things</p><p>It ends with {i}</p></div>
<div class=d><h3>{n} Comments</h3><div><p>Reader {i} likes it</p></div></div>
<div class=e>Copyright by the shop</div>"""


def test_neutral_names_lose_menu_footer_and_comments(spark, monkeypatch):
    rows = [(i, "https://n.com/", PAGE.format(i=i, n=i % 3 + 2)) for i in range(30)]
    rows += [(None, "https://n.com/", PAGE.format(i=90, n=1)), (None, "https://n.com/", PAGE.format(i=91, n=1)), (5, "https://n.com/", PAGE.format(i=92, n=1))]
    want = sorted(f"Title {i}\nStory {i} tells of {i} things\nIt ends with {i}" for i in [*range(30), 90, 91, 92])
    for most in (he.MOST_GONE, 0):  # null and repeated ids come out alike on both ways
        monkeypatch.setattr(he, "MOST_GONE", most)
        got = he.extract(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(r["text"] for r in got) == want
        assert sum(r["page_id"] is None for r in got) == 2


def test_deep_nesting_takes_linear_time(spark):
    for html in ("<div>" * 100_000 + "x", "<b>" * 20_000 + "</i>" * 2_000 + "x" + "</b>" * 20_000, "<div>a" * 50_000, "<p>" * 50_000 + "x"):
        began = time.time()
        page = parse(html)
        assert page.blocks and max(page.depths) <= 33 and time.time() - began < 20
    rows = [(i, "https://d.com/", "<div>" * 50_000 + f"x{i}") for i in range(3)]
    assert [r["text"] for r in he.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()] == ["x0", "x1", "x2"]


def test_labels_of_comments(spark):
    def left(html):
        return [b.text for b in he.by_elements(parse(html))]

    assert left("<div><p>a</p><div><h3>3 replies</h3><p>c</p></div></div>") == ["a"]
    assert left("<h1>Comments</h1><p>a</p>") == ["Comments", "a"]
    assert left("<article><h2>Comments</h2><p>a</p></article>") == ["Comments", "a"]
    assert left("<div><p>a</p><h3>Responses</h3><p>b</p></div>") == ["a", "Responses", "b"]


MAIN = "<h1>Head line of it</h1>" + "".join(f"<p>Paragraph {i} of the article with some more words in it.</p>" for i in range(6))
BAD = "<p>XX bad</p>"


def kept(html):
    return [b.text for b in he.by_elements(parse(html))]


@pytest.mark.parametrize(
    "html",
    [
        *[f"<article>{MAIN}<div {a}>{BAD}</div></article>" for a in (
            "class='comment-list'", "id='comments-section'", "class='share-buttons'", "class='newsletter-box'", "class='related-posts'", "class='ad-slot'",
        )],
        f"<main><div class='sidebar-left'>{BAD}</div>{MAIN}</main>", f"<article>{MAIN}</article><article class='teaser'>{BAD}</article>",
        f"<article class='teaser'>{BAD}</article><article>{MAIN}</article><article class='comment-entry'>{BAD}</article>",
        f"<article>{MAIN}<article class='comment-entry'>{BAD}</article></article>", f"<form id='aspnetForm'><article>{MAIN}</article></form>",
        f"<form id='aspnetForm'><div>{MAIN}</div><div class='nav'>XX</div></form>", f"<article>{MAIN}<form>{BAD}</form></article><form>{BAD}</form>",
        f"<article><div class='content-with-sidebar'>{MAIN}</div></article>", f"<article><form>{BAD}</form>{MAIN}<form>{BAD}</form></article>",
        f"<article><div class='text-with-ads'><div class='ad-one'>{BAD}</div>{MAIN}<div class='ad-two'>{BAD}</div></div></article>",
    ],
)
def test_shares_of_words_decide_in_landmarks(html):
    assert kept(f"<body>{html}</body>") == re.findall("(?:Head|Paragraph)[^<]*", MAIN)


def test_many_doubtful_elements_take_linear_time():
    began = time.time()
    assert len(kept(f"<article>{'<div class=ad-x>' * 20_000}{MAIN * 3000}{'</div>' * 20_000}</article>")) == 21_000
    assert time.time() - began < 10
