"""What pages embed for their scripts: pushed payloads, data in attributes and literals, cards, links to jobs."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.articles import unescaped, unescaped_each
from ..functions.text import collapsed

# Marks of embedded data, paths of jobs, and words of links to them.
PUSH = r"self\.__next_f\.push\(\[\s*1\s*,\s*"
JOB_PATH = r"(?i)/(?:job|jobs|position|positions|vacancy|vacancies|opening|detail|recruitment/job)(?:/|$)"
LIST_PATH = r"(?i)/(?:jobs|positions|list|index|home)/*$"
NO_TITLE = ["详情", "查看", "申请", "立即投递", "apply", "more"]
JOB_WORDS = (
    "岗位 职位 招聘 实习 工程师 经理 分析师 设计师 开发 顾问 专员 助理 teacher engineer manager analyst developer designer intern "
    "consultant specialist"
).split()
_QUOTES = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`|[\[\]{}]", re.S)


def literal_at(text: str, start: int) -> str | None:
    """The balanced literal (list or object) whose bracket stands at start; brackets in quotes don't count."""
    depth = 0
    for m in _QUOTES.finditer(text, start):
        if m[0] in "[{":
            depth += 1
        elif m[0] in "]}":
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def pushed(page: str) -> Iterator[str]:
    """JSON texts that a page pushes as `id:json` strings."""
    decoder = json.JSONDecoder()
    for m in re.finditer(PUSH, page):
        try:
            payload, _ = decoder.raw_decode(page, m.end())
            value, _ = decoder.raw_decode(payload.partition(":")[2]) if isinstance(payload, str) else (None, 0)
        except ValueError:
            continue
        if value is not None:
            yield json.dumps(value, ensure_ascii=False)


def after(mark: str) -> Callable[[str], Iterator[str]]:
    """The literals that stand behind a mark, such as `__INITIAL_DATA__ =`; a page may have several."""

    def found(page: str) -> Iterator[str]:
        for m in re.finditer(re.escape(mark), page):
            opens = re.compile(r"[\s=:(]*([\[{])").match(page, m.end())
            literal = literal_at(page, opens.start(1)) if opens else None
            if literal:
                yield literal

    return found


def embedded(pages: DataFrame, id_col: str, html_col: str, find: Callable[[str], Iterator[str]]) -> DataFrame:
    """id, ordinal and text of everything that `find` yields for a page (pushed, or after a mark)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, v) for i, page in zip(f[id_col], f[html_col]) if page for n, v in enumerate(find(page))]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "value"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html_col).cast("string")).mapInPandas(each, f"{id_col} {kind}, ordinal int, value string")


def attribute_json(page: Column, element_id: str) -> Column:
    """The decoded value of the element with that id (`<input id=... value=...>`); null if it isn't there."""
    tag = F.regexp_extract(page, rf"""(?is)(<[a-z]+\b[^>]*\bid=["']{element_id}["'][^>]*>)""", 1)
    found = F.regexp_extract(tag, r"""(?is)\bvalue=("[^"]*"|'[^']*')""", 1)
    return unescaped(F.when(F.length(found) > 2, F.substring(found, 2, F.length(found) - 2)))


_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_anchors(page: Column) -> Column:
    """Array of (ordinal, attributes, href, text) of a page's anchors, in order; null if there is no page.

    Either kind of quote; tags within an anchor go, its text is one line, null if there is none.
    """
    whole = F.regexp_extract_all(page, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    attributes = F.transform(whole, lambda a: F.regexp_extract(a, r"(?is)^<a\b([^>]*)>", 1))
    hrefs = F.transform(attributes, lambda a: F.concat(*[F.regexp_extract(a, _HREF, k) for k in (1, 2, 3)]))
    texts = F.transform(whole, lambda a: F.regexp_replace(a, "<[^>]+>", "\n"))
    zipped = F.arrays_zip(attributes.alias("attributes"), unescaped_each(hrefs).alias("href"), unescaped_each(texts).alias("text"))

    def row(x: Column, at: Column) -> Column:
        text = collapsed(F.replace(x["text"], F.lit("\u200b"), F.lit("")))
        return F.struct(at.alias("ordinal"), x["attributes"].alias("attributes"), x["href"].alias("href"), F.when(text != "", text).alias("text"))

    return F.transform(zipped, row)


def anchors(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, ordinal, attributes, href and text of every anchor of every page (see page_anchors)."""
    return pages.select(F.col(id_col), F.inline(page_anchors(F.col(html_col))))


def absolute(href: Column, page_url: Column) -> Column:
    """A link of a page as a web address; null for scripts, mails and places on the page."""
    origin = F.regexp_extract(page_url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(page_url, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(origin, F.lit("/")))
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z]+:)", 1)
    return (
        F.when(href.rlike("(?i)^(javascript:|mailto:|tel:|data:|#)") | (href == ""), None)
        .when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(~href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(folder, href))
    )


def linked_jobs(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, ordinal, title, detail_url and source_job_id of the anchors that lead to a job, each address once a page.

    A row is a page: all of it is done within the row, so repeated and null ids keep their own
    links, and nothing is shuffled.
    """
    found = pages.select(F.col(id_col), F.col(url_col).alias("__page"), page_anchors(F.col(html_col)).alias("__anchors"))

    def job(a: Column) -> Column:
        return F.struct(a["ordinal"].alias("ordinal"), a["text"].alias("title"), absolute(a["href"], F.col("__page")).alias("detail_url"))

    def fine(j: Column) -> Column:
        path = F.regexp_extract(j["detail_url"], r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
        title = j["title"]
        leads = path.rlike(JOB_PATH) & ~path.rlike(LIST_PATH)
        return leads & (F.length(title) > 1) & ~F.lower(title).isin(NO_TITLE) & title.rlike(f"(?i){'|'.join(JOB_WORDS)}")

    rows = found.withColumn("__jobs", F.filter(F.transform("__anchors", job), fine))
    first = lambda j, at: F.array_position(F.col("__jobs.detail_url"), j["detail_url"]) == at + 1
    once = rows.select(F.col(id_col), F.inline(F.filter("__jobs", first)))
    own = [F.regexp_extract("detail_url", rf"[?&]{k}=([^&#]+)", 1) for k in ("id", "jobId", "positionId", "postId", "job_id")]
    last = F.regexp_extract(F.regexp_replace("detail_url", r"[?#].*$|/+$", ""), "([^/]+)$", 1)
    ids = F.coalesce(*[F.when(o != "", o) for o in own], F.when(~F.lower(last).isin("detail", "index"), last))
    return once.select(id_col, "ordinal", "title", "detail_url", ids.alias("source_job_id"))


def cards(pages: DataFrame, id_col: str, html_col: str, css: str, call: str) -> DataFrame:
    """id, ordinal, title and source_job_id of server-rendered cards: anchors of a class whose handler calls `call(id)`."""
    found = anchors(pages, id_col, html_col)
    card = F.regexp_extract(unescaped(F.col("attributes")), rf"""{call}\(["']([^"']+)["']""", 1)
    fine = F.contains(F.col("attributes"), F.lit(css)) & (card != "") & F.col("text").isNotNull()
    return found.where(fine).select(id_col, "ordinal", F.col("text").alias("title"), card.alias("source_job_id"))


def link_to(page: Column, domain: str) -> Column:
    """The first link of a page to a domain or one below it: where its jobs are; null if there is none."""
    found = F.regexp_extract(unescaped(page), rf"(?i)(https?://(?:[a-z0-9-]+\.)*{re.escape(domain)}(?![\w.-])(?::\d+)?(?:[/?#][^\s\"'<>]*)?)", 1)
    return F.when(found != "", found)


def salary_of(value: Column) -> Column:
    """struct(low, high, months) of a JSON salary (nested in `value` or not) or of a text with two numbers."""
    nested = lambda names: F.coalesce(*[F.get_json_object(value, p + n) for n in names for p in ("$.value.", "$.")])
    number = lambda c: F.floor(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(c.rlike("(?i)k|千"), 1000).otherwise(1)).cast("int")
    every = F.transform(F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda n: n.cast("double") * F.when(value.rlike("(?i)k|千"), 1000).otherwise(1))
    text = F.struct(F.get(every, F.lit(0)).cast("int").alias("low"), F.get(every, F.lit(1)).cast("int").alias("high"), F.lit(None).cast("int").alias("months"))
    own = F.struct(
        number(nested(["minValue", "min", "minimum", "salaryMin"])).alias("low"), number(nested(["maxValue", "max", "maximum", "salaryMax"])).alias("high"),
        F.coalesce(F.get_json_object(value, "$.months"), F.get_json_object(value, "$.salaryMonths")).try_cast("int").alias("months"),
    )
    return F.when(F.trim(value).startswith("{"), own).otherwise(text)


def decrypted(data: Column, key: Column, iv: Column) -> Column:
    """The text of base64 data under AES in CBC mode with padding; null if it doesn't fit."""
    return F.try_aes_decrypt(F.concat(iv.cast("binary"), F.unbase64(data)), key.cast("binary"), F.lit("CBC"), F.lit("PKCS")).cast("string")


def enriched(jobs: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Jobs with what their detail says in place of the list's values, where it says anything."""
    d = details.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = jobs.join(d, F.col(key) == F.col("__key"), "left")
    said = {c: F.when(F.trim(F.col(f"__{c}").cast("string")) != "", F.col(f"__{c}")) for c in columns}
    return joined.select(*[F.coalesce(said[c], F.col(c)).alias(c) if c in said else F.col(c) for c in jobs.columns])


def of_element(element_id: str) -> Callable[[str], Iterator[str]]:
    """The decoded value of the first element with that id, as attribute_json reads it."""
    tag = re.compile(rf"""(?is)<[a-z]+\b[^>]*\bid=["']{element_id}["'][^>]*>""")
    value = re.compile(r"""(?is)\bvalue=("[^"]+"|'[^']+')""")

    def found(page: str) -> Iterator[str]:
        whole = tag.search(page)
        own = value.search(whole[0]) if whole else None
        if own:
            yield html.unescape(own[1][1:-1])

    return found


#: How each kind of page is read: what finds the embedded texts of a page of a link's kind.
READERS: dict[str, Callable[[str], Iterator[str]]] = {
    "NEXT": pushed,
    "ZHAOPIN": after("__INITIAL_DATA__"),
    "PHENOM": after("phApp.ddo"),
    "MOKA": of_element("init-data"),
}


def read_by_kind(pages: DataFrame, id_col: str, html_col: str, kind_col: str) -> DataFrame:
    """id, ordinal and text of what pages embed, each read by the reader of its kind in one pass.

    Pages of other kinds, of none and without html yield nothing.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, v) for i, k, page in zip(f[id_col], f["__kind"], f["__page"]) for n, v in enumerate(READERS[k](page))]
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "value"])

    kind = pages.schema[id_col].dataType.simpleString()
    known = pages.where(F.col(kind_col).isin(list(READERS)) & F.col(html_col).isNotNull())
    return known.select(F.col(id_col), F.col(kind_col).alias("__kind"), F.col(html_col).cast("string").alias("__page")).mapInPandas(
        each, f"{id_col} {kind}, ordinal int, value string"
    )
