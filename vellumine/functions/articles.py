"""Texts of pages, articles and requests: html as lines, links in cells, ways to apply, small normal forms."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .link_types import EMAIL, link_type
from .text import collapsed, nfkc, normal_url

# Wordings of recruitment texts.
APPLY_MARKS = "投递 报名 申请 网申 应聘 简历 招聘链接 报名链接 投递方式 报名方式".split()
QR_MARKS = "二维码 扫码 扫描 长按识别 识别二维码".split()
CONTACT_MARKS = "微信号 加微信 添加微信 联系微信 微信联系".split()
JOB_LIST_MARKS = "招聘岗位 岗位需求 招聘职位 职位需求".split()
MANY_JOBS_MARKS = "岗位一览 职位列表 招聘岗位如下".split()
TITLE_MARKS = "招聘 招募 岗位".split()
RECRUITMENT_MARKS = "招聘 招募 职位 岗位 校招 社招 实习 recruit career position vacancy".split()
EDUCATION_MARKS = "学历 教育背景 专科 大专 本科 学士 硕士 研究生 博士".split()
SOCIAL_MARKS, CAMPUS_MARKS = "社会招聘 社会招募 社招".split(), "校园招聘 校园 校招 秋招 春招".split()
LINK_END = "，,；;。！？!?)]}"
BLOCK_TAGS = "br dd div dt h1 h2 h3 h4 h5 h6 li p section td th tr".split()
ROUTE = r"(?i)/(?:m/)?(campus-recruitment|social-recruitment|campus_apply|apply|recommendation-apply)/([^/?#]+)/(\d+)(?:/|$)"
#: What html.unescape takes as a reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
MS_DATE = r"^/Date\((\d+)(?:[+-]\d+)?\)/$"

_EMPTY = "array<string>"


def has_any(text: Column, marks: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(marks)), F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def unescaped_each(texts: pd.Series) -> pd.Series:
    """The texts of an array with their character references decoded."""
    return texts.map(lambda a: a if a is None else [html.unescape(t) if t and "&" in t else t for t in a])


def unescaped(text: Column) -> Column:
    """Character references decoded; Spark has no built-in for it.

    Only the distinct references of a text go to Python, whatever its length.
    """
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    known = F.map_from_arrays(names, unescaped_each(names))

    def decoded(p: Column) -> Column:
        found = F.concat(F.regexp_extract_all(p["text"], F.lit(REFERENCE), F.lit(0)), F.array(F.lit("")))
        parts = F.zip_with(F.split(p["text"], REFERENCE, -1), found, lambda part, name: F.concat(part, F.coalesce(F.try_element_at(p["known"], name), F.lit(""))))
        return F.when(F.size(p["known"]) == 0, p["text"]).otherwise(F.array_join(parts, ""))

    each = F.transform(F.array(F.struct(text.alias("text"), known.alias("known"))), decoded)
    return F.get(each, F.lit(0))


def _blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))  # the text is computed once, by `when` twice


def tag_lines(page: Column) -> Column:
    """Text of html with a line end for every tag; zero-width spaces out, blank lines out; null if nothing is left."""
    text = F.replace(unescaped(F.regexp_replace(page, "<[^>]+>", "\n")), F.lit("​"), F.lit(""))
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)\n\s*", "\n")
    return _blank_to_null(F.regexp_replace(lines, r"(?U)^\s+|\s+$", ""))


def block_lines(page: Column) -> Column:
    """Text of html, escaped once more or not: a line for each block element, other tags out; null if nothing is left."""
    text = F.regexp_replace(unescaped(page), r"(?is)<(script|style)\b.*?</\1>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    return embedding_lines(F.regexp_replace(text, "<[^>]*>", ""))


def embedding_lines(text: Column) -> Column:
    """Lines with single spaces, blank ones out; null if nothing is left."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), collapsed)
    return _blank_to_null(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def cell_links(text: Column, target: Column) -> Column:
    """Distinct links of a cell's text and of the target behind it, in order.

    http, https and mailto links, several joined by commas or not, and addresses that no link
    holds; a cell that has none of them and no target is taken as a link itself.
    """

    def found(source: Column) -> Column:
        text_ = F.coalesce(source, F.lit(""))
        webs = F.regexp_extract_all(text_, F.lit(r"""((?i)(?:https?://|mailto:)[^\s<>"']+)"""), 1)
        webs = F.flatten(F.transform(webs, lambda w: F.split(w, r"[,，;；]\s*(?=(?:https?://|mailto:))")))
        emails = F.regexp_extract_all(text_, F.lit(f"({EMAIL})"), 1)
        joined = F.array_join(webs, " ")
        return F.concat(webs, F.filter(emails, lambda e: ~F.contains(joined, e)))

    own = found(text)
    bare = F.when((F.size(own) == 0) & (F.trim(text) != "") & target.isNull(), F.array(F.trim(text)))
    every = F.concat(F.coalesce(bare, own), found(target))
    ends = "".join("\\" + c if c in ")]}?!" else c for c in LINK_END)
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.regexp_replace(x, f"[{ends}]+$", "")), lambda x: x != ""))


def canonical_email(text: Column) -> Column:
    """Comparison form of an address; null if it is none or longer than 254 characters."""
    t = F.lower(F.trim(nfkc(text)))
    return F.when(t.rlike(f"^{EMAIL}$") & (F.length(t) <= 254), t)


def joined_requests(standing: Column, single: Column) -> Column:
    """A standing request and one for this time, a blank line between; null if both are blank."""
    return _blank_to_null(F.concat_ws("\n\n", _blank_to_null(F.trim(standing)), _blank_to_null(F.trim(single))))


def is_education_gap(text: Column) -> Column:
    return has_any(text, EDUCATION_MARKS)


def route_identity(url: Column) -> Column:
    """mode/organisation/site of a career page's path, whatever its query; null if it has no such route."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = [F.lower(F.regexp_extract(path, ROUTE, 1)), F.regexp_extract(path, ROUTE, 2), F.regexp_extract(path, ROUTE, 3)]
    return F.when(path.rlike(ROUTE), F.concat_ws("/", *parts))


def flat_text(json: Column, depth: int = 3) -> Column:
    """Text of a JSON value: strings and numbers as they are, objects by text, name or value, lists comma-joined.

    Of values nested deeper than `depth` nothing is taken; null, true and false are empty.
    """
    t = F.trim(F.coalesce(json, F.lit("")))
    if depth == 0:
        return F.when(t.rlike(r"^[\[{]") | t.isin("null", "true", "false"), "").otherwise(t)
    first = F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ("text", "name", "value")], F.lit(""))
    items = F.transform(F.from_json(t, _EMPTY), lambda x: flat_text(x, depth - 1))
    listed = F.array_join(F.filter(items, lambda x: x != ""), ", ")
    plain = F.when(t.rlike('^".*"$'), F.trim(F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"))).otherwise(t)
    inner = flat_text(first, depth - 1) if depth > 1 else first
    return F.when(t.startswith("["), listed).when(t.startswith("{"), inner).when(t.isin("null", "true", "false"), "").otherwise(plain)


def ms_date(text: Column) -> Column:
    """The time of `/Date(milliseconds)/`; null for anything else and from the year 2200 on."""
    at = F.timestamp_millis(F.regexp_extract(text, MS_DATE, 1).try_cast("bigint"))
    return F.when(text.rlike(MS_DATE) & (F.year(at) < 2200), at)


def iso_or_epoch(text: Column) -> Column:
    """A number as seconds (milliseconds from 10^10 on), else a date or time in ISO form; null if neither."""
    n = text.try_cast("bigint")
    number = F.when(n >= 10_000_000_000, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n))
    return F.coalesce(number, text.try_cast("timestamp"))


def type_by_precedence(text: Column, path: Column) -> Column:
    """Internship before social before campus recruitment; the page's path tells where the text doesn't."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(F.contains(text, F.lit("实习")) | F.contains(p, F.lit("intern")), "实习")
        .when(has_any(text, SOCIAL_MARKS), "社招")
        .when(has_any(text, CAMPUS_MARKS) | p.rlike("campus|graduates"), "校招")
    )


def page_id(own: Column, url: Column, title: Column) -> Column:
    """A record's own id, else page-<digest of url and title>."""
    made = F.concat(F.lit("page-"), F.left(F.sha1(F.concat_ws("\n", url, title)), F.lit(16)))
    return F.coalesce(_blank_to_null(F.trim(own)), made)


def announcement_id(url: Column, title: Column, body: Column) -> Column:
    """Id of a page that speaks of recruitment but holds no job; null if it doesn't, or has no title."""
    said = F.lower(F.concat_ws("\n", title, body))
    found = has_any(said, RECRUITMENT_MARKS) & (F.trim(title) != "")
    plain_url = F.regexp_replace(url, "#.*$", "")
    return F.when(found, F.concat(F.lit("announcement:"), F.left(F.sha2(plain_url, 256), F.lit(20))))


def review_of_missing(description: Column) -> Column:
    """The review reasons of a record without a description, else null."""
    return F.when(F.trim(F.coalesce(description, F.lit(""))) == "", F.array(F.lit("job description unavailable")))


def content_shape(title: Column, content: Column, blocks: Column) -> Column:
    """multi_job_candidate, structured_announcement (three blocks or more) or announcement."""
    marks = F.regexp_count(F.coalesce(content, F.lit("")), F.lit("|".join(JOB_LIST_MARKS)))
    many = (marks >= 2) | has_any(content, MANY_JOBS_MARKS)
    structured = (blocks >= 3) & has_any(title, TITLE_MARKS)
    return F.when(many, "multi_job_candidate").when(structured, "structured_announcement").otherwise("announcement")


def application_methods(url: Column, content: Column, hrefs: Column, images: Column) -> Column:
    """Distinct ways to apply: structs of type, value, source, confidence.

    Links of anchors and of the text that lead elsewhere, addresses, a code to scan where there
    are images, a contact, or `unknown` where the text asks to apply and names no way.
    """
    asks = has_any(content, APPLY_MARKS)
    sure = F.when(asks, "high").otherwise("medium")

    def one(kind: str, value: Column, source: str, confidence: Column | str) -> Column:
        level = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit(source).alias("source"), level.alias("confidence"))

    empty = F.array().cast("array<struct<type:string,value:string,source:string,confidence:string>>")
    there = lambda x: F.coalesce(x, F.array().cast(_EMPTY))
    mails = F.filter(F.transform(there(hrefs), lambda h: F.regexp_extract(h, r"(?i)^mailto:([^?]*)", 1)), lambda m: m.rlike(f"^{EMAIL}$"))
    away = lambda u: u.rlike("(?i)^https?://") & (F.regexp_replace(u, "#.*$", "") != F.regexp_replace(url, "#.*$", ""))
    webs = F.filter(there(hrefs), lambda h: away(h) & (link_type(h) != "WECHAT"))
    in_text = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"""((?i)https?://[^\s<>"'，；。）]+)"""), 1)
    said = F.filter(in_text, lambda u: away(u) & (link_type(u) != "WECHAT") & ~F.array_contains(webs, u))
    written = F.filter(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(f"({EMAIL})"), 1), lambda e: ~F.array_contains(mails, e))
    listed = F.concat(
        F.transform(mails, lambda m: one("email", m, "anchor", "high")), F.transform(webs, lambda u: one("url", u, "anchor", sure)),
        F.transform(said, lambda u: one("url", u, "text", sure)), F.transform(written, lambda e: one("email", e, "text", "high")),
        F.when(has_any(content, QR_MARKS) & (images > 0), F.array(one("qr_candidate", F.lit(None), "image", "medium"))).otherwise(empty),
        F.when(has_any(content, CONTACT_MARKS), F.array(one("wechat_contact", F.lit(None), "text", "low"))).otherwise(empty),
    )
    unknown = F.when(asks, F.array(one("unknown", F.lit(None), "text", "low"))).otherwise(empty)
    return F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(unknown)


def application_status(methods: Column) -> Column:
    """One word for the ways to apply that there are."""
    kinds = F.array_distinct(F.transform(methods, lambda m: m["type"]))
    names = {"url": "direct_url", "email": "email", "qr_candidate": "qr", "wechat_contact": "wechat_contact"}
    only = F.get(kinds, F.lit(0))
    out = F.when(F.size(kinds) == 0, "not_found").when(F.size(kinds) > 1, "mixed")
    for kind, name in names.items():
        out = out.when(only == kind, name)
    return out.otherwise("unknown")


def review_reasons(shape: Column, methods: Column) -> Column:
    """Why someone should look at an article."""
    has = lambda kind: F.exists(methods, lambda m: m["type"] == kind)
    reasons = {
        "multi_job_candidate": shape == "multi_job_candidate", "no_application_method": F.size(methods) == 0,
        "multiple_application_methods": F.size(methods) > 1, "qr_requires_decode": has("qr_candidate"),
        "unresolved_application_method": has("unknown"),
        "low_confidence_application_method": F.exists(methods, lambda m: m["confidence"] != "high"),
    }
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in reasons.items()]))


def same_page(a: Column, b: Column) -> Column:
    return normal_url(a) == normal_url(b)
