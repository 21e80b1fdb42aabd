"""Canonical values of catalogue facts: cities, natures, recruitment types, education, tags, groups.

All take text columns; null, and words that mean nothing, give null (arrays: empty).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, collapsed, distinct_ignoring_case, mapped, nfkc, only_category
from .titles import parts, unbracketed

# Wordings and what they stand for.
UNKNOWN = ["", "-", "--", "/", "不详", "未知", "待定"]
ANYWHERE = ["不限", "城市不限", "地点不限", "工作地点不限"]
REMOTE = ["remote", "workfromhome", "线上", "在线", "居家办公", "远程", "远程办公"]
NATIONWIDE = ["全国", "全国各地", "全国多地", "全国范围"]
NATURES = {
    "央国企": ["央国企"],
    "央企": ["央企", "中央企业", "中央国有企业"],
    "国企": ["国企", "国有企业", "地方国企", "地方国有企业"],
    "事业单位": ["事业单位"],
    "政府/公共机构": ["政府/公共机构", "政府公共机构", "政府机构", "公共机构"],
    "民营企业": ["民营企业", "民营", "民企", "私企", "私营企业"],
    "外资企业": ["外资企业", "外企", "外商独资", "外商独资企业"],
    "合资企业": ["合资企业", "合资"],
    "其他": ["其他", "其它"],
}
TYPES = {"校招": "校招|校园|应届|春招|秋招|提前批|补招", "社招": "社招|社会招聘", "实习": "实习"}
NO_EDUCATION = ["不限", "无要求", "不要求"]
NO_EDUCATION_PARTS = "学历不限|学历无要求|学历不要求|无学历要求|不限学历"
EDUCATION = {
    "高中及以下": "高中|中专|中职|技校|初中|小学",
    "专科": "专科|大专",
    "本科": "本科|学士",
    "硕士": "硕士",
    "博士": "博士",
}
PLACE_MARKS, BATCH_MARKS = r"[,，、;/；|]+", r"[,，、;/；|\n\r]+"


def _key(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def display(text: Column) -> Column:
    """Compatibility form with single spaces; blank text is null."""
    return _present(collapsed(nfkc(text)))


def _city(part: Column) -> Column:
    key, shown = _key(part), collapsed(part)
    return (
        F.when(key.isin(UNKNOWN + ANYWHERE), None)
        .when(F.lower(key).isin(REMOTE), "远程")
        .when(key.isin(NATIONWIDE), "全国")
        .when((F.length(key) > 1) & key.endswith("市"), F.regexp_replace(key, "市$", ""))
        .otherwise(shown)
    )


def city(text: Column) -> Column:
    return _city(nfkc(text))


def locations(text: Column) -> Column:
    """Distinct cities of a delimited list, in order."""
    parts = F.split(F.coalesce(nfkc(text), F.lit("")), PLACE_MARKS)
    return distinct_ignoring_case(F.array_compact(F.transform(parts, _city)))


def tags(text: Column, marks: str = BATCH_MARKS) -> Column:
    """Distinct tags of a delimited list, in order."""
    parts = F.transform(F.split(F.coalesce(nfkc(text), F.lit("")), marks), collapsed)
    return distinct_ignoring_case(F.filter(parts, lambda p: p != ""))


def company_nature(text: Column) -> Column:
    return mapped(nfkc(text), {alias: name for name, aliases in NATURES.items() for alias in aliases}, keep_unknown=False)


def shown_nature(original: Column, canonical: Column) -> Column:
    """The source's own wording if it was kept, else the canonical one."""
    return F.coalesce(display(original), display(canonical))


def recruitment_type(text: Column) -> Column:
    """The one type that the text names; null if it names none or several."""
    return only_category(_key(nfkc(text)), TYPES)


def education(text: Column) -> Column:
    """The lowest level that the text names; null where it asks for none."""
    key = _key(nfkc(text))
    asked = ~key.isin(UNKNOWN + NO_EDUCATION) & ~key.rlike(NO_EDUCATION_PARTS)
    found = reduce(lambda out, e: out.when(asked & key.rlike(e[1]), e[0]), EDUCATION.items(), F.when(key.isNull(), None))
    return found.otherwise(None)


def company_group(name: Column, group: Column) -> Column:
    """company:<known group>, else name:<name>, both as comparison keys."""
    key = lambda c: _present(F.lower(_key(nfkc(c))))
    return F.coalesce(F.concat(F.lit("company:"), key(group)), F.concat(F.lit("name:"), F.coalesce(key(name), F.lit("unknown"))))


def labelled_lines(parts: dict[str, Column]) -> Column:
    """A line `label: text` for each part that isn't blank; arrays are comma-joined by the caller."""
    lines = []
    for label, text in parts.items():
        shown = _present(collapsed(text))
        lines.append(F.concat(F.lit(f"{label}: "), shown))
    return F.concat_ws("\n", *lines)


def distinct_lines(*parts: Column) -> Column:
    """Distinct non-blank parts in order, one a line."""
    shown = F.transform(F.array(*parts), collapsed)
    return F.concat_ws("\n", F.array_distinct(F.filter(shown, lambda p: p.isNotNull() & (p != ""))))


def first_tokens(text: Column, n: int) -> Column:
    """The text up to its n-th token (a Han character, a word, or another mark)."""
    token = r"(?:[一-鿿]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_一-鿿])"
    return F.regexp_extract(text, rf"^((?:\s*+{token}){{0,{n}}}+)", 1)


def title_list(text: Column) -> Column:
    """Distinct parts of a delimited list; marks within brackets don't part it."""
    return F.array_distinct(F.transform(parts(text), collapsed))


def bare_title(title: Column) -> Column:
    """The title without a bracket at its end or a numeral at its start."""
    return F.trim(unbracketed(F.regexp_replace(title, r"^[\d一二三四五六七八九十]+[.)、]\s*", "")))


def fallback_id(record: Column, title: Column) -> Column:
    """A stable id of a title of a record: table-fallback:<record>:<digest>."""
    digest = F.left(F.sha2(F.lower(_key(title)), 256), F.lit(16))
    return F.concat_ws(":", F.lit("table-fallback"), record, digest)
