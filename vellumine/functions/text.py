"""Text columns: normal forms, terms, previews, links, salaries, dates."""

from __future__ import annotations

import unicodedata
from functools import reduce
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the Unicode sense (also U+3000 and U+00A0).
SPACES = r"(?U)\s+"
_TERM = r"([一-鿿]{2,}|[a-z0-9+#.]{2,})"


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no built-in for it. Use on distinct values."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def compact(text: Column) -> Column:
    """Comparison key: lower case without any white space."""
    return F.lower(F.regexp_replace(text, SPACES, ""))


def blank_to_null(text: Column, *marks: str) -> Column:
    """Trimmed text; null if empty or one of `marks` (cells that mean nothing)."""
    t = F.trim(text)
    return F.when(t.isin("", *marks), None).otherwise(t)


def terms(text: Column) -> Column:
    """Distinct lower-case terms (runs of Han or latin characters, two or more) in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERM), 1))


def hit_score(haystack: Column, wanted: Column) -> Column:
    """Share of the wanted terms that the text contains, 0 if none are wanted."""
    text = F.lower(F.coalesce(haystack, F.lit("")))
    hits = F.size(F.filter(wanted, lambda t: F.contains(text, t)))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(0.0))


def haystack(*columns: Column) -> Column:
    """Lower-case text of all columns (arrays flattened, nulls left out), space-joined."""
    return F.lower(F.concat_ws(" ", *columns))


def preview(text: Column, limit: int) -> Column:
    """Collapsed text; beyond `limit` characters it ends in an ellipsis."""
    t = collapsed(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def split_tags(text: Column, pattern: str = r"[,，;；、/|\s]+") -> Column:
    """Distinct non-empty parts in order; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def distinct_ignoring_case(values: Column) -> Column:
    """Values without those whose lower-case form came before; the first spelling stays."""
    # no lambda names the column itself, so it may come from a Python function
    seen = lambda out, v: F.exists(out, lambda o: F.lower(o) == F.lower(v))
    empty = F.array().cast("array<string>")
    return F.aggregate(values, empty, lambda out, v: F.when(seen(out, v), out).otherwise(F.array_append(out, v)))


def mapped(text: Column, aliases: dict[str, str], keep_unknown: bool = True) -> Column:
    """Canonical value by compact alias; unknown values stay (trimmed) or become null."""
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in ("".join(k.lower().split()), v)])
    found = F.element_at(table, compact(text))
    return F.coalesce(found, blank_to_null(text)) if keep_unknown else found


def only_category(text: Column, categories: dict[str, str]) -> Column:
    """The category whose pattern the text matches, if exactly one does; else null."""
    flags = {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in categories.items()}
    count = reduce(lambda a, b: a + b, (f.cast("int") for f in flags.values()))
    return F.when(count == 1, F.coalesce(*[F.when(f, name) for name, f in flags.items()]))


def level(text: Column, levels: dict[str, int], lowest: bool = False) -> Column:
    """Highest (or lowest) level whose keyword the text contains; null if none."""
    found = [F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in levels.items()]
    return (F.least if lowest else F.greatest)(*found)


def parsed_date(text: Column, *formats: str) -> Column:
    """First format that fits, as a timestamp; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or ("yyyy-MM-dd", "yyyy/MM/dd")])


def epoch_timestamp(number: Column) -> Column:
    """Seconds, or milliseconds from 10^10 on, as a timestamp."""
    n = number.cast("long")
    return F.when(n.isNull(), None).when(n >= 10_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def years(text: Column, suffix: str = "届") -> Column:
    """All four-digit years before the suffix, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(\d{{4}}){suffix}"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def salary_range(text: Column) -> Column:
    """struct(low, high, months) of wordings such as `15-25K·14薪`, `1.5-2万` or `8千-1.5万`; else nulls.

    A number without a unit of its own has that of the other.
    """
    t = F.upper(F.coalesce(text, F.lit("")))
    pair = r"(\d+(?:\.\d+)?)\s*(K|千|万)?\s*[-~至]\s*(\d+(?:\.\d+)?)\s*(K|千|万)?"
    got = lambda k: F.regexp_extract(t, pair, k)
    factor = lambda u: F.when(u == "万", 10_000).when(u.isin("K", "千"), 1_000)
    of = lambda own, other: F.coalesce(factor(got(own)), factor(got(other)), F.lit(1))
    amount = lambda k, own, other: F.round(got(k).try_cast("double") * of(own, other)).cast("int")
    months = F.regexp_extract(t, r"(\d{2})\s*薪", 1).try_cast("int")
    return F.struct(amount(1, 2, 4).alias("low"), amount(3, 4, 2).alias("high"), months.alias("months"))


def links(text: Column) -> Column:
    """Distinct http(s) links in order, closing punctuation taken off."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s\"'<>，。；、）)]+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?\]}]+$", "")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+"), F.lit(False))


@F.pandas_udf(StringType())
def normal_url(url: pd.Series) -> pd.Series:
    """Lower scheme and host, no default port or fragment, sorted query, no closing slash."""

    def one(u: str | None) -> str | None:
        if u is None:
            return None
        try:
            p = urlsplit(u.strip())
            host, port = (p.hostname or "").lower(), p.port
        except ValueError:
            return u.strip()
        default = {"http": 80, "https": 443}.get(p.scheme.lower())
        place = host if port in (None, default) else f"{host}:{port}"
        query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
        return f"{p.scheme.lower()}://{place}{p.path.rstrip('/')}" + (f"?{query}" if query else "")

    return url.map(one)


def classified_link(url: Column, rules: list[tuple[str, Column]], other: str = "unknown") -> Column:
    """Name of the first rule that holds; a rule that is null doesn't."""
    out = F.when(url.isNull(), F.lit("missing"))
    for name, holds in rules:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(other))


def on_domain(url: Column, domain: str) -> Column:
    """Whether the host is the domain or one below it."""
    host = url_host(url)
    return (host == domain) | host.endswith(f".{domain}")


def html_text(html: Column) -> Column:
    """Text of html: scripts, styles and tags out, white space collapsed."""
    no_scripts = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_scripts, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))
