"""Records out of JSON envelopes and HTML pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def envelope(payloads: DataFrame, body: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of a JSON list envelope, with `ordinal` and the named paths as text.

    A body that isn't JSON, or has no list at the path, gives no rows.
    """
    items = F.try_variant_get(F.try_parse_json(F.col(body)), items_path, "array<variant>")
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.posexplode(items).alias("ordinal", "__item"))
    texts = [F.try_variant_get("__item", path, "string").alias(name) for name, path in fields.items()]
    return rows.select(*keep, "ordinal", *texts)


def first_of(*columns: Column) -> Column:
    """First candidate that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def json_ld(pages: DataFrame, id_col: str, html_col: str, kind: str = "JobPosting") -> DataFrame:
    """id, ordinal and JSON text of every object of a schema.org type that pages embed."""

    def found(value: object) -> Iterator[dict]:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, list):
                stack += reversed(v)
            elif isinstance(v, dict):
                if v.get("@type") == kind or isinstance(v.get("@type"), list) and kind in v["@type"]:
                    yield v
                stack += reversed(list(v.values()))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, html in zip(f[id_col], f[html_col]):
                n = 0
                for text in _LD.findall(html or ""):
                    try:
                        value = json.loads(text)
                    except ValueError:
                        continue
                    for one in found(value):
                        rows.append((i, n, json.dumps(one, ensure_ascii=False)))
                        n += 1
            yield pd.DataFrame(rows, columns=[id_col, "ordinal", "item"])

    kind_of = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(each, f"{id_col} {kind_of}, ordinal int, item string")


def page_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, ordinal and href of every anchor."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)
    return pages.select(id_col, F.posexplode(hrefs).alias("ordinal", "href"))


def page_errors(pages: DataFrame, source: str, page: str, item: str, total: str) -> DataFrame:
    """Sources whose paged items are incomplete: a null or repeated id, or fewer than stated."""
    out = pages.groupBy(source).agg(
        F.count_if(F.col(item).isNull()).alias("missing_ids"),
        (F.count(item) - F.count_distinct(item)).alias("repeated_ids"),
        F.count_distinct(page).alias("pages"),
        (F.max(total) - F.count_distinct(item)).alias("short_by"),
    )
    return out.where("missing_ids > 0 or repeated_ids > 0 or short_by > 0")
