"""Queries over term postings, facet bitmaps, nested JSON and row numbers; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_values as js
from ..functions.text import haystack
from ..operators.facet_bitmaps import Choice, FacetBitmaps
from ..operators.term_index import TermIndex
from ..sources.scan_order import numbered
from ..storage import scratch_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q107_term_postings(spark: SparkSession, d: str) -> DataFrame:
    """The rows of q03 with their scores, by postings."""
    text = haystack(F.col("p_name"), F.col("p_type"))
    index = TermIndex.build(_t(spark, d, "part"), "p_partkey", text, scratch_path(spark, "terms"))
    found = index.search(["red", "ring", "small", "economy", "z"])
    return found.select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


def q108_term_best(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best of q16 with their scores, by postings over the whole texts."""
    index = TermIndex.build(_t(spark, d, "documents"), "doc_id", haystack(F.col("text")), scratch_path(spark, "terms"))
    found = index.best(["the", "and", "queau", "und"], 50).rows
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


CHOICE = Choice(any_of={"brand": ["Brand#11", "Brand#12", "Brand#23", "Brand#7"], "size": [*map(str, range(5, 40))]}, only={"word": ["red", "widget", "small"]})


def _bitmaps(spark: SparkSession, d: str) -> FacetBitmaps:
    facets = {
        "brand": F.col("p_brand"), "size": F.nullif(F.col("p_size"), F.lit(7)), "type": F.col("p_type"),
        "word": F.when(F.col("p_partkey") % 10 > 0, F.split("p_name", " ")),
    }
    return FacetBitmaps.build(_t(spark, d, "part"), facets, scratch_path(spark, "facets"))


def q109_bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values of each facet with their rows, under the choices of the other facets."""
    return _bitmaps(spark, d).counts(CHOICE, ["brand", "size", "type", "word"])


def q110_bitmap_rows(spark: SparkSession, d: str) -> DataFrame:
    return _bitmaps(spark, d).select(CHOICE).select("p_partkey", "p_brand", "p_name")


def q111_bitmap_totals(spark: SparkSession, d: str) -> DataFrame:
    return _bitmaps(spark, d).totals(CHOICE)


def _object(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def q112_record_digest(spark: SparkSession, d: str) -> DataFrame:
    """Events as nested records whose keys and spaces differ from row to row."""
    id_, kind, props = F.col("event_id").cast("string"), F.col("event_type"), F.col("props")
    one = _object('{"id": ', id_, ', "of":[{"type":"', kind, '" ,"props":', props, '}, null], "b":true}')
    other = _object('{"b":true,"of":[ {"props": ', props, ',"type":"', kind, '"},null],"id":', id_, "}")
    record = F.when(F.col("event_id") % 2 == 0, one).otherwise(other)
    return _t(spark, d, "events").select("event_id", js.digest(record).alias("digest"))


def q113_nested_merge(spark: SparkSession, d: str) -> DataFrame:
    """Facts of customers merged with later ones; what was there before normalisation is merged within."""
    k = F.col("c_custkey")
    key = k.cast("string")
    original = F.when(k % 3 == 0, _object(',"original":{"nature":"', F.col("c_mktsegment"), '","old":', key, "}")).otherwise("")
    old = _object('{"name":"', F.col("c_name"), '","n":1', original, "}")
    new = F.when(k % 2 == 0, _object('{"n":2,"original":{"city":', key, ',"old":null}}')).when(k % 5 == 0, '{"m":[]}')
    rows = _t(spark, d, "customer")
    return rows.select("c_custkey", js.merged_objects(old, new, ["original"]).alias("merged"))


def q114_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return numbered(_t(spark, d, "orders")).select("o_orderkey", "row_number")


_FACTS = """
WITH f AS (
  SELECT p_partkey, p_brand, p_name, p_type, nullif(p_size, 7) AS size, CASE WHEN p_partkey % 10 > 0 THEN list_distinct(string_split(p_name, ' ')) END AS words FROM part
), c AS (
  SELECT *, coalesce(p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#7'), true) AS brand_ok, coalesce(size BETWEEN 5 AND 39, true) AS size_ok,
         coalesce(list_has_any(words, ['red', 'widget', 'small']), false) AS word_ok FROM f
)"""

ORACLES = {
    "q107_term_postings": """
SELECT p_partkey, round(n / 5.0::DOUBLE, 6) AS score FROM (
  SELECT p_partkey, len(list_filter(['red', 'ring', 'small', 'economy', 'z'], lambda t: contains(lower(p_name || ' ' || p_type), t))) AS n FROM part
) WHERE n > 0""",
    "q108_term_best": """
SELECT doc_id, round(n / 4.0::DOUBLE, 6) AS score FROM (
  SELECT doc_id, len(list_filter(['the', 'and', 'queau', 'und'], lambda t: contains(lower(text), t))) AS n FROM documents
) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 50""",
    "q109_bitmap_counts": f"""{_FACTS}
SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM c WHERE size_ok AND word_ok GROUP BY p_brand
UNION ALL SELECT 'size', size::VARCHAR, count(*) FROM c WHERE brand_ok AND word_ok GROUP BY size
UNION ALL SELECT 'type', p_type, count(*) FROM c WHERE brand_ok AND size_ok AND word_ok GROUP BY p_type
UNION ALL SELECT 'word', w, count(*) FROM (SELECT unnest(coalesce(words, [NULL])) AS w FROM c WHERE brand_ok AND size_ok) GROUP BY w""",
    "q110_bitmap_rows": f"{_FACTS} SELECT p_partkey, p_brand, p_name FROM c WHERE brand_ok AND size_ok AND word_ok",
    "q111_bitmap_totals": f"{_FACTS} SELECT count(*) FILTER (WHERE brand_ok AND size_ok AND word_ok) AS total, count(*) AS pool_total FROM c",
    "q112_record_digest": """
SELECT event_id, sha256('{"b":true,"id":' || event_id || ',"of":[{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"},null]}') AS digest FROM events""",
    "q113_nested_merge": """
SELECT c_custkey, '{' || CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 5 = 0 THEN '"m":[],' ELSE '' END || '"n":' || CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END
  || ',"name":"' || c_name || '"' || CASE
    WHEN c_custkey % 6 = 0 THEN ',"original":{"city":' || c_custkey || ',"nature":"' || c_mktsegment || '","old":null}'
    WHEN c_custkey % 2 = 0 THEN ',"original":{"city":' || c_custkey || ',"old":null}'
    WHEN c_custkey % 3 = 0 THEN ',"original":{"nature":"' || c_mktsegment || '","old":' || c_custkey || '}' ELSE '' END || '}' AS merged
FROM customer""",
    "q114_row_numbers": "SELECT o_orderkey, row_number() OVER () AS row_number FROM orders",
}

QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:4].isdigit()}
