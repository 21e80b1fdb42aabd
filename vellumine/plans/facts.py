"""Queries over canonical facts, link kinds and event histories, with DuckDB SQL for them.

The tables have no Chinese wordings, so rows pick theirs from a list by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import link_types
from ..functions import normalize as nm
from ..operators import history, sites

PLACES = ["上海市 ", "Remote", "全国多地", "不限", "北京", "市", "居家办公"]
CITIES = ["上海", "远程", "全国", None, "北京", "市", "远程"]
NATURES = {"民企": "民营企业", "中央 企业": "央企", "外商独资": "外资企业", "其它": "其他", "合伙": None}
TYPES = {"2027 校园招聘": "校招", "社会招聘": "社招", "暑期实习": "实习", "校招/实习": None, "不限": None, "秋招提前批": "校招"}
LEVELS = {"本科及以上": "本科", "硕士研究生": "硕士", "大专/本科": "专科", "学历不限": None, "博士": "博士", "研究生": None, "中专": "高中及以下"}
LINKS = {
    "https://app.mokahr.com/": "MOKA", "http://x.zhiye.com:8080/": "BEISEN", "https://a.jobs.feishu.cn/": "FEISHU",
    "https://notzhiye.com/": "UNKNOWN", "https://mp.weixin.qq.com/s/": "WECHAT", "https://10.0.0.1/job/": "UNKNOWN",
    "https://rsj.x.gov.cn/": "GOVERNMENT_NOTICE", "https://t.cn/": "FORM_OR_SHORT", "https://form.x.com/": "FORM_OR_SHORT",
    "https://career.x.com/": "COMPANY_RECRUITMENT_SITE", "https://www.x.com/": "COMPANY_WEBSITE", "mailto:a@b.cn?": "EMAIL",
    "https://www.x.com/?url=https%3A%2F%2Fjobs.51job.com%2F": "JOB_51", "to a.b@c.com ": "EMAIL", "https://x.gxrc.com/": "PUBLIC_RECRUITMENT_PORTAL",
    "https://campus.boe.com/": "BEISEN", "https://x.recruitee.com/": "CUSTOM_RECRUITMENT_SYSTEM",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: list[str], key: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _pick_sql(values: list[str | None], key: str) -> str:
    quoted = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{quoted}][{key} % {len(values)} + 1]"


def q52_canonical_facts(spark: SparkSession, d: str) -> DataFrame:
    k = "p_partkey"
    return _t(spark, d, "part").select(
        k, nm.city(_pick(PLACES, k)).alias("city"), nm.company_nature(_pick(list(NATURES), k)).alias("nature"),
        nm.recruitment_type(_pick(list(TYPES), k)).alias("type"), nm.education(_pick(list(LEVELS), k)).alias("level"),
        F.array_join(nm.locations(F.concat(_pick(PLACES, k), F.lit("；北京、"), "p_brand")), "|").alias("places"),
        nm.company_group(F.col("p_name"), F.when(F.col(k) % 3 == 0, F.col("p_brand"))).alias("company_group"),
    )


def q53_link_types(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(_pick(list(LINKS), "page_id"), F.col("page_id").cast("string"))
    return _t(spark, d, "pages").select(
        "page_id", link_types.link_type(link).alias("link_type"), link_types.link_type(F.col("url")).alias("own_type")
    )


def q54_versions(spark: SparkSession, d: str) -> DataFrame:
    saves = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return history.versioned(saves, "o_custkey", ["o_orderkey"], ["status"])


def q55_replays(spark: SparkSession, d: str) -> DataFrame:
    requests = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return history.replays(requests, "o_custkey", "o_orderpriority", ["o_orderkey"])


def q56_saved_bridge(spark: SparkSession, d: str) -> DataFrame:
    return history.bridged(_t(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"], "purchase", "error")


def q57_feedback_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    given = F.when(kind == "click", F.col("event_id"))
    return history.settled(_t(spark, d, "events"), ["user_id"], "ts", kind == "error", given, ["ts", "event_id"])


def q58_refund_errors(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return history.refund_errors(_t(spark, d, "orders"), "o_custkey", status == "O", status == "P")


def q59_completion_errors(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "orders")
    found = history.completion_errors(runs, "o_custkey", "o_orderpriority", F.col("o_orderstatus") != "P", "o_orderstatus", 12)
    return found.withColumn("reasons", F.array_join("reasons", "|"))


def q60_title_rows(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(", x)；"), "p_name")
    rows = _t(spark, d, "part").select("p_partkey", F.explode(nm.title_list(text)).alias("title"))
    record = F.concat(F.lit("row:"), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", "title", nm.bare_title(F.col("title")).alias("bare"), nm.fallback_id(record, F.col("title")).alias("source_job_id"))


def q61_first_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token budget of an embedding model is the feature here."""
    return _t(spark, d, "documents").select("doc_id", nm.first_tokens(F.col("text"), 200).alias("head"))


def q62_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    parts = {"title": F.col("p_name"), "brand": F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), "kind": F.lower("p_type")}
    lines = nm.distinct_lines(F.col("p_brand"), F.col("p_type"), F.col("p_brand"), F.lit(" "))
    return _t(spark, d, "part").select("p_partkey", nm.labelled_lines(parts).alias("text"), lines.alias("query_text"))


def q63_named_sources(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    old = _t(spark, d, "supplier").select(key.alias("k"), F.when(key % 3 == 0, key.cast("string")).otherwise(F.col("s_name")).alias("name"))
    new = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return history.renamed_if_unnamed(old, new, "k", "name")


#: ordinal, profile, domain and alias of companies (here of invented ones).
PROFILES = [(2, "net", "example.net", "a"), (1, "org", "example.org", "e"), (3, "any", "net", ""), (0, "pills", "example.com", "pills")]


def q64_company_profiles(spark: SparkSession, d: str) -> DataFrame:
    profiles = spark.createDataFrame(PROFILES, "ordinal int, profile string, domain string, alias string")
    name = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    pages = _t(spark, d, "pages").select("page_id", "url", name.alias("name"))
    return sites.company_profiles(pages, "page_id", "url", "name", F.broadcast(profiles))


def q65_shared_hosts(spark: SparkSession, d: str) -> DataFrame:
    return sites.shared_hosts(_t(spark, d, "pages"), "url", F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1))


def q66_source_names(spark: SparkSession, d: str) -> DataFrame:
    platform = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    default = F.concat(F.lit("source "), F.col("o_custkey").cast("string"))
    return sites.source_names(_t(spark, d, "orders"), "o_custkey", platform, default)


_CAREER = "|".join(link_types.CAREER_MARKS)

ORACLES = {
    "q52_canonical_facts": f"""
WITH facts AS (SELECT *, {_pick_sql(CITIES, "p_partkey")} AS city FROM part)
SELECT p_partkey, city, {_pick_sql(list(NATURES.values()), "p_partkey")} AS nature, {_pick_sql(list(TYPES.values()), "p_partkey")} AS type,
       {_pick_sql(list(LEVELS.values()), "p_partkey")} AS level,
       concat_ws('|', CASE WHEN city <> '北京' THEN city END, '北京', p_brand) AS places,
       CASE WHEN p_partkey % 3 = 0 THEN 'company:' || lower(replace(p_brand, ' ', '')) ELSE 'name:' || lower(replace(p_name, ' ', '')) END AS company_group
FROM facts""",
    "q53_link_types": f"""
SELECT page_id, {_pick_sql(list(LINKS.values()), "page_id")} AS link_type,
  CASE WHEN regexp_matches(regexp_extract(url, '^https?://([^?#]*)', 1), '/(form|forms|survey|questionnaire)(/|$)') THEN 'FORM_OR_SHORT'
       WHEN regexp_matches(lower(regexp_extract(url, '^https?://([^?#]*)', 1)), '{_CAREER}') THEN 'COMPANY_RECRUITMENT_SITE'
       WHEN regexp_matches(url, '^https?://www[.]') THEN 'COMPANY_WEBSITE' ELSE 'UNKNOWN' END AS own_type
FROM pages""",
    "q54_versions": """
WITH s AS (
  SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS status, row_number() OVER w AS n, lag(nullif(o_orderstatus, 'P')) OVER w AS before
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
)
SELECT o_custkey, o_orderkey, status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS version
FROM s WHERE n = 1 OR status IS DISTINCT FROM before""",
    "q55_replays": """
SELECT o_orderkey, o_custkey, o_orderpriority,
  CASE WHEN o_orderkey = min(o_orderkey) OVER w THEN 'FIRST' WHEN o_orderpriority = first_value(o_orderpriority) OVER v THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome
FROM orders WINDOW w AS (PARTITION BY o_custkey), v AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "q56_saved_bridge": """
SELECT user_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error')
) WHERE n = 1 AND event_type = 'purchase'""",
    "q57_feedback_state": """
SELECT user_id, min(ts) FILTER (WHERE event_type = 'error') AS deleted_at,
       arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'click') AS feedback
FROM events GROUP BY user_id""",
    "q58_refund_errors": """
SELECT *, CASE WHEN debits = 0 THEN 'UNMATCHED' ELSE 'REPEATED' END AS problem FROM (
  SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS debits, count(*) FILTER (WHERE o_orderstatus = 'P') AS refunds
  FROM orders GROUP BY o_custkey
) WHERE refunds > 1 OR debits = 0 AND refunds > 0""",
    "q59_completion_errors": """
SELECT o_custkey, n, reasons FROM (
  SELECT o_custkey, count(*) AS n, concat_ws('|', CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'OWNERS' END,
    CASE WHEN count(DISTINCT o_orderpriority) < count(*) THEN 'REPEATED' END, CASE WHEN count(*) > 12 THEN 'TOO_MANY' END,
    CASE WHEN bool_or(o_orderstatus = 'P') THEN 'UNMATCHED' END) AS reasons
  FROM orders GROUP BY o_custkey
) WHERE reasons <> ''""",
    "q60_title_rows": """
WITH t AS (SELECT p_partkey, unnest([p_type || ' (' || p_brand || ', x)', p_name]) AS title FROM part)
SELECT p_partkey, title, regexp_replace(title, ' [(].*', '') AS bare,
       'table-fallback:row:' || p_partkey || ':' || left(sha256(lower(replace(title, ' ', ''))), 16) AS source_job_id
FROM t""",
    "q61_first_tokens": r"""
SELECT doc_id, regexp_extract(text, '^((?:\s*(?:[\x{4E00}-\x{9FFF}]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_\x{4E00}-\x{9FFF}])){0,200})', 1) AS head
FROM documents""",
    "q62_embedding_text": """
SELECT p_partkey, concat_ws(chr(10), 'title: ' || p_name, CASE WHEN p_partkey % 4 <> 0 THEN 'brand: ' || p_brand END, 'kind: ' || lower(p_type)) AS text,
       p_brand || chr(10) || p_type AS query_text
FROM part""",
    "q64_company_profiles": """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages)
SELECT * FROM (
  SELECT page_id, CASE WHEN regexp_matches(host, '(^|[.])example[.]com$') AND contains(host, 'pills') THEN 'pills'
                       WHEN regexp_matches(host, '(^|[.])example[.]org$') AND contains(host, 'e') THEN 'org'
                       WHEN regexp_matches(host, '(^|[.])example[.]net$') AND contains(host, 'a') THEN 'net'
                       WHEN regexp_matches(host, '(^|[.])net$') THEN 'any' END AS profile
  FROM h
) WHERE profile IS NOT NULL""",
    "q65_shared_hosts": """
SELECT host, count(*) AS n, count(DISTINCT path) AS paths, min(path) AS first_path, max(path) AS last_path
FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
GROUP BY host HAVING count(DISTINCT path) > 1""",
    "q66_source_names": """
SELECT o_custkey, CASE WHEN count(DISTINCT p) = 1 THEN min(p) ELSE 'source ' || o_custkey END AS name
FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS p FROM orders) GROUP BY o_custkey""",
    "q63_named_sources": """
SELECT coalesce(s_suppkey, c_custkey) AS k,
       CASE WHEN s_suppkey IS NULL THEN c_name WHEN s_suppkey % 3 = 0 THEN coalesce(c_name, s_suppkey::VARCHAR) ELSE s_name END AS name
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""",
}

QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
