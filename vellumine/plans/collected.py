"""Queries over collected records: lists, keys, merges, gates, titles, pages and their payloads, with DuckDB SQL.

Payloads, cells and articles are made of the tables' own columns, a row each.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import articles as ar
from ..functions import titles as ti
from ..functions.normalize import shown_nature
from ..functions.vectors import is_vector
from ..operators import facets, identity, listing, matching, merging, quality, reconcile
from ..sources import payloads, records


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


K, NAME, BRAND = F.col, "p_name", "p_brand"


def q67_relevance_page(spark: SparkSession, d: str) -> DataFrame:
    q = facets.FacetQuery(search=(["p_name", "p_type"], ["red", "ring", "small", "economy"]))
    order = [F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")]
    return facets.by_relevance(_t(spark, d, "part"), q, order, 1, 30).select("p_partkey", F.round("score", 6).alias("score"))


def q68_group_page(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]
    return listing.group_page(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderpriority", order, 2, 20)


def q69_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a request, one of them unknown, are the feature here."""
    return listing.by_ids(_t(spark, d, "part"), "p_partkey", [57, 3, 10**9, 12, 3], ["p_partkey", "p_name"])


def q70_saved_list(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").where("event_type = 'purchase'")
    saved = events.groupBy("user_id", (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("p_partkey")).agg(F.max("ts").alias("saved_at"))
    parts = _t(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("s_suppkey"))
    suppliers = _t(spark, d, "supplier").select("s_suppkey", "s_name")
    return listing.saved_list(saved, parts, suppliers, "p_partkey", "s_suppkey", ["p_name", "s_name"])


def q71_run_page(spark: SparkSession, d: str) -> DataFrame:
    runs = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return listing.run_page(runs, "o_orderdate", "o_orderkey", 1, 25)


def q72_gap_page(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    gaps = quality.gaps(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey", "o_orderkey", 3, order)
    return quality.gap_page(gaps, ["o_orderpriority", "o_orderstatus"], 1, 10)


def q73_quality_gate_of_all(spark: SparkSession, d: str) -> DataFrame:
    problems = {"cheap": F.col("o_totalprice") < 1500, "TYPE_CONFLICT": F.col("o_orderpriority") == "1-URGENT"}
    stale = F.col("o_orderdate") < F.lit(datetime(1999, 1, 1))
    expected = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return quality.gate(_t(spark, d, "orders"), ["o_custkey"], problems, stale, ["TYPE_CONFLICT"], expected)


def title_cells() -> Column:
    k = F.col("p_partkey") % 8
    return (
        F.when(k == 0, _cat(F.col(BRAND), "工程师；", F.col(BRAND), "(华北;华南)经理、", F.col(BRAND), "工程师"))
        .when(k == 1, _cat("岗位：", F.col(BRAND), "开发;测试;运维经理"))
        .when(k == 2, _cat(F.col(NAME), ",产品经理"))
        .when(k == 3, _cat("详见", F.col(NAME)))
        .when(k == 4, _cat("1. ", F.col(BRAND), "工程师 ", F.col(BRAND), "专员"))
        .when(k == 5, "招聘岗位")
        .when(k == 6, F.col(BRAND))
    )


def q74_safe_titles(spark: SparkSession, d: str) -> DataFrame:
    """Cells with marks in brackets, labels, two languages, prose, words in a row; the company is the brand."""
    titles = ti.safe_titles(title_cells(), F.col(BRAND))
    rows = _t(spark, d, "part").select("p_partkey", F.posexplode(titles).alias("ordinal", "title"))
    return rows.select("p_partkey", "ordinal", "title", ti.unbracketed(F.col("title")).alias("bare"))


def q75_title_checks(spark: SparkSession, d: str) -> DataFrame:
    cell = title_cells()
    return _t(spark, d, "part").select(
        "p_partkey", ti.is_generic(cell, F.col(BRAND)).alias("generic"), F.coalesce(ti.is_role(cell), F.lit(False)).alias("role"),
        F.coalesce(ti.is_too_long(F.repeat(cell, 9)), F.lit(False)).alias("long"), F.size(ti.candidates(cell)).alias("n"),
    )


def q76_scoped_keys(spark: SparkSession, d: str) -> DataFrame:
    """By id (a wide form of it), by link, or by facts; scoped by platform, else by source."""
    k = F.col("p_partkey")
    scope = identity.scope([F.when(k % 2 == 0, F.concat(F.lit(" Ｐ "), F.col(BRAND)))], [F.lit("https://jobs.x.com/")], F.lit("src"), F.lit("company:a"))
    own, url = F.when(k % 3 == 0, _cat(" Ａ|", k)), F.when(k % 3 == 1, _cat("HTTPS://Ex.com:443/", k, "/?b=2&a=1#x"))
    key = identity.scoped_key(scope, own, url, [identity.plain(F.col(NAME)), F.when(k % 5 != 0, F.col("p_type"))])
    return _t(spark, d, "part").select("p_partkey", scope.alias("scope"), key.alias("identity_key"), identity.job_id(key).alias("job_id"))


def q77_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Provenance in the metadata doesn't count, separators in values do."""
    k = F.col("doc_id")
    metadata = F.when(k % 4 != 0, F.create_map(F.lit("lang"), F.col("lang"), F.lit("batch"), k.cast("string"), F.lit("a"), F.lit("x,y")))
    found = identity.content_hash([F.col("source"), F.when(k % 7 != 0, F.col("lang"))], metadata)
    return _t(spark, d, "documents").select("doc_id", found.alias("content_hash"))


def q78_merge_of_two_states(spark: SparkSession, d: str) -> DataFrame:
    """Customers' states by their orders and then by urgent ones: null keys, reopened rows, provenance, stale vectors."""
    orders = _t(spark, d, "orders")

    def state(rows: DataFrame, marked: Column) -> DataFrame:
        out = rows.groupBy("o_custkey").agg(F.count("*").cast("string").alias("content"), F.min("o_orderpriority").alias("nature"), F.max("o_clerk" if "o_clerk" in rows.columns else "o_orderstatus").alias("origin"))
        out = out.withColumns({"status": F.when(marked, "CLOSED").otherwise("OPEN"), "vector": F.concat(F.lit("v"), F.col("content"))})
        return out.unionByName(out.agg(F.lit(None).cast("bigint").alias("o_custkey"), F.lit("null key").alias("content"), F.lit(None).cast("string").alias("nature"), F.lit("o").alias("origin"), F.lit("OPEN").alias("status"), F.lit("v").alias("vector")))

    old = state(orders, F.col("nature") == "1-URGENT")
    new = state(orders.where("o_orderpriority < '4' or o_totalprice < 100000"), F.lit(False))
    new = new.withColumn("nature", F.when(F.col("nature") != "1-URGENT", F.col("nature")))
    out = merging.merge(old, new, "o_custkey", "content", ["nature"], ["origin"], "status", ["vector"])
    return out.select("o_custkey", "content", "nature", "status", "vector", "merge_action")


def q79_duplicate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("url", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return reconcile.verdicts(rows, "o_custkey", "o_orderstatus", "url", "o_orderpriority")


def q80_merged_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return reconcile.merged(rows, "o_custkey", "o_orderkey", [merging.completeness(F.col("priority"))], ["o_orderdate"], [], ["priority"], "status")


def q81_reference_conflicts(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("h", F.md5("text"))
    winners = merging.memberships(docs, "h", "doc_id", [F.lit(0)])
    return reconcile.reference_conflicts(_t(spark, d, "labels"), winners, "doc_id", ["quality", "toxic"])


def q82_cell_links(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    text = F.when(i % 3 == 0, _cat("apply ", F.col("url"), "，mailto:hr", i, "@x.com。 or a.", i, "@y.org!")).when(i % 3 == 1, _cat(" row ", i, " "))
    links = ar.cell_links(text, F.when(i % 3 == 2, F.col("url")))
    return _t(spark, d, "pages").select("page_id", F.posexplode(links).alias("ordinal", "link"))


def q83_page_lines(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("html")
    return _t(spark, d, "pages").select("page_id", F.md5(ar.tag_lines(page)).alias("lines"), F.length(ar.block_lines(page)).cast("bigint").alias("block_chars"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per part, of one of four kinds, with its key and name inside."""
    k, name = F.col("p_partkey"), F.col(NAME)
    value = F.to_json(F.struct(k.alias("id"), name.alias("t"), F.array(F.lit("]}'\"")).alias("odd")))
    quoted = F.to_json(F.struct(F.concat(F.lit("5:"), value).alias("v")))
    push = F.concat(F.lit("<script>self.__next_f.push([1, "), F.substring(quoted, 6, 1 << 20), F.lit("</script>"))
    push = F.regexp_replace(push, r"\}</script>$", "])</script>")
    escaped = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    page = (
        F.when(k % 5 == 0, push)
        .when(k % 5 == 1, _cat("<script>window.__INITIAL_DATA__ = ", value, ";</script>"))
        .when(k % 5 == 2, _cat("<script>phApp.ddo = ", value, "; var x = [1}</script>"))
        .when(k % 5 == 3, _cat('<input type="hidden" id="init-data" value="', escaped, '">'))
        .otherwise("<p>no data</p>")
    )
    kind = F.element_at(F.array(*map(F.lit, ["NEXT", "ZHAOPIN", "PHENOM", "MOKA", "FORM"])), (k % 5 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", kind.alias("kind"), page.alias("html"))


def q84_embedded_data(spark: SparkSession, d: str) -> DataFrame:
    found = payloads.read_by_kind(_pages(spark, d), "p_partkey", "html", "kind")
    return found.select("p_partkey", F.get_json_object("value", "$.id").cast("bigint").alias("id"), F.get_json_object("value", "$.t").alias("t"))


def q85_linked_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The pages' own anchors and addresses; paths in the menu become those of jobs, some twice a page."""
    html = F.regexp_replace(F.regexp_replace("html", 'href="/', 'href="/job/'), "</a>", " engineer</a>")
    html = F.when(F.col("page_id") % 5 != 0, html).otherwise(F.concat(F.col("html"), html, html))
    return payloads.linked_jobs(_t(spark, d, "pages").select("page_id", "url", html.alias("html")), "page_id", "url", "html")


def q86_cards(spark: SparkSession, d: str) -> DataFrame:
    page = _cat('<a class="box-title" onclick="viewInfo(&quot;n', F.col("p_partkey"), '&quot;)"><i>', F.col(NAME), '</i></a><a class="other" onclick="viewInfo(&quot;x&quot;)">y</a>')
    pages = _t(spark, d, "part").select("p_partkey", page.alias("html"))
    return payloads.cards(pages, "p_partkey", "html", "box-title", "viewInfo")


def q87_articles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    content = F.when(k % 3 == 0, _cat("请投递 hr", k, "@x.com 或扫码")).when(k % 3 == 1, _cat("招聘岗位 ", F.col(NAME), " 招聘岗位 报名"))
    hrefs = F.when(k % 3 == 2, F.array(_cat("https://h.com/", k), F.lit("javascript:x"), F.lit("mailto:a@b.cn?s"), F.lit("https://a.com/#me")))
    methods = ar.application_methods(F.lit("https://a.com/"), content, hrefs, F.when(k % 2 == 0, 1).otherwise(0))
    shape = ar.content_shape(F.lit("招聘"), content, F.when(k % 4 == 0, 3).otherwise(1))
    rows = _t(spark, d, "part").select("p_partkey", shape.alias("shape"), methods.alias("m"))  # found once, then described
    shown = F.transform("m", lambda m: F.concat_ws(":", m["type"], m["value"], m["confidence"]))
    return rows.select(
        "p_partkey", "shape", ar.application_status(F.col("m")).alias("status"), F.array_join(shown, "|").alias("methods"),
        F.array_join(ar.review_reasons(F.col("shape"), F.col("m")), "|").alias("reasons"),
    )


def q88_small_forms(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    odd = k % 2 == 1
    return _t(spark, d, "part").select(
        "p_partkey", ar.canonical_email(_cat(" Ｈr", k, "@X.com ")).alias("email"), ar.embedding_lines(_cat(" a  b\r\n\n ", F.col(BRAND), " ")).alias("lines"),
        ar.joined_requests(F.when(odd, F.col(BRAND)), F.lit(" x ")).alias("request"), ar.is_education_gap(F.when(odd, F.lit("缺少学历"))).alias("gap"),
        ar.route_identity(_cat("https://m.com/Apply/org/", k, "/?t=", F.col(BRAND))).alias("route"), ar.ms_date(_cat("/Date(", k * 86400000, "+0800)/")).cast("timestamp_ntz").alias("at"),
        ar.type_by_precedence(F.when(odd, F.lit("校招 社招")), _cat("/campus/", k)).alias("type"), ar.page_id(F.when(odd, _cat(" ", k)), F.col(BRAND), F.col(NAME)).alias("page_id"),
        ar.flat_text(_cat('[{"text":" ', F.col(BRAND), '"},', k, ',null,["a",{"name":"b"}]]')).alias("flat"),
        F.substring(ar.announcement_id(_cat("https://a.com/", k, "#x"), F.lit("t"), F.when(odd, F.lit("Careers"))), 1, 20).alias("announcement"),
        F.size(F.coalesce(ar.review_of_missing(F.when(odd, F.col(NAME))), F.array())).alias("to_review"), identity.source_entry_id(F.col(BRAND), _cat("https://a.com/", k)).alias("entry"),
    )


def q89_salaries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, _cat('{"value":{"minValue":', k, ',"maxValue":', k + 5, '},"months":13}')).when(k % 3 == 1, _cat(k, "K-", k + 2, "k"))
    s = payloads.salary_of(value)
    return _t(spark, d, "part").select("p_partkey", s["low"].alias("low"), s["high"].alias("high"), s["months"].alias("months"))


def q90_decrypted(spark: SparkSession, d: str) -> DataFrame:
    key, iv = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    cipher = F.aes_encrypt(F.col(NAME), key, F.lit("CBC"), F.lit("PKCS"), iv.cast("binary"))
    data = F.base64(F.substring(cipher, 17, 1 << 20))
    return _t(spark, d, "part").select("p_partkey", payloads.decrypted(data, key, iv).alias("name"), payloads.decrypted(F.col(NAME), key, iv).alias("bad"))


def q91_enriched(spark: SparkSession, d: str) -> DataFrame:
    jobs = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    details = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_nationkey") > 12, F.col("s_name")).otherwise(" ").alias("name"))
    return payloads.enriched(jobs, details, "k", ["name"])


def q92_backfill_errors(spark: SparkSession, d: str) -> DataFrame:
    labels = _t(spark, d, "labels").select("doc_id", (F.col("doc_id") * 7).alias("other"))
    docs = _t(spark, d, "documents").where("lang = 'en'")
    found = listing.backfill_errors(labels, {"doc_id": (docs, "doc_id"), "other": (docs, "doc_id")})
    return found.withColumn("reasons", F.array_join("reasons", "|"))


def q93_as_of(spark: SparkSession, d: str) -> DataFrame:
    snapshots = _t(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    asked = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("id")).distinct()
    return listing.as_of(snapshots, asked, ["owner", "id"])


def q94_failures_of_rows(spark: SparkSession, d: str) -> DataFrame:
    failures = _t(spark, d, "events").where("event_type = 'error'").select("event_id", F.col("user_id").alias("row_number"))
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_number"), F.col("c_name").alias("record"))
    return listing.attributed(failures, rows, "row_number", "record")


def q95_evaluator_input(spark: SparkSession, d: str) -> DataFrame:
    job = {"title": F.col(NAME), "size": F.col("p_size")}
    made = listing.evaluator_input(job, {"brand": F.col(BRAND)}, F.array(F.when(F.col("p_size") > 9, "SIZE").otherwise("NONE")))
    done = listing.progress(F.col("p_size"), F.nullif(F.lit(50), F.col("p_size")))
    return listing.detail_view(_t(spark, d, "part").select("p_partkey", made.alias("input"), done.alias("percent"), F.lit(1).alias("internal")), ["internal"])


def q96_assembled(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings").where(is_vector(F.col("embedding"), 64))
    query = [((i * 7) % 11 - 5) / 5 for i in range(64)]
    near = matching.nearest(vectors, "vec_id", "embedding", query, 40).withColumnRenamed("vec_id", "doc_id")
    asked = _t(spark, d, "documents").select("doc_id", (F.col("lang") != "fr").alias("matched"))
    items = _t(spark, d, "documents").select("doc_id", "source", shown_nature(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("source")).alias("nature"))
    return matching.assembled(near, asked, items, "doc_id", 10).select("doc_id", "position", "source", "nature", F.round("score", 5).alias("score"))


def q97_page_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as paged items of their customer, who states the number of the first five digits of the key."""
    rows = _t(spark, d, "orders").withColumn("total", F.lit(9)).withColumn("item", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")))
    return records.page_errors(rows, "o_custkey", "o_orderdate", "item", "total")


def q98_batch_conflicts(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    found = merging.conflicts(orders, "o_custkey", "o_orderstatus")
    tokens = merging.union_ignoring_order(F.array(F.lit("b"), F.lit("a")), F.when(F.col("n") > 2, F.array(F.lit("c"), F.lit("a"))))
    return found.select("o_custkey", "n", F.array_join(tokens, ",").alias("tokens"), records.first_of(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")).alias("first"))


TITLES = """CASE p_partkey % 8 WHEN 0 THEN [p_brand || '工程师', p_brand || '(华北;华南)经理'] WHEN 1 THEN [p_brand || '开发', '测试', '运维经理']
    WHEN 2 THEN [p_name || ',产品经理'] WHEN 4 THEN [p_brand || '工程师', p_brand || '专员'] ELSE []::VARCHAR[] END"""

ORACLES = {
    "q67_relevance_page": """
SELECT p_partkey, round(n / 4.0::DOUBLE, 6) AS score FROM (
  SELECT p_partkey, p_retailprice, len(list_filter(['red', 'ring', 'small', 'economy'], lambda t: contains(lower(p_name || ' ' || p_type), t))) AS n FROM part
) WHERE n > 0 ORDER BY n DESC, p_retailprice DESC NULLS LAST, p_partkey LIMIT 30""",
    "q68_group_page": """
SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest, list(o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)[1:3] AS titles
FROM orders GROUP BY o_custkey ORDER BY newest DESC, o_custkey LIMIT 20 OFFSET 20""",
    "q69_multi_get": """
SELECT position::INT AS position, p_partkey, p_name FROM (SELECT unnest([57, 3, 1000000000, 12, 3]) AS id, generate_subscripts([57, 3, 1000000000, 12, 3], 1) - 1 AS position)
JOIN part ON id = p_partkey""",
    "q70_saved_list": """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, p_partkey)::INT AS position, p_partkey, p_name, s_name
FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT + 1 AS k, max(ts) AS saved_at FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
JOIN part ON k = p_partkey LEFT JOIN supplier ON p_size = s_suppkey""",
    "q71_run_page": """
SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""",
    "q72_gap_page": """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_who, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3] AS samples
FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""",
    "q73_quality_gate_of_all": """
SELECT o_custkey, n, CASE WHEN n = 0 THEN ['PARSER_EMPTY'] WHEN stale THEN ['STALE_PUBLISHED_AT'] ELSE list_filter([CASE WHEN urgent THEN 'TYPE_CONFLICT' END, CASE WHEN cheap THEN 'cheap' END], lambda x: x IS NOT NULL) END AS reasons,
  CASE WHEN n = 0 THEN 'FALLBACK' WHEN stale THEN 'SKIP' WHEN cheap THEN 'FALLBACK' ELSE 'ACCEPT' END AS decision FROM (
  SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, bool_and(o_orderdate < TIMESTAMP '1999-01-01') AS stale, bool_or(o_totalprice < 1500) AS cheap, bool_or(o_orderpriority = '1-URGENT') AS urgent
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""",
    "q74_safe_titles": f"""
SELECT p_partkey, ordinal::INT AS ordinal, title, regexp_replace(title, '[(][^()]*[)]$', '') AS bare FROM (
  SELECT p_partkey, unnest(t) AS title, generate_subscripts(t, 1) - 1 AS ordinal FROM (SELECT p_partkey, {TITLES} AS t FROM part))""",
    "q75_title_checks": """
SELECT p_partkey, k IN (5, 6, 7) AS generic, k IN (0, 1, 2, 4, 5) AS role, coalesce(l * 9 > 80, false) AS long, [3, 3, 1, 1, 2, 1, 1, 0][k + 1]::INT AS n FROM (
  SELECT p_partkey, (p_partkey % 8)::INT AS k, CASE p_partkey % 8 WHEN 0 THEN 3 * length(p_brand) + 18 WHEN 1 THEN length(p_brand) + 13 WHEN 2 THEN length(p_name) + 5
    WHEN 3 THEN length(p_name) + 2 WHEN 4 THEN 2 * length(p_brand) + 9 WHEN 5 THEN 4 WHEN 6 THEN length(p_brand) END AS l FROM part)""",
    "q76_scoped_keys": """
WITH s AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'p ' || lower(p_brand) ELSE 'src' END || ':company:a' AS scope FROM part),
k AS (SELECT p_partkey, scope, sha256(CASE p_partkey % 3 WHEN 0 THEN to_json(['id', scope, 'A|' || p_partkey]) WHEN 1 THEN to_json(['url', scope, 'https://ex.com/' || p_partkey || '?a=1&b=2'])
  ELSE to_json(['facts', scope, lower(p_name), CASE WHEN p_partkey % 5 <> 0 THEN p_type END]) END::VARCHAR) AS identity_key FROM s)
SELECT *, 'job-' || left(identity_key, 24) AS job_id FROM k""",
    "q77_content_hash": """
SELECT doc_id, sha256(to_json([source, CASE WHEN doc_id % 7 <> 0 THEN lang END,
  CASE WHEN doc_id % 4 <> 0 THEN '[{"key":"a","value":"x,y"},{"key":"lang","value":"' || lang || '"}]' ELSE '[]' END])::VARCHAR) AS content_hash
FROM documents""",
    "q78_merge_of_two_states": """
WITH o AS (SELECT o_custkey, count(*)::VARCHAR AS content, min(o_orderpriority) AS nature, max(o_orderstatus) AS origin FROM orders GROUP BY 1),
n AS (SELECT o_custkey, count(*)::VARCHAR AS content, nullif(min(o_orderpriority), '1-URGENT') AS nature, max(o_orderstatus) AS origin FROM orders WHERE o_orderpriority < '4' OR o_totalprice < 100000 GROUP BY 1)
SELECT o.o_custkey, coalesce(n.content, o.content) AS content, coalesce(n.nature, o.nature) AS nature,
  CASE WHEN n.o_custkey IS NULL AND o.nature = '1-URGENT' THEN 'CLOSED' ELSE 'OPEN' END AS status,
  CASE WHEN n.o_custkey IS NULL OR n.content = o.content THEN 'v' || o.content END AS vector,
  CASE WHEN n.o_custkey IS NULL THEN 'KEPT' WHEN n.content = o.content AND n.origin = o.origin AND o.nature <> '1-URGENT' THEN 'UNCHANGED' ELSE 'UPDATED' END AS merge_action
FROM o LEFT JOIN n ON o.o_custkey = n.o_custkey
UNION ALL SELECT NULL, 'null key', NULL, 'OPEN', 'v', 'KEPT' UNION ALL SELECT NULL, 'null key', NULL, 'OPEN', NULL, 'CREATED'""",
    "q79_duplicate_verdicts": """
SELECT o_custkey, n, verdict, verdict IN ('SAME_ID', 'SAME_URL', 'SAME_FACTS') AS mergeable FROM (
  SELECT o_custkey, n, CASE WHEN ids = 1 AND (urls <= 1 OR facts = 1) THEN 'SAME_ID' WHEN ids = 1 THEN 'ID_CONFLICT' WHEN urls = 1 THEN 'SAME_URL' WHEN facts = 1 THEN 'SAME_FACTS' ELSE 'FACT_CONFLICT' END AS verdict
  FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS ids, count(DISTINCT nullif(o_orderpriority, '5-LOW')) AS urls, count(DISTINCT o_orderpriority) AS facts FROM orders GROUP BY 1) WHERE n > 1)""",
    "q80_merged_groups": """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, nullif(o_orderpriority, '1-URGENT') AS priority, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE o_orderstatus END AS status FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority IS NULL, o_orderkey) AS k, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first, bool_or(status = 'OPEN') OVER (PARTITION BY o_custkey) AS opened FROM r)
SELECT o_orderkey, o_custkey, first AS o_orderdate, priority, CASE WHEN opened THEN 'OPEN' ELSE status END AS status FROM w WHERE k = 1""",
    "q81_reference_conflicts": """
WITH g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS winner, count(*) OVER (PARTITION BY text) AS n FROM documents),
m AS (SELECT winner, quality, toxic FROM labels JOIN g USING (doc_id) WHERE n > 1),
e AS (SELECT winner, 'quality' AS owner, quality::VARCHAR AS v FROM m UNION ALL SELECT winner, 'toxic', toxic::VARCHAR FROM m)
SELECT winner, owner, count(*) AS clashes FROM (SELECT winner, owner, v FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2""",
    "q82_cell_links": """
SELECT page_id, ordinal::INT AS ordinal, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS ordinal FROM (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN [url, 'mailto:hr' || page_id || '@x.com', 'a.' || page_id || '@y.org'] WHEN 1 THEN ['row ' || page_id] ELSE [url] END AS l FROM pages))""",
    "q83_page_lines": r"""
WITH t AS (SELECT page_id, html, regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM pages),
b AS (SELECT page_id, x, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS u FROM t),
c AS (SELECT page_id, x, regexp_replace(regexp_replace(regexp_replace(u, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'),
  '(?i)</?(br|dd|div|dt|h1|h2|h3|h4|h5|h6|li|p|section|td|th|tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS y FROM b)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n\s*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS lines,
  length(array_to_string(list_filter(list_transform(string_split(y, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)))::BIGINT AS block_chars
FROM c""",
    "q84_embedded_data": "SELECT p_partkey, p_partkey AS id, p_name AS t FROM part WHERE p_partkey % 5 <> 4",
    "q85_linked_jobs": """
WITH a AS (
  SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS origin, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>') AS x FROM pages
), b AS (
  SELECT page_id, origin, unnest(x) AS tag, generate_subscripts(x, 1) - 1 + CASE WHEN page_id % 5 = 0 THEN len(x) ELSE 0 END AS ordinal FROM a
), c AS (
  SELECT page_id, ordinal::INT AS ordinal, origin, trim(regexp_replace(regexp_extract(tag, '>([^<]*)<', 1), '\\s+', ' ', 'g') || ' engineer') AS title,
    '/job' || regexp_extract(tag, 'href="([^"]*)"', 1) AS path FROM b WHERE tag LIKE '%href="/%'
)
SELECT page_id, ordinal, title, origin || path AS detail_url, regexp_extract(path, '([^/]+)/*$', 1) AS source_job_id
FROM c QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY ordinal) = 1""",
    "q86_cards": "SELECT p_partkey, 0 AS ordinal, p_name AS title, 'n' || p_partkey AS source_job_id FROM part",
    "q87_articles": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'multi_job_candidate' WHEN p_partkey % 4 = 0 THEN 'structured_announcement' ELSE 'announcement' END AS shape,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'mixed' ELSE 'email' END WHEN 1 THEN 'unknown' ELSE 'mixed' END AS status,
  CASE p_partkey % 3 WHEN 0 THEN 'email:hr' || p_partkey || '@x.com:high' || CASE WHEN p_partkey % 2 = 0 THEN '|qr_candidate:medium' ELSE '' END
    WHEN 1 THEN 'unknown:low' ELSE 'email:a@b.cn:high|url:https://h.com/' || p_partkey || ':medium' END AS methods,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'multiple_application_methods|qr_requires_decode|low_confidence_application_method' ELSE '' END
    WHEN 1 THEN 'multi_job_candidate|unresolved_application_method|low_confidence_application_method' ELSE 'multiple_application_methods|low_confidence_application_method' END AS reasons
FROM part""",
    "q88_small_forms": """
SELECT p_partkey, 'hr' || p_partkey || '@x.com' AS email, 'a b' || chr(10) || p_brand AS lines, CASE WHEN odd THEN p_brand || chr(10) || chr(10) || 'x' ELSE 'x' END AS request,
  odd AS gap, 'apply/org/' || p_partkey AS route, CASE WHEN year(make_timestamp(p_partkey * 86400000000)) < 2200 THEN make_timestamp(p_partkey * 86400000000) END AS at, CASE WHEN odd THEN '社招' ELSE '校招' END AS type,
  CASE WHEN odd THEN p_partkey::VARCHAR ELSE 'page-' || left(sha1(p_brand || chr(10) || p_name), 16) END AS page_id, p_brand || ', ' || p_partkey || ', a, b' AS flat,
  CASE WHEN odd THEN left('announcement:' || sha256('https://a.com/' || p_partkey), 20) END AS announcement, CASE WHEN odd THEN 0 ELSE 1 END AS to_review,
  'entry-' || left(sha256(lower(p_brand) || chr(10) || 'https://a.com/' || p_partkey), 20) AS entry
FROM (SELECT *, p_partkey % 2 = 1 AS odd FROM part)""",
    "q89_salaries": """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey * 1000 END::INT AS low, CASE p_partkey % 3 WHEN 0 THEN p_partkey + 5 WHEN 1 THEN (p_partkey + 2) * 1000 END::INT AS high,
  CASE WHEN p_partkey % 3 = 0 THEN 13 END::INT AS months FROM part""",
    "q90_decrypted": "SELECT p_partkey, p_name AS name, NULL::VARCHAR AS bad FROM part",
    "q91_enriched": """
SELECT c_custkey AS k, CASE WHEN s_nationkey > 12 THEN s_name ELSE c_name END AS name, c_mktsegment AS kind FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "q92_backfill_errors": """
WITH e AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT * FROM (SELECT doc_id, doc_id * 7 AS other, concat_ws('|', CASE WHEN doc_id NOT IN (SELECT doc_id FROM e) THEN 'doc_id' END, CASE WHEN doc_id * 7 NOT IN (SELECT doc_id FROM e) THEN 'other' END) AS reasons FROM labels)
WHERE reasons <> ''""",
    "q93_as_of": """
SELECT DISTINCT l_suppkey AS owner, l_orderkey AS id, o_orderstatus FROM lineitem LEFT JOIN orders ON o_custkey = l_suppkey AND o_orderkey = l_orderkey""",
    "q94_failures_of_rows": """
SELECT user_id AS row_number, event_id, c_name AS record FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'error'""",
    "q95_evaluator_input": """
SELECT p_partkey, '{"job":{"title":"' || p_name || '","size":' || p_size || '},"profile":{"brand":"' || p_brand || '"},"checks":["' || CASE WHEN p_size > 9 THEN 'SIZE' ELSE 'NONE' END || '"]}' AS input,
  CASE WHEN p_size = 50 THEN 50 ELSE 50 + floor(40 * p_size / 50) END::BIGINT AS percent FROM part""",
    "q96_assembled": """
WITH q AS (SELECT list(((i * 7) % 11 - 5) / 5.0::DOUBLE ORDER BY i) AS v FROM range(64) r(i)),
near AS (SELECT vec_id, greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], v))) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 40)
SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id)::INT AS position, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS nature, round(s, 5) AS score
FROM near JOIN documents ON vec_id = doc_id WHERE lang <> 'fr' ORDER BY s DESC, doc_id LIMIT 10""",
    "q97_page_errors": """
SELECT * FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS missing_ids, count(i) - count(DISTINCT i) AS repeated_ids, count(DISTINCT o_orderdate) AS pages, 9 - count(DISTINCT i) AS short_by
FROM (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS i FROM orders) GROUP BY 1) WHERE missing_ids > 0 OR repeated_ids > 0 OR short_by > 0""",
    "q98_batch_conflicts": """
SELECT o_custkey, n, CASE WHEN n > 2 THEN 'a,b,c' ELSE 'a,b' END AS tokens, 'x' AS first FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) WHERE n > 1""",
}

QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
