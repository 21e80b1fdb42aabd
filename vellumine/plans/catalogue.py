"""The registered queries. Each reads the whole of its tables; oracles.py has SQL for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..operators import facets, matching, merging, quality, ranking
from ..sources import records
from ..storage import scratch_path
from ..streaming import feeds, limiter
from . import collected, facts, indexes, stores
from .oracles import ORACLES as CATALOGUE_SQL

__all__ = ["ORACLES", "QUERIES"]

NOW = datetime(2001, 8, 2)
WANTED = ["red", "ring", "small", "economy"]
TERMS = ["the", "and", "queau", "und"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def q01_facet_page(spark: SparkSession, d: str) -> DataFrame:
    q = facets.FacetQuery(
        any_of={"p_brand": ["Brand#11", "Brand#12", "Brand#23", "Brand#34"]},
        span=("p_retailprice", "p_retailprice", 905.0, 1800.0),
    )
    parts = facets.filtered(_t(spark, d, "part"), q)
    order = [F.col("p_retailprice").desc_nulls_last(), F.col("p_name"), F.col("p_partkey")]
    return facets.page(parts, order, 1, 20).select("p_partkey", "p_name", "p_brand", "p_retailprice")


def q02_recency_filter(spark: SparkSession, d: str) -> DataFrame:
    q = facets.FacetQuery(since=("o_orderdate", datetime(2001, 5, 4)))
    return facets.filtered(_t(spark, d, "orders"), q).select("o_orderkey", "o_orderdate")


def q03_term_search(spark: SparkSession, d: str) -> DataFrame:
    q = facets.FacetQuery(search=(["p_name", "p_type"], WANTED))
    hits = facets.filtered(_t(spark, d, "part"), q).withColumn("score", _r(facets.relevance(q)))
    return hits.select("p_partkey", "score")


def q04_page_totals(spark: SparkSession, d: str) -> DataFrame:
    return facets.totals(_t(spark, d, "orders"), facets.FacetQuery(only={"o_orderpriority": ["1-URGENT", "2-HIGH"]}))


def q05_left_join_source(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").where("n_name < 'M'")
    out = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.left("c_name", F.lit(10)).alias("c_short"), "n_name")


def q06_group_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    groups = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.max("o_orderdate").alias("newest"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"),
    )
    order = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]
    return ranking.with_top_values(groups, orders, ["o_custkey"], "o_orderpriority", order, 3, "top_priorities")


def q07_pool_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("n"))


def q08_facet_values(spark: SparkSession, d: str) -> DataFrame:
    tagged = _t(spark, d, "documents").select(tx.split_tags(F.concat_ws(",", "lang", "source")).alias("tags"))
    return facets.values(tagged, "tags")


def q09_grouped_sources(spark: SparkSession, d: str) -> DataFrame:
    joined = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.array_sort(F.collect_set("s_suppkey")).alias("suppliers"))


def q10_json_extract_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, d, "events").select("event_id", k.alias("k")).orderBy(F.col("k").desc_nulls_last(), "event_id").limit(50)


def _reason() -> Column:
    size = F.nullif(F.col("p_size"), F.lit(7))
    return matching.first_reason(
        [
            ("SIZE", size > 40), ("BRAND", ~F.col("p_brand").startswith("Brand#1") & (size < 5)),
            ("TYPE", F.contains(F.lower("p_type"), F.lit("economy"))), ("PRICE", F.col("p_retailprice") < 910),
        ]
    )


def q11_first_reason(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", _reason().alias("reason"))


def q12_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    reasons = _t(spark, d, "part").select(F.coalesce(_reason(), F.lit("ELIGIBLE")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


LEVELS = {"LOW": 1, "NOT SPECIFIED": 2, "MEDIUM": 3, "HIGH": 4, "URGENT": 5}


def q13_ordinal_level(spark: SparkSession, d: str) -> DataFrame:
    level = tx.level(F.col("o_orderpriority"), LEVELS)
    return _t(spark, d, "orders").select("o_orderkey", level.alias("level"), (level >= 4).alias("enough"))


def _checks() -> dict[str, Column]:
    balance = F.nullif(F.floor("c_acctbal"), F.lit(0))
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    return {
        "balance": matching.tri_state(balance.isNotNull(), balance >= 1000),
        "nation": matching.tri_state(F.col("c_nationkey").isNotNull(), F.col("c_nationkey").isin(1, 2, 3, 4, 5, 6)),
        "segment": matching.tri_state(segment.isNotNull(), segment.isin("BUILDING", "MACHINERY")),
    }


def q14_constraint_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in _checks().items()])


def q15_override(spark: SparkSession, d: str) -> DataFrame:
    checks = F.create_map(*[x for n, c in _checks().items() for x in (F.lit(n), c)])
    return _t(spark, d, "customer").select("c_custkey", matching.overridden(F.col("c_acctbal") > 0, checks).alias("matched"))


def _keyword(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*map(F.lit, TERMS))
    scored = _t(spark, d, "documents").select("doc_id", tx.hit_score(F.col("text"), wanted).alias("score"))
    return scored.where("score > 0")


def q16_keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    return _keyword(spark, d).orderBy(F.col("score").desc(), "doc_id").limit(50).select("doc_id", _r("score").alias("score"))


def _semantic(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors = _t(spark, d, "embeddings")
    query = vectors.where("vec_id = 0").select(F.col("embedding").alias("query"))  # one row
    score = vec.clamped(vec.cosine(F.col("embedding"), F.col("query")))
    scored = vectors.join(F.broadcast(query)).select("vec_id", score.alias("score"))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(k)


def q17_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d, 50).select("vec_id", _r("score").alias("score"))


def q18_fusion(spark: SparkSession, d: str) -> DataFrame:
    semantic = _semantic(spark, d, 50).withColumnRenamed("vec_id", "doc_id")
    out = matching.fused(_keyword(spark, d), semantic, "doc_id")
    return out.select("doc_id", _r("keyword_score").alias("keyword_score"), _r("semantic_score").alias("semantic_score"), _r("score").alias("score"))


def q19_history_anti(spark: SparkSession, d: str) -> DataFrame:
    history = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return matching.without_history(_t(spark, d, "customer").select("c_custkey", "c_name"), history, "c_custkey")


def q20_semi_saved(spark: SparkSession, d: str) -> DataFrame:
    saved = _t(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("p_partkey")).distinct()
    return _t(spark, d, "part").join(saved, "p_partkey", "left_semi").select("p_partkey", "p_name")


def q21_flag_join(spark: SparkSession, d: str) -> DataFrame:
    late = _t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    out = _t(spark, d, "orders").join(late, F.col("o_orderkey") == F.col("k"), "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("returned"), F.col("n").isNotNull().alias("has_returns"))


def q22_topk_per_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profiles are the mean vectors of the labels, whose number is fixed."""
    vectors = _t(spark, d, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    profiles = means.groupBy(F.col("label").alias("profile")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query")
    )
    items = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = matching.nearest_per_profile(profiles, items, 5)
    return out.select("profile", "id", _r("score", 5).alias("score"), "rank")


def q23_assessment_validate(spark: SparkSession, d: str) -> DataFrame:
    expected = _t(spark, d, "documents").where("lang <> 'fr'").select("doc_id")
    return matching.key_set_errors(expected, _t(spark, d, "labels").select("doc_id"), "doc_id")


def q24_terms(spark: SparkSession, d: str) -> DataFrame:
    found = tx.terms(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_terms"), F.get(found, 0).alias("first_term"))


def q25_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.collapsed(F.col("text"))).alias("digest"))


def q26_preview(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", tx.preview(F.col("text"), 240).alias("preview"))


def q27_tags_split(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", tx.split_tags(F.concat_ws(" ", "p_type", "p_name"), r"\s+").alias("tags"))


def q28_url_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return _t(spark, d, "pages").select(
        "page_id", F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1)).alias("scheme"), tx.url_host(url).alias("host"),
        F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"), tx.is_web_url(url).alias("valid"),
        tx.normal_url(url).alias("normal"),
    )


def q29_link_classify(spark: SparkSession, d: str) -> DataFrame:
    url, host = F.col("url"), tx.url_host(F.col("url"))
    rules = [
        ("blog", host.startswith("blog.")), ("mobile", host.startswith("m.")), ("pills", F.contains(host, F.lit("pills"))),
        ("feed", F.contains(url, F.lit("utm_source=feed"))), ("org", tx.on_domain(url, "example.org")),
        ("net", tx.on_domain(url, "example.net")),
    ]
    return _t(spark, d, "pages").select("page_id", tx.classified_link(url, rules).alias("link_class"))


def q30_extract_links(spark: SparkSession, d: str) -> DataFrame:
    return records.page_links(_t(spark, d, "pages"), "page_id", "html").groupBy("page_id").agg(
        F.count("*").alias("n"), F.min("href").alias("first_href")
    )


def q31_dates(spark: SparkSession, d: str) -> DataFrame:
    at = tx.parsed_date(F.date_format("o_orderdate", "yyyy/MM/dd")).cast("date")
    days = F.when(F.col("o_orderpriority") == "1-URGENT", 180).otherwise(365)
    return _t(spark, d, "orders").select(
        "o_orderkey", at.alias("at"), (F.datediff(F.lit(NOW.date()), at) > days).alias("stale")
    )


def q32_identity_key(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    source_id = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string"))
    url = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    key = merging.identity_key(F.col("source"), source_id, url, [F.col("lang"), F.col("text")])
    return docs.select("doc_id", key.alias("identity_key"))


def q33_content_hash(spark: SparkSession, d: str) -> DataFrame:
    maybe = F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
    return _t(spark, d, "documents").select("doc_id", merging.digest(maybe, F.col("source"), F.col("text")).alias("content_hash"))


def q34_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return ranking.first_wins(docs, "h", ["doc_id"]).select("doc_id")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they stood early in 2001, and those since the middle of 1999 as they were delivered later."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    old = o.where("o_orderdate < timestamp'2001-02-01'").drop("o_orderdate")
    new = o.where("o_orderdate >= timestamp'1999-06-01'").drop("o_orderdate").withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")),
            "o_orderpriority": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")),
        }
    )
    content = merging.digest(F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(20,2)"))
    return old.withColumn("content", content), new.withColumn("content", content)


def q35_merge_actions(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return merging.merge(old, new, "o_orderkey", "content").select("o_orderkey", "merge_action")


def q36_merge_policy(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    out = merging.merge(old, new, "o_orderkey", "content", keep=["o_orderpriority"])
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _hashed(spark: SparkSession, d: str) -> tuple[DataFrame, list[Column]]:
    docs = _t(spark, d, "documents").withColumn("h", F.md5("text"))
    return docs, [merging.completeness(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.col("source"))]


def q37_duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    docs, full = _hashed(spark, d)
    return merging.duplicate_report(docs, "h", "doc_id", full)


def q38_repoint(spark: SparkSession, d: str) -> DataFrame:
    docs, full = _hashed(spark, d)
    winners = merging.memberships(docs, "h", "doc_id", full)
    refs = _t(spark, d, "labels").select("doc_id", "quality")
    return merging.repointed(refs, winners, "doc_id", ["doc_id", "quality"])


def q39_ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "purchase", -1).otherwise(1)
    entries = _t(spark, d, "events").select("event_id", "user_id", "ts", (F.round(F.col("value") * 100).cast("long") * sign).alias("amount"))
    return ranking.running_sum(entries, "user_id", "amount", ["ts", "event_id"]).select("event_id", "balance")


def q40_latest_version(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return ranking.latest(rows, ["user_id", "event_type"], ["ts", "event_id"])


def q41_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    problems = {
        "cheap": F.col("o_totalprice") < 1500, "odd_status": F.col("o_orderstatus") == "P",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
    }
    stale = F.col("o_orderdate") < F.lit(datetime(1999, 1, 1))
    return quality.gate(_t(spark, d, "orders"), ["o_custkey"], problems, stale)


def q42_gap_rollup(spark: SparkSession, d: str) -> DataFrame:
    events = _t(spark, d, "events").withColumn("kind", quality.failure_kind(F.col("event_type"), {"c": "EARLY", "p": "LATE"}))
    return quality.gaps(events, ["kind", "event_type"], "user_id", "event_id")


def q43_html_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("digest"))


def q44_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.stratified(_t(spark, d, "events"), "event_type", "event_id", 5, "audit")
    return out.select("event_type", "event_id", "rank")


def q45_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counted(_t(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "view"])


def q46_coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return merging.filled(c, s, "k", ["nation", "name"])


def q47_change_detect(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents were seen before: toxic ones in another form, poor ones without success."""
    docs = _t(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    seen = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    state = docs.join(seen, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit("old")).otherwise(F.col("h")).alias("h"),
        F.when(F.col("quality") == 0, "FAILED").otherwise("OK").alias("status"),
    )
    return merging.changed(docs, state, "doc_id", "h").select("doc_id")


def q48_sliding_count(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sliding_count(_t(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


def q49_session_window(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sessions(_t(spark, d, "events"), "user_id", "ts", 1800)


def q50_stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream in two runs; the second brings events of 20 years before, which come too late."""
    events, base = _t(spark, d, "events"), scratch_path(spark, "stream")
    own = events.select("ts", "event_type", F.lit(1).alias("value"))
    for rows in (own, own.withColumn("ts", F.col("ts") - F.expr("INTERVAL 20 YEARS"))):
        rows.write.mode("append").parquet(f"{base}/in")
        hourly = feeds.windowed(feeds.files(spark, f"{base}/in", own), "ts", "30 days", "1 hour", "event_type")
        feeds.run_available(hourly, _numbered(f"{base}/rows"), f"{base}/checkpoint", "update")
    updates = spark.read.parquet(f"{base}/rows")
    last = updates.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _numbered(path: str):  # noqa: ANN202
    """Writes each batch's updates to a folder of its own, so a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def q51_limiter(spark: SparkSession, d: str) -> DataFrame:
    return limiter.accepted(_t(spark, d, "events"), "user_id", "ts", "event_id", 3, 86_400)


ORACLES = CATALOGUE_SQL | facts.ORACLES | collected.ORACLES | stores.ORACLES | indexes.ORACLES
QUERIES = collected.QUERIES | facts.QUERIES | stores.QUERIES | indexes.QUERIES | {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
