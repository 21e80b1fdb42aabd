"""Queries over what the library stores itself: paged replies, snapshots, ranks, indexes, states; with DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fallback
from ..operators.rank_directory import RankDirectory
from ..operators.snapshots import Snapshots
from ..operators.vector_index import VectorIndex
from ..sources import page_functions, paged
from ..storage import scratch_path
from ..streaming import feeds, machines
from .collected import TITLES, title_cells


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q99_paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Events recorded as pages, a view for each type; the scan stops at the cut-off."""
    events = _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    path = scratch_path(spark, "replies")
    paged.register(spark)
    paged.record(events, path, F.col("event_type"), F.col("event_id"), F.col("ts"))
    found = spark.read.format("paged").options(path=path, fields="user_id,event_type,value").load()
    late = found.where(F.col("last_modified") > datetime(2024, 1, 4))
    return late.select(F.col("record_id").cast("bigint").alias("event_id"), F.unix_millis("last_modified").alias("at"), F.col("user_id").cast("bigint").alias("user_id"), "event_type", "value")


def q100_snapshot_store(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of orders: all, then some that are changed, the same, or new."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    store = Snapshots(spark, scratch_path(spark, "snapshots"), "o_orderkey", "o_orderstatus", buckets=16, keep=["o_orderpriority"])
    store.merge(orders, 0)
    k = F.col("o_orderkey")
    changed = orders.where(k % 9 == 0).select(
        F.when(k % 2 == 0, k).otherwise(-k).alias("o_orderkey"), F.when(k % 4 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 5 == 0, "new").alias("o_orderpriority"),
    )
    store.merge(changed, 1)
    store.merge(changed.withColumn("o_orderstatus", F.lit("late")), 1)  # a repeated number changes nothing
    return store.read()


def q101_balances(spark: SparkSession, d: str) -> DataFrame:
    """Debits of purchases are accepted while the user's balance covers them; by a stream."""
    cents = F.round(F.col("value") * 100).cast("long")
    events = _t(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", -3 * cents).otherwise(cents).alias("amount"))
    source, out, checkpoint = (scratch_path(spark, n) for n in ("events", "balances", "states"))
    events.write.parquet(source)
    stream = feeds.files(spark, source, events, per_batch=1000)
    feeds.append_available(machines.decisions(stream, machines.Balance(), "user_id", "event_id", F.col("ts"), ["amount"], ("balance",)), out, checkpoint)
    return spark.read.parquet(out).select("user_id", F.col("id").alias("event_id"), "outcome", "balance")


def q102_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest of each of five vectors, by the index."""
    vectors = _t(spark, d, "embeddings")
    index = VectorIndex.build(vectors, "vec_id", "embedding", scratch_path(spark, "vectors"))
    asked = {str(r["vec_id"]): r["embedding"] for r in vectors.where(F.col("vec_id").between(0, 4)).collect()}
    found = index.search(asked, 50)
    return found.select(F.col("query").cast("bigint").alias("query"), "id", F.round("score", 6).alias("score"), "rank")


def _ranks(spark: SparkSession, d: str) -> RankDirectory:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return RankDirectory.build(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], scratch_path(spark, "ranks"))


def q103_positions(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).positions().select("o_orderkey", "position")


def q104_deep_page(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).page(50, 25)


def q105_table_jobs(spark: SparkSession, d: str) -> DataFrame:
    parts = _t(spark, d, "part").select("p_partkey", "p_brand", title_cells().alias("cell"))
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://x.com/"), F.col("p_partkey")))
    record = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey"))
    jobs = fallback.table_jobs(parts, "cell", "p_brand", record, F.col("p_partkey"), url, F.array(F.lit("A"), F.lit("A")))
    return jobs.select("p_partkey", "title", "source_job_id", "job_url", "source_ref", F.get_json_object("metadata", "$.quality_reasons").alias("reasons"))


def q106_embedded_values(spark: SparkSession, d: str) -> DataFrame:
    """The table function, called from SQL over the pages."""
    page_functions.register(spark)
    _t(spark, d, "pages").createOrReplaceTempView("pages_with_data")
    return spark.sql("""
        SELECT page_id, ordinal, value FROM embedded_values(TABLE(
          SELECT page_id, kind, CASE kind WHEN 'MOKA' THEN concat('<input id="init-data" value="{&quot;u&quot;:&quot;', url, '&quot;}">', html)
                                     ELSE concat(html, ' phApp.ddo = {"u": "', url, '"}; phApp.ddo = [', page_id, ']') END AS html
          FROM (SELECT *, element_at(array('MOKA', 'PHENOM', 'NONE'), cast(page_id % 3 AS int) + 1) AS kind FROM pages_with_data)))""")


ORACLES = {
    "q99_paged_scan": """
SELECT event_id, epoch_us(ts) // 1000 AS at, user_id, event_type, value FROM events WHERE epoch_us(ts) // 1000 > 1704326400000""",
    "q100_snapshot_store": """
WITH c AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS k, CASE WHEN o_orderkey % 4 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s,
         CASE WHEN o_orderkey % 5 = 0 THEN 'new' END AS p FROM orders WHERE o_orderkey % 9 = 0
)
SELECT coalesce(k, o_orderkey) AS o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(p, o_orderpriority) AS o_orderpriority
FROM orders FULL JOIN c ON k = o_orderkey""",
    "q101_balances": """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
         round(value * 100)::BIGINT * CASE WHEN event_type = 'purchase' THEN -3 ELSE 1 END AS amount FROM events
), r(user_id, event_id, n, outcome, balance) AS (
  SELECT user_id, event_id, n, CASE WHEN amount >= 0 THEN 'ACCEPTED' ELSE 'REFUSED' END, greatest(amount, 0) FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN e.amount >= 0 OR r.balance + e.amount >= 0 THEN 'ACCEPTED' ELSE 'REFUSED' END,
         CASE WHEN e.amount >= 0 OR r.balance + e.amount >= 0 THEN r.balance + e.amount ELSE r.balance END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1
)
SELECT user_id, event_id, outcome, balance FROM r""",
    "q102_vector_index": """
WITH s AS (
  SELECT q.vec_id AS query, v.vec_id AS id, greatest(0, least(1, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id BETWEEN 0 AND 4
)
SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 50""",
    "q103_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders",
    "q104_deep_page": """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 1225""",
    "q105_table_jobs": f"""
SELECT p_partkey, title, 'table-fallback:' || r || ':' || left(sha256(lower(regexp_replace(title, '\\s', '', 'g'))), 16) AS source_job_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'https://x.com/' || p_partkey END AS job_url,
       CASE WHEN p_partkey % 3 <> 0 THEN r ELSE 'table-' || r END AS source_ref, '["A"]' AS reasons
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'record:' ELSE 'row:' END || p_partkey AS r, unnest({TITLES}) AS title FROM part)""",
    "q106_embedded_values": """
SELECT page_id, 0 AS ordinal, '{"u"' || CASE WHEN page_id % 3 = 0 THEN ':' ELSE ': ' END || '"' || url || '"}' AS value FROM pages WHERE page_id % 3 < 2
UNION ALL SELECT page_id, 1, '[' || page_id || ']' FROM pages WHERE page_id % 3 = 1""",
}

QUERIES = {name: f for name, f in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
