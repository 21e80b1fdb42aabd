"""DuckDB SQL with the results of the registered queries."""

_REASON = """CASE
  WHEN coalesce(nullif(p_size, 7) > 40, false) THEN 'SIZE'
  WHEN NOT starts_with(p_brand, 'Brand#1') AND coalesce(nullif(p_size, 7) < 5, false) THEN 'BRAND'
  WHEN contains(lower(p_type), 'economy') THEN 'TYPE'
  WHEN p_retailprice < 910 THEN 'PRICE' END"""

_CHECKS = """
  SELECT c_custkey, c_acctbal,
    CASE WHEN nullif(floor(c_acctbal), 0) IS NULL THEN 'UNKNOWN' WHEN floor(c_acctbal) >= 1000 THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS balance,
    CASE WHEN c_nationkey IS NULL THEN 'UNKNOWN' WHEN c_nationkey IN (1, 2, 3, 4, 5, 6) THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS nation,
    CASE WHEN c_custkey % 7 = 0 OR c_mktsegment IS NULL THEN 'UNKNOWN' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END AS segment
  FROM customer"""

_KEYWORD = """
  SELECT doc_id, len(list_filter(['the', 'and', 'queau', 'und'], lambda t: contains(lower(text), t))) / 4.0::DOUBLE AS score
  FROM documents"""

_SEMANTIC = """
  SELECT e.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 50"""

_HALVES = """
  old AS (
    SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice::DECIMAL(20,2) AS price FROM orders WHERE o_orderdate < TIMESTAMP '2001-02-01'
  ), new AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority, o_totalprice::DECIMAL(20,2) AS price
    FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'
  )"""

_COPIES = """
  SELECT md5(text) AS h,
         arg_max(doc_id, ((CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 1 END)::BIGINT << 40) + doc_id) AS winner,
         list_sort(list(DISTINCT doc_id)) AS ids, count(*) AS n
  FROM documents GROUP BY 1 HAVING count(*) > 1"""

ORACLES = {
    "q01_facet_page": """
SELECT p_partkey, p_name, p_brand, p_retailprice FROM part
WHERE (p_brand IS NULL OR p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34'))
  AND (p_retailprice IS NULL OR p_retailprice >= 905) AND (p_retailprice IS NULL OR p_retailprice <= 1800)
ORDER BY p_retailprice DESC NULLS LAST, p_name, p_partkey LIMIT 20""",
    "q02_recency_filter": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-04'",
    "q03_term_search": """
SELECT p_partkey, round(n / 4.0::DOUBLE, 6) AS score FROM (
  SELECT p_partkey, len(list_filter(['red', 'ring', 'small', 'economy'], lambda t: contains(lower(p_name || ' ' || p_type), t))) AS n FROM part
) WHERE n > 0""",
    "q04_page_totals": """
SELECT count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS total, count(*) AS pool_total FROM orders""",
    "q05_left_join_source": """
SELECT c_custkey, left(c_name, 10) AS c_short, n_name FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_name < 'M') ON c_nationkey = n_nationkey""",
    "q06_group_rollup": """
SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest, list_sort(list(DISTINCT o_orderstatus)) AS statuses,
       list(o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)[1:3] AS top_priorities
FROM orders GROUP BY o_custkey""",
    "q07_pool_count_distinct": "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders",
    "q08_facet_values": """
SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct([lang, source])) AS value FROM documents) GROUP BY value""",
    "q09_grouped_sources": """
SELECT n_name, list_sort(list(DISTINCT s_suppkey)) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "q10_json_extract_order": """
SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 50""",
    "q11_first_reason": f"SELECT p_partkey, {_REASON} AS reason FROM part",
    "q12_reason_counts": f"SELECT coalesce({_REASON}, 'ELIGIBLE') AS reason, count(*) AS n FROM part GROUP BY 1",
    "q13_ordinal_level": """
SELECT o_orderkey, level, level >= 4 AS enough FROM (SELECT o_orderkey, greatest(
  CASE WHEN contains(o_orderpriority, 'LOW') THEN 1 END, CASE WHEN contains(o_orderpriority, 'NOT SPECIFIED') THEN 2 END,
  CASE WHEN contains(o_orderpriority, 'MEDIUM') THEN 3 END, CASE WHEN contains(o_orderpriority, 'HIGH') THEN 4 END,
  CASE WHEN contains(o_orderpriority, 'URGENT') THEN 5 END) AS level FROM orders)""",
    "q14_constraint_matrix": f"SELECT c_custkey, balance, nation, segment FROM ({_CHECKS})",
    "q15_override": f"""
SELECT c_custkey, c_acctbal > 0 AND balance <> 'NOT_SATISFIED' AND nation <> 'NOT_SATISFIED' AND segment <> 'NOT_SATISFIED' AS matched
FROM ({_CHECKS})""",
    "q16_keyword_rank": f"SELECT doc_id, round(score, 6) AS score FROM ({_KEYWORD}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50",
    "q17_vector_topk": f"SELECT vec_id, round(score, 6) AS score FROM ({_SEMANTIC})",
    "q18_fusion": f"""
SELECT doc_id, round(k, 6) AS keyword_score, round(s, 6) AS semantic_score, round(k * 0.5 + s * 0.5, 6) AS score FROM (
  SELECT coalesce(a.doc_id, b.vec_id) AS doc_id, coalesce(a.score, 0.0) AS k, coalesce(b.score, 0.0) AS s
  FROM (SELECT * FROM ({_KEYWORD}) WHERE score > 0) a FULL JOIN ({_SEMANTIC}) b ON a.doc_id = b.vec_id
) ORDER BY k * 0.5 + s * 0.5 DESC, doc_id LIMIT 50""",
    "q19_history_anti": """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    "q20_semi_saved": """
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
    "q21_flag_join": """
SELECT o_orderkey, coalesce(n, 0) AS returned, n IS NOT NULL AS has_returns FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""",
    "q22_topk_per_profile": """
WITH parts AS (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings
), means AS (
  SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i
), profiles AS (
  SELECT label AS profile, list(m ORDER BY i) AS query FROM means GROUP BY label
), scored AS (
  SELECT profile, vec_id AS id, greatest(0.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], query))) AS s FROM embeddings, profiles
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY profile ORDER BY s DESC, id)::INT AS rank FROM scored
)
SELECT profile, id, round(s, 5) AS score, rank FROM ranked WHERE rank <= 5""",
    "q23_assessment_validate": """
WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'fr'), g AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id)
SELECT * FROM (
  SELECT coalesce(e.doc_id, g.doc_id) AS doc_id,
         CASE WHEN n IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS problem
  FROM e FULL JOIN g ON e.doc_id = g.doc_id
) WHERE problem IS NOT NULL""",
    "q24_terms": """
SELECT doc_id, len(list_distinct(t))::BIGINT AS n_terms, t[1] AS first_term
FROM (SELECT doc_id, regexp_extract_all(lower(text), '([一-鿿]{2,}|[a-z0-9+#.]{2,})', 1) AS t FROM documents)""",
    "q25_normalize_text": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'))) AS digest FROM documents",
    "q26_preview": r"""
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(t[1:239]) || '…' END AS preview
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) AS t FROM documents)""",
    "q27_tags_split": r"""
WITH parts AS (
  SELECT p_partkey, tag, min(pos) AS pos FROM (
    SELECT p_partkey, unnest(t) AS tag, generate_subscripts(t, 1) AS pos
    FROM (SELECT p_partkey, regexp_split_to_array(p_type || ' ' || p_name, '\s+') AS t FROM part)
  ) WHERE tag <> '' GROUP BY p_partkey, tag
)
SELECT p_partkey, list(tag ORDER BY pos) AS tags FROM parts GROUP BY p_partkey""",
    "q28_url_parts": r"""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme,
       lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host,
       regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
       coalesce(regexp_matches(url, '^https?://[^\s/?#]+\.[^\s/?#]+'), false) AS valid, regexp_replace(regexp_replace(url, '#.*$', ''), '/+([?].*)?$', '\1') AS normal
FROM pages""",
    "q29_link_classify": r"""
SELECT page_id, CASE WHEN url IS NULL THEN 'missing' WHEN starts_with(h, 'blog.') THEN 'blog' WHEN starts_with(h, 'm.') THEN 'mobile'
  WHEN contains(h, 'pills') THEN 'pills' WHEN contains(url, 'utm_source=feed') THEN 'feed'
  WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'org' WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'net'
  ELSE 'unknown' END AS link_class
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS h FROM pages)""",
    "q30_extract_links": r"""
SELECT page_id, count(*) AS n, min(href) AS first_href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
    "q31_dates": """
SELECT o_orderkey, o_orderdate::DATE AS at,
       date_diff('day', o_orderdate::DATE, DATE '2001-08-02') > CASE WHEN o_orderpriority = '1-URGENT' THEN 180 ELSE 365 END AS stale
FROM orders""",
    "q32_identity_key": """
SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN to_json(['id', source, doc_id::VARCHAR]) WHEN 1 THEN to_json(['url', source, 'u' || doc_id])
  ELSE to_json(['facts', source, lang, text]) END::VARCHAR) AS identity_key
FROM documents""",
    "q33_content_hash": """
SELECT doc_id, sha256(to_json([CASE WHEN doc_id % 7 <> 0 THEN lang END, source, text])::VARCHAR) AS content_hash
FROM documents""",
    "q34_dedup_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "q35_merge_actions": f"""
WITH {_HALVES}
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey,
  CASE WHEN new.o_orderkey IS NULL THEN 'KEPT' WHEN old.o_orderkey IS NULL THEN 'CREATED'
       WHEN old.o_orderstatus IS NOT DISTINCT FROM new.o_orderstatus AND old.price IS NOT DISTINCT FROM new.price THEN 'UNCHANGED'
       ELSE 'UPDATED' END AS merge_action
FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""",
    "q36_merge_policy": f"""
WITH {_HALVES}
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey,
  CASE WHEN new.o_orderkey IS NULL THEN old.o_orderstatus ELSE new.o_orderstatus END AS o_orderstatus,
  CASE WHEN new.o_orderkey IS NULL THEN old.o_orderpriority ELSE coalesce(new.o_orderpriority, old.o_orderpriority) END AS o_orderpriority
FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""",
    "q37_duplicate_report": f"SELECT h, winner, ids[1:3] AS ids, n FROM ({_COPIES})",
    "q38_repoint": f"""
WITH w AS (SELECT unnest(ids) AS doc_id, winner FROM ({_COPIES}))
SELECT DISTINCT coalesce(winner, l.doc_id) AS doc_id, quality FROM labels l LEFT JOIN w ON l.doc_id = w.doc_id""",
    "q39_ledger_balance": """
SELECT event_id, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM (
  SELECT event_id, user_id, ts, round(value * 100)::BIGINT * CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END AS amount FROM events)""",
    "q40_latest_version": """
SELECT user_id, event_type, event_id, ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "q41_quality_gate": """
SELECT o_custkey, n, CASE WHEN stale THEN ['STALE_PUBLISHED_AT'] ELSE reasons END AS reasons, CASE WHEN stale THEN 'SKIP' WHEN len(reasons) > 0 THEN 'FALLBACK' ELSE 'ACCEPT' END AS decision FROM (
  SELECT o_custkey, count(*) AS n, bool_and(o_orderdate < TIMESTAMP '1999-01-01') AS stale,
    list_sort(list_filter([CASE WHEN bool_or(o_totalprice < 1500) THEN 'cheap' END, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'odd_status' END,
      CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'urgent' END], lambda x: x IS NOT NULL)) AS reasons
  FROM orders GROUP BY o_custkey)""",
    "q42_gap_rollup": """
SELECT CASE WHEN starts_with(event_type, 'c') THEN 'EARLY' WHEN starts_with(event_type, 'p') THEN 'LATE' ELSE 'OTHER' END AS kind, event_type,
       count(*) AS n, count(DISTINCT user_id) AS n_who, list_sort(list(DISTINCT event_id))[1:3] AS samples
FROM events GROUP BY 1, 2""",
    "q43_html_text": r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest
FROM pages""",
    "q44_stratified_sample": """
SELECT event_type, event_id, rank FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('audit/' || event_id), event_id)::INT AS rank FROM events
) WHERE rank <= 5""",
    "q45_type_counts": """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       count(*) FILTER (WHERE event_type = 'view') AS view
FROM events GROUP BY user_id""",
    "q46_coalesce_merge": """
SELECT c_custkey AS k, coalesce(nullif(c_nationkey, 3), s_nationkey) AS nation,
       coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, s_name) AS name
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "q47_change_detect": """
SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR toxic = 1 OR quality = 0""",
    "q48_sliding_count": """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS recent
FROM events""",
    "q49_session_window": """
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked
)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s""",
    "q51_limiter": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), s AS (
  SELECT user_id, event_id, n, [us] AS last, true AS accepted FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN len(last) < 3 OR last[-3] <= us - 86400000000 THEN list_append(last, us)[-3:] ELSE last END,
         len(last) < 3 OR last[-3] <= us - 86400000000
  FROM s JOIN e ON s.user_id = e.user_id AND e.n = s.n + 1
)
SELECT user_id, event_id, accepted FROM s""",
    "q50_stream_equals_batch": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
