"""DuckDB SQL with the results of those queries that SQL can express."""

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

MIXING = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1/' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
         0.1::DOUBLE + 0.9::DOUBLE * (length(regexp_replace(coalesce(text, ''), '[^\pL]', '', 'g'))::DOUBLE
           / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS quality
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 3 AS cap
  FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM ranked
  WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 1 END::BIGINT AS epochs
  FROM targets
), taken AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.u) / s.quality, s.doc_id
                           ROWS UNBOUNDED PRECEDING) - s.size AS prior
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN prior * 2 + size <= rest * 2 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM taken
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON vec_id = roots.a LEFT JOIN n ON vec_id = n.a
"""

#: Depths to 20 are enough wherever a shard holds a millionth of the table or more.
SHARDING = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT AS h
  FROM documents
), deep AS (
  SELECT doc_id, n_bytes, depth::INT AS depth, h >> (48 - depth)::INT AS prefix FROM d, range(0, 21) r(depth)
), sums AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM deep GROUP BY depth, prefix
), fits AS (
  SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, s.shard_bytes,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS rn
  FROM deep p JOIN sums s ON p.depth = s.depth AND p.prefix = s.prefix WHERE s.shard_bytes <= 1048576
)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth, '0') END AS shard, shard_bytes
FROM fits WHERE rn = 1
"""

#: Distinct words, pairs, triples and quadruples of all texts, counted by their letters.
PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k AS words, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, range(1, 5) r(k))
), f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), cand AS (
  SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 30
), cuts AS (
  SELECT *, array_to_string(w[: k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp
  FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a // (x.n + y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, words - k + 2)) AS s FROM cand, range(2, 4) r(k) WHERE k < words)
), held AS (
  SELECT lang, phrase, max(a) AS b FROM inner_ GROUP BY lang, phrase
), stay AS (
  SELECT l.* FROM lowest l LEFT JOIN held h ON l.lang = h.lang AND l.phrase = h.phrase
  WHERE h.b IS NULL OR 100::HUGEINT * h.b < 80::HUGEINT * l.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON k.lang = t.lang WHERE rank <= 2000
"""

ORACLES = {
    "op3_exact_dedup": EXACT,
    "op4_mixing": MIXING,
    "op5_embedding_dedup": EMBEDDINGS,
    "op8_sharding": SHARDING,
    "op11_phrases": PHRASES,
}
