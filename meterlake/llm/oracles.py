"""DuckDB SQL that gives the same rows as the registered queries, where SQL can express them."""

from __future__ import annotations

from meterlake.llm import url_filter

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP10_WORDS = [(w, url_filter.STRICT_WEIGHT) for w in url_filter.STRICT] + [(w, url_filter.SOFT_WEIGHT) for w in url_filter.SOFT]
_OP10_WEIGHT = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN {n} ELSE 0 END" for w, n in _OP10_WORDS)

ORACLES = {
    # the pages of the given tables are well enough formed for plain patterns
    "op1_html_text": r"""
WITH cut AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
lines AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '(?s)</?(p|h1|div|ul|li)( [^>]*)?>', chr(1), 'g'),
  '(?s)<br>', ' ', 'g'), chr(1)) AS parts FROM cut),
plain AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'), '&amp', '&'),
  '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM lines)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text, length(coalesce(array_to_string(parts, chr(10)), '')) AS n_chars FROM plain""",
    "op2_near_duplicates": rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, doc_id, array_to_string(w[j:j + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(j) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
e AS MATERIALIZED (SELECT na.doc_id AS a, nb.doc_id AS b FROM i JOIN n na ON na.r = i.a JOIN n nb ON nb.r = i.b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (r) JOIN c ON c.a = d.doc_id""",
    "op3_mix_sources": r"""
WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
w AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s GROUP BY source),
level AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM w)::DOUBLE AS words, (SELECT sum(weight) FROM w)::DOUBLE AS weights, 0::BIGINT AS capped
  UNION ALL
  SELECT step + 1, (SELECT sum(source_size) FROM w)::DOUBLE - coalesce(n.used, 0)::DOUBLE, n.weights::DOUBLE, n.capped
  FROM level, LATERAL (SELECT count(*) FILTER (WHERE level.words / level.weights * weight > 3 * source_size) AS capped,
    sum(3 * source_size) FILTER (WHERE level.words / level.weights * weight > 3 * source_size) AS used,
    sum(weight) FILTER (WHERE NOT level.words / level.weights * weight > 3 * source_size) AS weights FROM w) n
  WHERE n.capped > level.capped AND step < 100),
last AS (SELECT * FROM level ORDER BY step DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN words / weights * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE words * weight / weights END AS target FROM w, last),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
c AS (SELECT s.doc_id, s.size, source_size, target, rounds, target - rounds * source_size AS budget,
  sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op6_remove_repeats": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, j, array_to_string(w[j:j + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) AS u(j)),
m AS MATERIALIZED (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY g ORDER BY doc_id, j) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, x FROM m, unnest(range(j, j + 20)) AS u(x)),
lost AS (SELECT doc_id, list(x) AS xs FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, w, coalesce(len(xs), 0) AS n_removed, xs FROM d LEFT JOIN lost USING (doc_id)),
word AS (SELECT doc_id, x, w[x] AS word FROM k, unnest(range(1, n + 1)) AS u(x)),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t FROM word ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id)
SELECT k.doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN stay USING (doc_id)""",
    "op9_decontamination": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM i, unnest(range(1, len(w) - k + 2)) AS u(j)),
g AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM p), unnest(range(1, len(w) - k + 2)) AS u(j)),
m AS MATERIALIZED (SELECT r, g.k, j, item_id FROM g JOIN p ON g.g = p.g AND g.k = p.k),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM m, unnest(range(j, j + k)) AS u(x) GROUP BY r),
met AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN met USING (r)""",
    "op10_url_filter": rf"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), {_LOWER}) AS low, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER}) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT page_id, host, path, {_OP10_WEIGHT} AS weight, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN weight >= 2 THEN 'block' ELSE 'allow' END AS verdict FROM v""",
    "op12_hard_negatives": r"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id) <= 5""",
    # the checksum bit by bit, from its polynomial
    "op13_prefix_trie": r"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
  lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(s, x)), 4294967295), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
w AS (SELECT c.conv_id, 0 AS part, pos, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
v AS MATERIALIZED (SELECT conv_id, coalesce(list(x ORDER BY part, pos) FILTER (x IS NOT NULL), []) AS xs FROM c LEFT JOIN w USING (conv_id) GROUP BY conv_id),
n AS MATERIALIZED (SELECT xs[:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(xs) = d), '') AS ends FROM v, unnest(range(0, len(xs) + 1)) AS u(d) GROUP BY ALL),
k AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.path[:n.depth] = n.path) AS n_children FROM n),
b AS (SELECT m.path[:d] AS path, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * CASE WHEN m.depth > 0 THEN strlen(m.path[m.depth].t) ELSE 0 END) AS saved
  FROM k m, unnest(range(0, m.depth + 1)) AS u(d) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN b USING (path) LEFT JOIN n p ON p.depth = k.depth - 1 AND p.path = k.path[:k.depth - 1] AND k.depth > 0""",
}
