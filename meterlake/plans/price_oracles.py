"""DuckDB SQL for the price book: the vote of the feeds, candidate names, resolution and repricing.

Written for the quotes of the registered queries, where each source quotes a model once.
"""

from __future__ import annotations

from meterlake.operators.pricing import STRIP_PREFIXES, STRIP_SUFFIXES, TRUST
from meterlake.plans.fixtures import DUCK_LEDGER, DUCK_QUOTES

_TOLERANCE = 0.06


def _near(a: str, b: str) -> str:
    return f"({a} = {b} OR abs({a} - {b}) <= {_TOLERANCE} * greatest({a}, {b}))"


def _canon(name: str) -> str:
    return f"regexp_replace({name}, '([0-9])\\.([0-9])', '\\1-\\2', 'g')"


_FOUNDED = f"lambda f: {_near('f.i', 'v.input')} AND {_near('f.o', 'v.output')}"
#: Voters join the first camp whose founder is close, in order of trust.
_VOTE = f"""{DUCK_QUOTES},
 t AS (SELECT unnest({list(TRUST)}) AS source, unnest(range({len(TRUST)})) AS rank, unnest({list(TRUST.values())}) AS weight),
 q AS (SELECT {_canon('model_id')} AS canon, quotes.*, rank, weight FROM quotes JOIN t USING (source)),
 l AS (SELECT *, source = 'seed' AND bool_or(source <> 'seed') OVER (PARTITION BY canon) AS aside, input + output > 0 AS usable FROM q),
 v AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY rank, model_id) AS n FROM l WHERE usable AND NOT aside),
 g AS (SELECT canon, n, [{{'i': input, 'o': output}}] AS founders, [1::BIGINT] AS camps FROM v WHERE n = 1
  UNION ALL SELECT canon, n, CASE WHEN hit IS NULL THEN list_append(founders, me) ELSE founders END, list_append(camps, COALESCE(hit, len(founders) + 1)) FROM (
   SELECT g.canon, v.n, founders, camps, {{'i': v.input, 'o': v.output}} AS me, NULLIF(COALESCE(list_position(list_transform(founders, {_FOUNDED}), true), 0), 0)::BIGINT AS hit FROM g JOIN v ON v.canon = g.canon AND v.n = g.n + 1)),
 c AS (SELECT canon, max_by(camps, n) AS camps FROM g GROUP BY canon),
 m AS (SELECT v.*, camps[n] AS camp FROM v JOIN c USING (canon)),
 k AS (SELECT canon, camp, SUM(weight) AS w, COUNT(*) AS size, arg_min(input, n) AS i, arg_min(output, n) AS o FROM m GROUP BY 1, 2),
 s AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY w DESC, camp) AS strong, row_number() OVER (PARTITION BY canon ORDER BY o, i, camp) AS middle, COUNT(*) OVER (PARTITION BY canon) AS camps, SUM(size) OVER (PARTITION BY canon) AS voters FROM k),
 x AS (SELECT canon, CASE WHEN MAX(size) FILTER (WHERE strong = 1) > 1 OR MAX(voters) = 1 THEN MAX(camp) FILTER (WHERE strong = 1) WHEN MAX(voters) = 2 THEN 1 ELSE MAX(camp) FILTER (WHERE middle = camps // 2 + 1) END AS camp FROM s GROUP BY canon),
 p AS (SELECT canon, arg_min(source, n) AS source, arg_min(input, n) AS input, arg_min(output, n) AS output, COALESCE(arg_min(cache_read, n) FILTER (WHERE cache_read > 0), 0) AS cache_read FROM m JOIN x USING (canon, camp) GROUP BY canon),
 st AS (SELECT l.canon, l.source, l.model_id, CASE WHEN aside THEN 'Ignored' WHEN NOT usable THEN 'NoData' WHEN {_near('l.input', 'p.input')} AND {_near('l.output', 'p.output')} THEN 'Agrees' ELSE 'Dissents' END AS stance FROM l LEFT JOIN p USING (canon))"""
_NO_TIERS = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("tier_above_200k_input", "tier_1h_cache_write", "tier_batch", "tier_above_200k_output", "tier_above_200k_cache_read"))
_PEELS = [
    *(f"CASE WHEN starts_with(candidate, '{x}') THEN substr(candidate, {len(x) + 1}) END" for x in STRIP_PREFIXES),
    "CASE WHEN strpos(candidate, 'claude-') > 1 THEN regexp_extract(candidate, '.*(claude-.*)$', 1) END",
    "CASE WHEN regexp_matches(candidate, '-v[0-9]+$') THEN regexp_replace(candidate, '-v[0-9]+$', '') END",
    "CASE WHEN regexp_matches(candidate, '-([0-9]{4}|[0-9]{6}|[0-9]{8})$') THEN regexp_replace(candidate, '-[0-9]+$', '') END",
    *(f"CASE WHEN ends_with(candidate, '{x}') THEN left(candidate, length(candidate) - {len(x)}) END" for x in STRIP_SUFFIXES),
    "CASE WHEN regexp_matches(candidate, '.-[a-z]$') THEN left(candidate, length(candidate) - 2) END",
]
_NAMES = "nm AS (SELECT DISTINCT unnest(['vendor/openai.' || model_id || '-high', model_id || '-20250101', model_id]) AS name FROM quotes)"
_CANDIDATES = f"""{_NAMES},
 e AS (SELECT name, lower(regexp_extract(name, '([^/]*)$', 1)) AS candidate, [0::BIGINT] AS path, true AS first FROM nm
  UNION ALL SELECT name, peeled, list_append(path, rule), false FROM (SELECT name, path, unnest([{', '.join(_PEELS)}]) AS peeled, unnest(range({len(_PEELS)})) AS rule FROM e) WHERE peeled <> ''),
 ca AS (SELECT name, candidate, MIN(len(path)) AS depth, arg_min(path, (len(path), path)) AS path, bool_or(first) AS first FROM e GROUP BY 1, 2),
 cr AS (SELECT name, candidate, (row_number() OVER (PARTITION BY name ORDER BY depth, path) - 1)::INT AS rank, first AS "primary" FROM ca)"""
_PRICES = f"input, output, cache_read, 0.0::DOUBLE AS cache_write, {_NO_TIERS}"
_ROUNDED = f"ROUND(input, 8) AS input, ROUND(output, 8) AS output, ROUND(cache_read, 8) AS cache_read, CASE WHEN p.canon IS NOT NULL THEN 0.0 END::DOUBLE AS cache_write, {_NO_TIERS}"

ORACLES = {
    "price_consensus": f"""WITH RECURSIVE {_VOTE},
 d AS (SELECT canon, model_id AS display, row_number() OVER (PARTITION BY canon ORDER BY COUNT(*) DESC, model_id) AS k FROM q GROUP BY 1, 2), f AS (SELECT canon, arg_min(source, rank) AS source FROM q GROUP BY 1),
 a AS (SELECT canon, COUNT(*) FILTER (WHERE stance = 'Agrees') AS agree, COUNT(*) FILTER (WHERE stance IN ('Agrees', 'Dissents')) AS total FROM st GROUP BY 1)
 SELECT canon, display, COALESCE(p.source, f.source) AS source, p.canon IS NOT NULL AS priced, agree, total, {_ROUNDED} FROM a JOIN d USING (canon) JOIN f USING (canon) LEFT JOIN p USING (canon) WHERE k = 1""",
    "price_stances": f"WITH RECURSIVE {_VOTE} SELECT * FROM st",
    "candidates": f"WITH RECURSIVE {DUCK_QUOTES}, {_CANDIDATES} SELECT * FROM cr",
    "resolve_prices": f"""WITH RECURSIVE {_VOTE}, {_CANDIDATES},
 b AS (SELECT name, candidate, "primary", p.*, row_number() OVER (PARTITION BY name ORDER BY rank) AS k FROM cr JOIN p ON p.canon = {_canon('candidate')})
 SELECT name AS raw, NULL::VARCHAR AS request, candidate AS pricing_model, CASE WHEN "primary" THEN 'exact' ELSE 'prefix' END AS via, {_PRICES} FROM b WHERE k = 1""",
    "reprice_diff": f"""WITH RECURSIVE {DUCK_LEDGER}, {_VOTE}
 SELECT dedup_key, p.canon AS pricing_model, 'computed' AS cost_source, ROUND(ROUND((input_tokens * input + output_tokens * output + cache_read_tokens * CASE WHEN cache_read > 0 THEN cache_read ELSE input * 0.1 END
 + cache_write_5m_tokens * (input * 1.25) + cache_write_1h_tokens * (input * 2.0)) / 1000000.0, 9), 8) AS cost_usd FROM ledger JOIN p ON p.canon = 'm-' || (event_id % 150)::VARCHAR || '-1'
 WHERE event_id % 3 <> 0 AND unclassified_tokens <= 0 AND input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens + reasoning_tokens > 0""",
}
