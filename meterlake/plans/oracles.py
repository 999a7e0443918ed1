"""DuckDB SQL that gives the same rows as the registered ledger queries."""

from __future__ import annotations

from meterlake.plans.fixtures import ANCHOR_MS, DUCK_ARRIVALS, DUCK_LEDGER, DUCK_QUOTAS, DUCK_QUOTES

A = ANCHOR_MS
SHIFT = 8 * 3_600_000
MODEL = "COALESCE(NULLIF(model, ''), NULLIF(request_model, ''), NULLIF(pricing_model, ''), '?')"
HEAD = "(input_tokens + output_tokens + cache_read_tokens + unclassified_tokens)"
_SPAN = "(ts_end - ts_start > 0 AND ts_end - ts_start <= 1800000)"
_TIMED = f"(unclassified_tokens = 0 AND (COALESCE(duration_ms > 0, FALSE) OR COALESCE({_SPAN}, FALSE)))"
_EFF = f"(CASE WHEN unclassified_tokens > 0 THEN 0 WHEN duration_ms > 0 THEN duration_ms WHEN {_SPAN} THEN ts_end - ts_start ELSE 0 END)"
_FIRST = "(unclassified_tokens = 0 AND ttft_ms > 0)"
_DECODING = f"(ttft_ms > 0 AND {_EFF} > ttft_ms)"


def _big(expr: str, name: str) -> str:
    return f"COALESCE(SUM({expr}), 0)::BIGINT AS {name}"


SPEED = ", ".join(
    _big(f"CASE WHEN {when} THEN {value} END", name)
    for name, when, value in (
        ("speed_in", _TIMED, "input_tokens"), ("speed_out", _TIMED, "output_tokens"), ("speed_ms", "TRUE", _EFF),
        ("speed_est_ms", f"(duration_ms IS NULL OR duration_ms <= 0) AND {_SPAN}", "ts_end - ts_start"), ("timed_events", _TIMED, "1"),
        ("prefill_in", _FIRST, "input_tokens"), ("ttft_ms", _FIRST, "ttft_ms"), ("ttft_events", _FIRST, "1"),
        ("decode_out", _DECODING, "output_tokens"), ("decode_ms", _DECODING, f"{_EFF} - ttft_ms"),
    )
)
SPEED_COLS = "speed_in, speed_out, speed_ms, speed_est_ms, timed_events, prefill_in, ttft_ms, ttft_events, decode_out, decode_ms"
MEASURES = ", ".join(
    [
        "COUNT(*)::BIGINT AS events",
        *(_big(c, c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "unclassified_tokens", "cache_read_tokens")),
        _big("cache_write_5m_tokens + cache_write_1h_tokens", "cache_write_tokens"),
        "ROUND(COALESCE(SUM(credits), 0), 8)::DOUBLE AS credits",
        "ROUND(COALESCE(SUM(cost_usd), 0), 8)::DOUBLE AS cost_usd",
        _big("active_ms", "active_ms"),
    ]
)
RATES = """ROUND(CASE WHEN speed_ms > 0 THEN speed_out / speed_ms * 1000.0 END, 8) AS output_tps, ROUND(CASE WHEN speed_ms > 0 THEN (speed_in + speed_out) / speed_ms * 1000.0 END, 8) AS total_tps,
 ROUND(CASE WHEN speed_ms > 0 THEN speed_in / speed_ms * 1000.0 END, 8) AS input_tps, ROUND(CASE WHEN ttft_ms > 0 THEN prefill_in / ttft_ms * 1000.0 END, 8) AS prefill_tps,
 ROUND(CASE WHEN decode_ms > 0 THEN decode_out / decode_ms * 1000.0 END, 8) AS decode_tps, ROUND(CASE WHEN ttft_events > 0 THEN ttft_ms / ttft_events END, 8) AS avg_ttft_ms,
 ROUND(CASE WHEN speed_ms > 0 THEN speed_est_ms / speed_ms ELSE 0 END, 8) AS est_ratio"""
DAY = f"((ts_start + {SHIFT}) // 86400000)"
DATE = f"strftime(DATE '1970-01-01' + {DAY}::INTEGER, '%Y-%m-%d')"
HOUR = f"(((ts_start + {SHIFT}) // 3600000) % 24)::INTEGER"
TODAY = (A + SHIFT) // 86_400_000
TOKENS = _big(HEAD, "tokens")
COST = "ROUND(COALESCE(SUM(cost_usd), 0), 8)::DOUBLE AS cost_usd"


def _per(secs: str) -> str:
    return f"""ROUND(total_tokens / {secs} * 60, 8) AS tokens_per_min, ROUND(total_tokens / {secs}, 8) AS tokens_per_sec, ROUND(input_tokens / {secs} * 60, 8) AS input_per_min,
 ROUND(output_tokens / {secs} * 60, 8) AS output_per_min, ROUND(cost_usd / {secs} * 3600, 8) AS cost_per_hour, ROUND(events / {secs} * 60, 8) AS requests_per_min"""


def led(select: str) -> str:
    return f"WITH {DUCK_LEDGER} {select}"


def _scope(low: int, high: int) -> str:
    return f"ts_start >= {low} AND ts_start < {high}"


_DAILY = f"SELECT {DATE} AS bucket, {MODEL} AS model, COUNT(*)::BIGINT AS events, {TOKENS}, {COST} FROM ledger WHERE ts_start IS NOT NULL GROUP BY 1, 2"
_TREND = f"SELECT bucket, SUM(events)::BIGINT AS events, SUM(tokens)::BIGINT AS tokens, ROUND(SUM(cost_usd), 8) AS cost_usd FROM b GROUP BY bucket"
_AVERAGE = """SELECT *, ROUND(SUM(tokens) OVER (ORDER BY pos RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) / LEAST(7, pos - MIN(pos) OVER () + 1), 8)::DOUBLE AS average
 FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(bucket AS DATE)) AS pos FROM t)"""
_CUBE = f"""SELECT {DAY}::INTEGER AS day, app, {MODEL} AS model, {MEASURES},
 COALESCE(SUM(CASE WHEN duration_ms > 0 THEN duration_ms WHEN {_SPAN} THEN ts_end - ts_start ELSE 0 END), 0)::BIGINT AS busy_ms, {SPEED} FROM ledger GROUP BY 1, 2, 3"""
_HEAT_FIRST = TODAY - (TODAY + 3) % 7 - 364
_MINUTES = f"COUNT(*)::BIGINT AS events, {', '.join(_big(c, c) for c in ('input_tokens', 'output_tokens', 'reasoning_tokens', 'unclassified_tokens', 'cache_read_tokens'))}"
_FIRST_MS = A - 3_600_000
_TIMELINE = f"""m AS (SELECT {_FIRST_MS} + (ts_start - {_FIRST_MS}) // 60000 * 60000 AS timestamp_ms, {MEASURES}, {_big(HEAD, 'total_tokens')} FROM ledger WHERE {_scope(_FIRST_MS, A)} GROUP BY 1),
 line AS (SELECT ({_FIRST_MS} + i * 60000)::BIGINT AS timestamp_ms, COALESCE(events, 0)::BIGINT AS events, COALESCE(input_tokens, 0)::BIGINT AS input_tokens,
 COALESCE(output_tokens, 0)::BIGINT AS output_tokens, COALESCE(reasoning_tokens, 0)::BIGINT AS reasoning_tokens, COALESCE(unclassified_tokens, 0)::BIGINT AS unclassified_tokens,
 COALESCE(cache_read_tokens, 0)::BIGINT AS cache_read_tokens, COALESCE(cache_write_tokens, 0)::BIGINT AS cache_write_tokens, COALESCE(credits, 0) AS credits,
 COALESCE(cost_usd, 0) AS cost_usd, COALESCE(active_ms, 0)::BIGINT AS active_ms, COALESCE(total_tokens, 0)::BIGINT AS total_tokens
 FROM range(60) r(i) LEFT JOIN m ON m.timestamp_ms = {_FIRST_MS} + i * 60000)"""
_COMPLETE = """((unclassified_tokens > 0)::INT + (input_tokens > 0)::INT + (output_tokens > 0)::INT + (reasoning_tokens > 0)::INT + (cache_read_tokens > 0)::INT
 + (cache_write_5m_tokens + cache_write_1h_tokens > 0)::INT + (cost_usd IS NOT NULL)::INT + (credits IS NOT NULL)::INT + (duration_ms IS NOT NULL)::INT)"""
_VALUES = "session_id, model, request_model, ts_start, ts_end, input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens, unclassified_tokens, credits, cost_usd, duration_ms, ttft_ms, active_ms"
_UPSERT = f"""u AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_COMPLETE} DESC, seq DESC) AS k, first(app) OVER (PARTITION BY dedup_key ORDER BY seq) AS first_app,
 {_COMPLETE} AS completeness FROM arrivals)"""
_ROLL = f"""SELECT {DATE} AS date, COALESCE(app, '') AS app, '' AS provider_id, COALESCE(request_model, '') AS request_model, COALESCE(pricing_model, '') AS pricing_model, COUNT(*)::BIGINT AS events,
 {', '.join(_big(c, c) for c in ('input_tokens', 'output_tokens', 'reasoning_tokens', 'cache_read_tokens', 'cache_write_5m_tokens', 'cache_write_1h_tokens', 'unclassified_tokens'))},
 ROUND(COALESCE(SUM(credits), 0), 8)::DOUBLE AS credits, {COST}, {_big('active_ms', 'active_ms')} FROM ledger WHERE ts_start IS NOT NULL"""
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app, account, window_kind ORDER BY captured_at DESC, id DESC) AS k FROM quotas) WHERE k = 1)"
#: The clock of the quota queries, inside the range of the orders' dates.
QUOTA_ANCHOR_MS = 880_000_000_000
_LIVE = f"(resets_at IS NULL OR resets_at >= {QUOTA_ANCHOR_MS})"
_ACT = f"act AS (SELECT {DATE} AS date, COUNT(*)::BIGINT AS events, {TOKENS}, {COST} FROM ledger WHERE {DAY} BETWEEN {TODAY - 364} AND {TODAY} GROUP BY 1)"
_SUNDAY = TODAY - (TODAY + 4) % 7 - 364

ORACLES = {
    "totals_all": led(f"SELECT {MEASURES}, {SPEED} FROM ledger"),
    "totals_range": led(f"SELECT {MEASURES}, {SPEED} FROM ledger WHERE {_scope(A - 7 * 86_400_000, A)}"),
    "totals_filtered": led(f"SELECT {MEASURES}, {SPEED} FROM ledger WHERE app IN ('claude', 'codex') AND {MODEL} IN ('alpha-1', 'alias-x', '?')"),
    "totals_empty_filter": led(f"SELECT {MEASURES}, {SPEED} FROM ledger WHERE FALSE"),
    "by_app": led(f"SELECT app, {MEASURES}, {TOKENS}, {SPEED} FROM ledger GROUP BY 1"),
    "by_model": led(f"SELECT {MODEL} AS name, {MEASURES}, {TOKENS}, {SPEED} FROM ledger GROUP BY 1"),
    "app_names": led("SELECT DISTINCT app FROM ledger"),
    "model_names": led(f"SELECT DISTINCT {MODEL} AS model FROM ledger WHERE app IN ('claude', 'codex')"),
    "event_count": led(f"SELECT COUNT(*) AS events FROM ledger WHERE {_scope(A - 7 * 86_400_000, A)}"),
    "unpriced_models": led(f"""SELECT {MODEL} AS name, COUNT(*) AS n FROM ledger WHERE pricing_model IS NULL AND COALESCE(NULLIF(model, ''), NULLIF(request_model, '')) IS NOT NULL
 AND ({HEAD} + cache_write_5m_tokens + cache_write_1h_tokens > 0 OR reasoning_tokens > 0) GROUP BY 1"""),
    "daily_by_app": led(f"SELECT {DATE} AS date, app, {MEASURES}, {TOKENS} FROM ledger WHERE ts_start IS NOT NULL GROUP BY 1, 2"),
    "hourly_by_app": led(f"SELECT lpad({HOUR}::VARCHAR, 2, '0') || ':00' AS hour, app, {MEASURES}, {TOKENS} FROM ledger WHERE ts_start IS NOT NULL GROUP BY 1, 2"),
    "activity_daily": led(f"SELECT {DATE} AS date, COUNT(*) AS events, {TOKENS}, {COST} FROM ledger WHERE {DAY} BETWEEN {TODAY - 364} AND {TODAY} GROUP BY 1"),
    "hour_histogram": led(f"SELECT {HOUR} AS hour, COUNT(*) AS events FROM ledger WHERE ts_start IS NOT NULL GROUP BY 1"),
    "today_hours": led(f"SELECT {HOUR} AS hour, app, {MODEL} AS model, {MEASURES}, {SPEED} FROM ledger WHERE {DAY} = {TODAY} GROUP BY 1, 2, 3"),
    "bucket_models": led(_DAILY),
    "trend_top_models": f"""WITH {DUCK_LEDGER}, b AS ({_DAILY}), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY tokens DESC, model) AS rank FROM b)
 SELECT bucket, rank::INTEGER AS rank, model, tokens FROM r WHERE rank <= 20""",
    "trend_moving_average": f"WITH {DUCK_LEDGER}, b AS ({_DAILY}), t AS ({_TREND}), a AS ({_AVERAGE}) SELECT bucket, events, tokens, cost_usd, average FROM a",
    "trend_drawn": f"WITH {DUCK_LEDGER}, b AS ({_DAILY}), t AS ({_TREND}), a AS ({_AVERAGE}) SELECT bucket, events, tokens, cost_usd, average FROM a ORDER BY bucket DESC LIMIT 60",
    "cube": led(_CUBE),
    "cube_overview_span": led(f"SELECT {MEASURES}, {SPEED}, COALESCE(SUM(CASE WHEN duration_ms > 0 THEN duration_ms WHEN {_SPAN} THEN ts_end - ts_start ELSE 0 END), 0)::BIGINT AS busy_ms FROM ledger WHERE {DAY} BETWEEN {TODAY - 6} AND {TODAY}"),
    "cube_refresh": led(_CUBE),
    "heatmap": led(f"""SELECT d::INTEGER AS day, strftime(DATE '1970-01-01' + d::INTEGER, '%Y-%m-%d') AS date, COALESCE(events, 0)::BIGINT AS events, COALESCE(tokens, 0)::BIGINT AS tokens,
 COALESCE(cost_usd, 0) AS cost_usd, COALESCE(busy_ms, 0)::BIGINT AS busy_ms FROM range({_HEAT_FIRST}, {TODAY + 1}) r(d) LEFT JOIN (SELECT {DAY} AS day, COUNT(*) AS events, {TOKENS}, {COST},
 SUM(CASE WHEN duration_ms > 0 THEN duration_ms WHEN {_SPAN} THEN ts_end - ts_start ELSE 0 END) AS busy_ms FROM ledger GROUP BY 1) x ON x.day = d"""),
    "speed_by_model": led(f"SELECT name, events, {SPEED_COLS}, {RATES} FROM (SELECT {MODEL} AS name, COUNT(*) AS events, {SPEED} FROM ledger GROUP BY 1)"),
    "speed_by_app": led(f"SELECT name, events, {SPEED_COLS}, {RATES} FROM (SELECT app AS name, COUNT(*) AS events, {SPEED} FROM ledger GROUP BY 1)"),
    "speed_page": led(f"SELECT name, events, {SPEED_COLS}, {RATES} FROM (SELECT {MODEL} AS name, COUNT(*) AS events, {SPEED} FROM ledger GROUP BY 1) ORDER BY decode_tps DESC NULLS LAST, name LIMIT 2 OFFSET 2"),
    "rate_windows": f"""WITH {DUCK_LEDGER}, w AS (SELECT * FROM (VALUES ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600), ('24h', 86400)) v("window", window_secs)),
 s AS (SELECT "window", window_secs::BIGINT AS window_secs, {MEASURES.replace('COUNT(*)', 'COUNT(dedup_key)')}, {_big(HEAD, 'total_tokens')}, {SPEED.replace('CASE WHEN TRUE', 'CASE WHEN dedup_key IS NOT NULL')}
 FROM w LEFT JOIN ledger ON ts_start >= {A} - window_secs * 1000 AND ts_start < {A} GROUP BY 1, 2)
 SELECT *, {_per('window_secs')}, {RATES} FROM s""",
    "rate_timeline": f"WITH {DUCK_LEDGER}, {_TIMELINE} SELECT *, {_per('60')}, strftime(make_timestamp(timestamp_ms * 1000), '%H:%M') AS label FROM line",
    "peak_minute_1h": f"WITH {DUCK_LEDGER}, {_TIMELINE} SELECT * REPLACE (CASE WHEN total_tokens > 0 THEN timestamp_ms END AS timestamp_ms), {_per('60')}, strftime(make_timestamp(timestamp_ms * 1000), '%H:%M') AS label FROM line ORDER BY total_tokens DESC, timestamp_ms LIMIT 1",
    "peak_minute_24h": f"""WITH {DUCK_LEDGER}, m AS (SELECT (ts_start // 60000 * 60000)::BIGINT AS timestamp_ms, {MEASURES}, {_big(HEAD, 'total_tokens')} FROM ledger WHERE {_scope(A - 86_400_000, A)} GROUP BY 1)
 SELECT *, {_per('60')} FROM m ORDER BY input_tokens + output_tokens + cache_read_tokens DESC, timestamp_ms LIMIT 1""",
    **{
        name: f"""WITH {DUCK_LEDGER}, h AS (SELECT * FROM ledger WHERE {_scope(_FIRST_MS, A)}), s AS (SELECT {keys}, COUNT(*) AS events, {_big(HEAD, 'total_tokens')}, {COST}, {SPEED} FROM h GROUP BY {group})
 SELECT *, ROUND(total_tokens / (SELECT SUM({HEAD}) FROM h) * 100, 8)::DOUBLE AS percentage, ROUND(total_tokens / 60, 8) AS tokens_per_min, ROUND(total_tokens / 3600, 8) AS tokens_per_sec, {RATES} FROM s
 ORDER BY total_tokens DESC, {order} LIMIT 10"""
        for name, keys, group, order in (("top_models_1h", f"{MODEL} AS model, app", "1, 2", "model, app"), ("top_apps_1h", "app", "1", "app"))
    },
    "activity_status": led(f"SELECT MAX(ts_start) AS latest_event_ms, COALESCE(ABS({A} - MAX(ts_start)) <= 300000, FALSE) AS is_active FROM ledger"),
    "rollups_full": led(f"{_ROLL} GROUP BY 1, 2, 3, 4, 5"),
    "rollups_partial": led(f"{_ROLL} AND {DAY} IN ({TODAY}, {TODAY - 1}, {TODAY - 9}) GROUP BY 1, 2, 3, 4, 5"),
    "events_page": led(f"SELECT dedup_key, app, {MODEL} AS model, ts_start, {HEAD} AS tokens FROM ledger ORDER BY ts_start DESC NULLS LAST, dedup_key LIMIT 100 OFFSET 200"),
    "export_rows": led("""SELECT dedup_key, app, ts_start, printf('%.4f', cost_usd + 0.00000000001) AS cost_usd FROM ledger"""),
    "billable_gate": led(f"""SELECT app, COUNT(*) AS events FROM ledger WHERE unclassified_tokens > 0 OR input_tokens > 0 OR output_tokens > 0 OR reasoning_tokens > 0 OR cache_read_tokens > 0
 OR cache_write_5m_tokens + cache_write_1h_tokens > 0 OR credits > 0 OR cost_usd > 0 OR (app = 'cursor' AND ts_start IS NOT NULL) GROUP BY 1"""),
    "upsert_final": f"WITH {DUCK_ARRIVALS}, {_UPSERT} SELECT dedup_key, first_app AS app, {_VALUES}, completeness, seq FROM u WHERE k = 1",
    "upsert_outcome": f"""WITH {DUCK_ARRIVALS}, s AS (SELECT * FROM ledger WHERE event_id % 2 = 0), i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_COMPLETE} DESC, seq DESC) AS k, {_COMPLETE} AS c FROM arrivals) WHERE k = 1),
 j AS (SELECT i.dedup_key, i.ts_start, CASE WHEN s.dedup_key IS NULL THEN TRUE ELSE i.c >= {_COMPLETE.replace('(unclassified_tokens', '(s.unclassified_tokens').replace('(input_tokens', '(s.input_tokens').replace('(output_tokens', '(s.output_tokens').replace('(reasoning_tokens', '(s.reasoning_tokens').replace('(cache_read_tokens', '(s.cache_read_tokens').replace('cache_write_5m_tokens + cache_write_1h_tokens', 's.cache_write_5m_tokens + s.cache_write_1h_tokens').replace('cost_usd', 's.cost_usd').replace('credits', 's.credits').replace('(duration_ms', '(s.duration_ms')}
 AND (i.output_tokens, COALESCE(i.credits, -1), COALESCE(i.duration_ms, -1)) <> (s.output_tokens, COALESCE(s.credits, -1), COALESCE(s.duration_ms, -1)) END AS written FROM i LEFT JOIN s USING (dedup_key))
 SELECT {DATE} AS date, COUNT(*) FILTER (WHERE written) AS written, COUNT(*) FILTER (WHERE NOT written) AS merged, BOOL_OR(written AND ts_start IS NULL) AS needs_full_rollup FROM j GROUP BY 1""",
    "archive_split": led(f"SELECT CASE WHEN ts_start < {A - 10 * 86_400_000} THEN 'cold' ELSE 'kept' END AS part, COUNT(*) AS events, {TOKENS} FROM ledger GROUP BY 1"),
    "retention": led(f"SELECT app, COUNT(*) AS events FROM ledger WHERE ts_start IS NULL OR ts_start >= {A - 10 * 86_400_000} GROUP BY 1"),
    "replace_by_key": f"""WITH {DUCK_ARRIVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY seq DESC) AS k FROM arrivals) SELECT dedup_key, app, {_VALUES}, seq FROM r WHERE k = 1""",
    "quotas_latest": f"WITH {DUCK_QUOTAS}, {_LATEST} SELECT id, app, account, window_kind, captured_at, used, used_percent, resets_at FROM latest",
    "quotas_ranked": f"""WITH {DUCK_QUOTAS}, {_LATEST} SELECT row_number() OVER (ORDER BY {_LIVE} DESC, used_percent DESC NULLS LAST, app, id)::INTEGER AS rank, id, app, used_percent, {_LIVE} AS live FROM latest""",
    "quotas_groups": f"WITH {DUCK_QUOTAS}, {_LATEST} SELECT app, MAX(used_percent) FILTER (WHERE {_LIVE}) AS worst_pct, BOOL_OR({_LIVE}) AS live, COUNT(*) AS windows FROM latest GROUP BY 1",
    "quotas_changed_only": f"""WITH {DUCK_QUOTAS}, p AS (SELECT *, lag(id) OVER w AS before, lag(used) OVER w AS u, lag(used_percent) OVER w AS p, lag(resets_at) OVER w AS r FROM quotas
 WINDOW w AS (PARTITION BY app, account, window_kind ORDER BY captured_at, id)) SELECT id, app, account, window_kind, used, used_percent, resets_at FROM p
 WHERE before IS NULL OR used IS DISTINCT FROM u OR used_percent IS DISTINCT FROM p OR resets_at IS DISTINCT FROM r""",
    "quotas_pruned": f"""WITH {DUCK_QUOTAS}, m AS (SELECT *, MAX(id) OVER (PARTITION BY app, account, window_kind) AS last FROM quotas) SELECT id, app, account, window_kind, captured_at FROM m
 WHERE captured_at >= {QUOTA_ANCHOR_MS - 30 * 86_400_000} OR id = last""",
    "active_streaks": f"""WITH {DUCK_LEDGER}, {_ACT}, g AS (SELECT CAST(date AS DATE) AS d, CAST(date AS DATE) - row_number() OVER (ORDER BY date)::INTEGER AS island FROM act WHERE tokens > 0)
 SELECT strftime(MIN(d), '%Y-%m-%d') AS first_date, strftime(MAX(d), '%Y-%m-%d') AS last_date, COUNT(*) AS days FROM g GROUP BY island""",
    "calendar_weeks": f"""WITH {DUCK_LEDGER}, {_ACT} SELECT ((date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) - {_SUNDAY}) // 7)::INTEGER AS week, SUM(tokens)::BIGINT AS tokens, SUM(events)::BIGINT AS events FROM act
 WHERE date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) >= {_SUNDAY} GROUP BY 1""",
    "calendar_cumulative": f"WITH {DUCK_LEDGER}, {_ACT} SELECT date, tokens, SUM(tokens) OVER (ORDER BY date)::BIGINT AS cumulative FROM act",
    "calendar_intensity": f"""WITH {DUCK_LEDGER}, {_ACT} SELECT date, tokens, (CASE WHEN tokens <= 0 THEN 0 WHEN tokens <= .25 * m THEN 1 WHEN tokens <= .5 * m THEN 2 WHEN tokens <= .75 * m THEN 3 ELSE 4 END)::INTEGER AS level
 FROM act, (SELECT MAX(tokens) AS m FROM act)""",
    "calendar_stats": f"""WITH {DUCK_LEDGER}, {_ACT}, w AS (SELECT (date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) - {_SUNDAY}) // 7 AS week, SUM(tokens) AS t FROM act
 WHERE date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) >= {_SUNDAY} GROUP BY 1)
 SELECT COUNT(*) FILTER (WHERE tokens > 0) AS active_days, MAX(tokens)::BIGINT AS max_day, SUM(tokens)::BIGINT AS total, (SELECT MAX(t) FROM w)::BIGINT AS max_week FROM act""",
    "receipt": led(f"""SELECT ROUND(CASE WHEN SUM(input_tokens + cache_read_tokens) > 0 THEN SUM(cache_read_tokens) / SUM(input_tokens + cache_read_tokens) * 100 ELSE 0 END, 8)::DOUBLE AS cache_hit_pct,
 ROUND(CASE WHEN SUM({HEAD}) > 0 THEN SUM(cost_usd) / SUM({HEAD}) * 1e6 ELSE 0 END, 8)::DOUBLE AS usd_per_million,
 (SELECT ROUND(MAX(t) / SUM(t) * 100, 8)::DOUBLE FROM (SELECT SUM({HEAD}) AS t FROM ledger GROUP BY app)) AS top_app_pct, (SELECT GREATEST(COUNT(DISTINCT {MODEL}) - 6, 0)::BIGINT FROM ledger) AS hidden_lines FROM ledger"""),
    "pie_slices": led(f"""SELECT name, tokens, ROUND(tokens / SUM(tokens) OVER () * 100, 8)::DOUBLE AS percentage FROM (SELECT {MODEL} AS name, {TOKENS} FROM ledger GROUP BY 1) QUALIFY tokens > 0.0001 AND tokens / SUM(tokens) OVER () >= 0.0001"""),
    "shares_top_k": led(f"""SELECT name, SUM(tokens)::BIGINT AS tokens FROM (SELECT CASE WHEN row_number() OVER (ORDER BY tokens DESC, name) <= 4 THEN name ELSE 'others' END AS name, tokens
 FROM (SELECT {MODEL} AS name, {TOKENS} FROM ledger GROUP BY 1) WHERE tokens > 0) GROUP BY 1 HAVING SUM(tokens) > 0"""),
    "model_series": f"""WITH {DUCK_LEDGER}, b AS ({_DAILY}), m AS (SELECT model FROM b GROUP BY 1 ORDER BY SUM(tokens) DESC, model LIMIT 4), d AS (SELECT DISTINCT bucket FROM b)
 SELECT bucket, model, COALESCE(tokens, 0)::BIGINT AS tokens FROM d CROSS JOIN m LEFT JOIN b USING (bucket, model)""",
    "model_keys": f"""WITH {DUCK_QUOTES}, r AS (SELECT DISTINCT CASE WHEN model_id LIKE '%.1' THEN 'Vendor/' || UPPER(model_id) || ':free' ELSE model_id || '@2026[1m]' END AS raw FROM quotes),
 k AS (SELECT raw, regexp_replace(lower(replace(split_part(regexp_extract(raw, '([^/]*)$', 1), ':', 1), '@', '-')), '\\[1m\\]$', '') AS model_key FROM r)
 SELECT raw, model_key, regexp_replace(model_key, '([0-9])\\.([0-9])', '\\1-\\2', 'g') AS canon_key FROM k""",
    "event_cost": led("""SELECT dedup_key, round((input_tokens * (CASE WHEN long_ THEN 6.0 ELSE 3.0 END) + output_tokens * (CASE WHEN long_ THEN 22.5 ELSE 15.0 END) + cache_read_tokens * 0.3
 + cache_write_5m_tokens * 3.75 + cache_write_1h_tokens * 6.0) / 1000000.0, 9) AS usd FROM (SELECT *, input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens > 50000 AS long_ FROM ledger)"""),
    "price_freshness": f"WITH {DUCK_QUOTES} SELECT MAX(CASE WHEN source <> 'seed' THEN {A} - 1000 * length(source) END)::BIGINT AS live_at, FALSE AS stale FROM quotes",
    "asof_model": """WITH c AS (SELECT DISTINCT conv_id, turn, 'm' || ((conv_id + turn) % 4)::VARCHAR AS model FROM conversations WHERE turn % 3 = 1)
 SELECT t.conv_id, t.turn, t.role, c.model FROM conversations t ASOF LEFT JOIN c ON t.conv_id = c.conv_id AND t.turn >= c.turn""",
    "trace_coverage": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, epoch_us(l_shipdate::TIMESTAMP) // 1000 AS ts, l_quantity::BIGINT AS q FROM lineitem),
 t AS (SELECT o AS trace_id, CASE WHEN o % 50 <> 0 THEN 's' || o::VARCHAR END AS session_id, MIN(ts) AS start_ms, MAX(ts) AS end_ms, CASE WHEN o % 100 = 0 THEN 'm' || o::VARCHAR END AS model, SUM(q)::BIGINT AS total FROM l GROUP BY o),
 e AS (SELECT 's' || o::VARCHAR AS session_id, 'm' || o::VARCHAR AS model, ts, q FROM l WHERE n % 2 = 0 AND o % 3 <> 0 AND o % 50 <> 0),
 m AS (SELECT trace_id, q FROM t JOIN e ON t.session_id = e.session_id AND ts BETWEEN start_ms AND end_ms
 UNION ALL SELECT trace_id, q FROM t JOIN e ON t.session_id IS NULL AND ts BETWEEN start_ms AND end_ms AND (t.model IS NULL OR t.model = e.model)),
 c AS (SELECT trace_id, COUNT(*) AS n, SUM(q) AS q FROM m GROUP BY 1),
 b AS (SELECT t.*, COALESCE(n, 0) AS n, COALESCE(q, 0) AS q, COALESCE(q, 0) = 0 AND total >= 2 AS split FROM t LEFT JOIN c USING (trace_id))
 SELECT trace_id, session_id, model, start_ms, end_ms, (CASE WHEN split THEN total - 2 ELSE 0 END)::BIGINT AS input_tokens, (CASE WHEN split THEN 1 ELSE 0 END)::BIGINT AS output_tokens,
 (CASE WHEN split THEN 1 ELSE 0 END)::BIGINT AS cache_read_tokens, (CASE WHEN split THEN 0 ELSE GREATEST(total - q, 0) END)::BIGINT AS unclassified_tokens
 FROM b WHERE NOT (n > 0 AND (session_id IS NULL OR q >= total)) AND total > 0""",
    "reconcile_totals": led(f"""SELECT *, ROUND(ABS(our_cache_read_tokens - their_cache_read_tokens) / their_cache_read_tokens * 100, 8) AS cache_read_tokens_off_pct,
 ROUND(ABS(our_output_tokens - their_output_tokens) / their_output_tokens * 100, 8) AS output_tokens_off_pct, ROUND(ABS(our_cost_usd - their_cost_usd) / their_cost_usd * 100, 8) AS cost_usd_off_pct
 FROM (SELECT {_big('cache_read_tokens', 'our_cache_read_tokens')}, {_big('output_tokens', 'our_output_tokens')}, ROUND(SUM(cost_usd), 8) AS our_cost_usd,
 {_big('CASE WHEN event_id % 50 <> 0 THEN cache_read_tokens END', 'their_cache_read_tokens')}, {_big('CASE WHEN event_id % 50 <> 0 THEN output_tokens END', 'their_output_tokens')},
 ROUND(SUM(CASE WHEN event_id % 50 <> 0 THEN cost_usd END), 8) AS their_cost_usd FROM ledger)"""),
    "reconcile_watermarks": """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS p FROM orders), b AS (SELECT CASE WHEN k % 7 <> 0 THEN p END AS ours, CASE WHEN k % 5 <> 0 AND p + k % 3 > 0 THEN p + k % 3 END AS theirs FROM o),
 s AS (SELECT COUNT(*) FILTER (WHERE ours IS NOT NULL AND theirs IS NOT NULL) AS joined, SUM(ours) FILTER (WHERE theirs IS NOT NULL)::BIGINT AS our_tokens, SUM(theirs) FILTER (WHERE ours IS NOT NULL)::BIGINT AS their_tokens,
 COUNT(*) FILTER (WHERE ours IS NOT NULL AND theirs IS NULL) AS only_ours, COUNT(*) FILTER (WHERE ours IS NULL AND theirs IS NOT NULL) AS only_theirs FROM b)
 SELECT *, ROUND(ABS(our_tokens - their_tokens) / their_tokens * 100, 8) AS off_pct FROM s""",
    "source_health": led("""SELECT app AS source, MAX(ts_start) AS last_synced_at, COUNT(*) AS rows_ingested, CASE WHEN app <> 'cursor' THEN COUNT(DISTINCT session_id) ELSE 0 END AS tracked_files FROM ledger GROUP BY 1"""),
}
