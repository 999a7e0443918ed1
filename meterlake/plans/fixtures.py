"""Ledger tables derived from the given tables by one text in two SQL dialects, so every query has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-30 12:00 UTC, the clock of every query.
ANCHOR_MS = 1_706_616_000_000
OFFSET = "+08:00"

_LEDGER = """
SELECT *, input_tokens * 3e-6 + output_tokens * 15e-6 + cache_read_tokens * 0.3e-6 AS cost_usd FROM (
SELECT CONCAT('ev:', CAST(event_id AS {STRING})) AS dedup_key, event_id,
 CASE event_type WHEN 'click' THEN 'claude' WHEN 'view' THEN 'codex' WHEN 'purchase' THEN 'opencode' WHEN 'signup' THEN 'zcode' ELSE 'cursor' END AS app,
 CONCAT('s', CAST(user_id AS {STRING})) AS session_id,
 CASE event_id % 6 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'beta-2' WHEN 2 THEN 'gamma-3' WHEN 3 THEN '' WHEN 5 THEN 'delta-4' END AS model,
 CASE WHEN event_id % 12 IN (3, 4) THEN 'alias-x' END AS request_model, CAST(NULL AS {STRING}) AS pricing_model,
 CASE WHEN event_id % 101 <> 0 THEN ms END AS ts_start,
 CASE WHEN event_id % 101 <> 0 AND event_id % 3 = 0 THEN ms + (event_id * 37) % 4000000 END AS ts_end,
 cents AS input_tokens, k * 7 AS output_tokens, k AS reasoning_tokens, cents * (event_id % 4) AS cache_read_tokens,
 event_id % 50 AS cache_write_5m_tokens, event_id % 20 AS cache_write_1h_tokens,
 CASE WHEN event_id % 211 = 0 THEN 1000 ELSE 0 END AS unclassified_tokens,
 CASE WHEN event_id % 13 = 0 THEN k / CAST(10 AS DOUBLE) END AS credits,
 CASE WHEN event_id % 4 <> 0 THEN (event_id % 90) * 100 END AS duration_ms,
 CASE WHEN event_id % 5 = 0 THEN 50 + event_id % 700 END AS ttft_ms,
 CASE WHEN event_id % 7 <> 0 THEN event_id % 9000 END AS active_ms
FROM (SELECT event_id, user_id, event_type, {ms} AS ms, CAST(ROUND(value * 100) AS BIGINT) AS cents, CAST({k} AS BIGINT) AS k FROM events))
"""
#: Several revisions of each row: poor, full, poor again, full again.
_ARRIVALS = """
SELECT *, 0 AS seq FROM (SELECT * REPLACE_POOR FROM ledger)
UNION ALL SELECT *, 1 FROM ledger WHERE event_id % 3 = 0
UNION ALL SELECT *, 2 FROM (SELECT * REPLACE_POOR FROM ledger) WHERE event_id % 9 = 0
UNION ALL SELECT *, 3 FROM ledger WHERE event_id % 15 = 0
"""
_QUOTES = """
SELECT CASE p_partkey % 10 WHEN 0 THEN 'portkey' WHEN 1 THEN 'langfuse' WHEN 2 THEN 'llm-prices' WHEN 3 THEN 'openrouter' WHEN 4 THEN 'vercel'
 WHEN 5 THEN 'models.dev' WHEN 6 THEN 'helicone' WHEN 7 THEN 'litellm' WHEN 8 THEN 'llmpricing' ELSE 'seed' END AS source,
 CONCAT('m-', CAST(grp AS {STRING}), CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '-1' END) AS model_id,
 base * jit AS input, base * jit * 5 AS output, CASE WHEN p_size % 2 = 0 THEN base * jit / 10 END AS cache_read, CAST(NULL AS DOUBLE) AS cache_write
FROM (SELECT p_partkey, p_size, grp, CAST(grp % 40 + 1 AS DOUBLE) AS base, CAST(CASE p_size % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.2 WHEN 3 THEN 1.02 ELSE 1.0 END AS DOUBLE) AS jit
 FROM (SELECT *, {tenth} AS grp FROM part))
"""
_QUOTAS = """
SELECT o_orderkey AS id, o_orderpriority AS app, CASE WHEN o_custkey % 5 <> 0 THEN CONCAT('acct-', CAST(o_custkey % 7 AS {STRING})) END AS account,
 CASE o_orderstatus WHEN 'O' THEN '5h_block' WHEN 'F' THEN 'weekly' ELSE 'credits' END AS window_kind, {order_ms} AS captured_at, CAST(o_totalprice AS DOUBLE) AS used,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS used_percent, CASE WHEN o_orderkey % 3 <> 0 THEN {order_ms} + 18000000 END AS resets_at
FROM orders
"""
_SPARK = {
    "STRING": "STRING", "ms": "unix_millis(CAST(ts AS TIMESTAMP))", "k": "get_json_object(props, '$.k')", "tenth": "(p_partkey div 10)",
    "order_ms": "unix_millis(CAST(o_orderdate AS TIMESTAMP))",
}
_DUCK = {
    "STRING": "VARCHAR", "ms": "(epoch_us(ts) // 1000)", "k": "json_extract_string(props, '$.k')", "tenth": "(p_partkey // 10)",
    "order_ms": "(epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000)",
}


def _filled(text: str, words: dict[str, str]) -> str:
    for name, value in words.items():
        text = text.replace("{" + name + "}", value)
    return text


def _table(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_filled(text, _SPARK).replace(f"FROM {name}", "FROM {source}"), source=source)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", _LEDGER)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    full = ledger(spark, sf_dir)
    none = lambda c: F.lit(None).cast(dict(full.dtypes)[c])
    poor = full.withColumns({"output_tokens": F.lit(0).cast("bigint"), "credits": none("credits"), "duration_ms": none("duration_ms")})
    parts = [(poor, 1), (full, 3), (poor, 9), (full, 15)]
    out = None
    for seq, (rows, every) in enumerate(parts):
        part = rows.where(F.col("event_id") % every == 0).withColumn("seq", F.lit(seq))
        out = part if out is None else out.unionByName(part)
    return out


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", _QUOTES)


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", _QUOTAS)


_POOR = "REPLACE (CAST(0 AS BIGINT) AS output_tokens, CAST(NULL AS DOUBLE) AS credits, CAST(NULL AS BIGINT) AS duration_ms)"
DUCK_LEDGER = f"ledger AS MATERIALIZED ({_filled(_LEDGER, _DUCK)})"
DUCK_ARRIVALS = f"{DUCK_LEDGER}, arrivals AS MATERIALIZED ({_ARRIVALS.replace('REPLACE_POOR', _POOR)})"
DUCK_QUOTES = f"quotes AS MATERIALIZED ({_filled(_QUOTES, _DUCK)})"
DUCK_QUOTAS = f"quotas AS MATERIALIZED ({_filled(_QUOTAS, _DUCK)})"
