"""The fact row of the ledger and the price row, and the constants that every operator depends on."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_MS = 86_400_000
MINUTE_MS = 60_000
#: A span between two timestamps counts as a duration up to here; longer gaps hold idle time.
MAX_DERIVED_DURATION_MS = 1_800_000

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "unclassified_tokens")

_STRINGS_FIRST = ("dedup_key", "app", "session_id", "project", "account_id", "provider_id", "model", "request_model", "pricing_model")
LEDGER_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _STRINGS_FIRST]
    + [T.StructField(c, T.LongType()) for c in ("ts_start", "ts_end", *TOKEN_COLUMNS)]
    + [T.StructField("credits", T.DoubleType()), T.StructField("cost_usd", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("cost_source", "provenance")]
    + [T.StructField(c, T.LongType()) for c in ("duration_ms", "ttft_ms", "active_ms")]
    + [T.StructField(c, T.StringType()) for c in ("status", "error", "raw_ref")]
    + [T.StructField("completeness", T.IntegerType())]
)
PRICE_COLUMNS = ("input", "output", "cache_read", "cache_write", "tier_above_200k_input", "tier_1h_cache_write", "tier_batch", "tier_above_200k_output", "tier_above_200k_cache_read")
