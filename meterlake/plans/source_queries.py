"""Queries of the normalizers: logs, vendor tables, telemetry and feeds are written out from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.plans.fixtures import ANCHOR_MS, DUCK_LEDGER, DUCK_QUOTES, ledger, quotes
from meterlake.sources import feeds, logs, tables, telemetry

_SHOWN = (
    "dedup_key app session_id project model ts_start ts_end input_tokens output_tokens reasoning_tokens cache_read_tokens cache_write_5m_tokens cache_write_1h_tokens cost_usd duration_ms".split()
)


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _j(**values: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def _lines(df: DataFrame, path: Column, *lines: Column) -> DataFrame:
    """A file of lines for each row; a line's offset is its place."""
    made = df.select(path.alias("path"), F.posexplode(F.array(*(F.to_json(x) for x in lines))).alias("n", "line"))
    return made.select("path", (F.col("n") * 100).cast("long").alias("line_offset"), "line")


def _file(kind: str) -> Column:
    return F.concat(F.lit(f"/logs/{kind}/"), "session_id", F.lit("/rollout-"), F.col("event_id").cast("string"), F.lit(".jsonl"))


def shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN).withColumn("cost_usd", F.round("cost_usd", 8))


def claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    usage = lambda out: _j(input_tokens=c("input_tokens"), output_tokens=out, output_tokens_details=_j(thinking_tokens=c("reasoning_tokens")), cache_read_input_tokens=c("cache_read_tokens"), cache_creation=_j(ephemeral_5m_input_tokens=c("cache_write_5m_tokens"), ephemeral_1h_input_tokens=c("cache_write_1h_tokens")))
    said = lambda out: _j(type=F.lit("assistant"), timestamp=_iso(c("ts_start")), sessionId=c("session_id"), cwd=F.lit("/w"), message=_j(id=F.concat(F.lit("m"), c("event_id").cast("string")), model=c("model"), usage=usage(out)))
    raw = _lines(rows, _file("claude"), _j(type=F.lit("user"), timestamp=_iso(c("ts_start") - 5000)), said(F.lit(0)), said(c("output_tokens")), _j(type=F.lit("summary")))
    return shown(logs.normalize_claude(raw))


def codex_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    five = _j(input_tokens=c("input_tokens") + c("cache_read_tokens"), cached_input_tokens=c("cache_read_tokens"), output_tokens=c("output_tokens"), reasoning_output_tokens=c("reasoning_tokens"))
    at = lambda back: _iso(c("ts_start") - back)
    counted = _j(type=F.lit("event_msg"), timestamp=at(0), payload=_j(type=F.lit("token_count"), info=_j(last_token_usage=five, total_token_usage=five)))
    return _lines(
        rows, _file("codex"), _j(type=F.lit("turn_context"), payload=_j(model=c("model"), cwd=F.lit("/w"))),
        _j(type=F.lit("response_item"), timestamp=at(3000), payload=_j(type=F.lit("message"), role=F.lit("user"))),
        _j(type=F.lit("response_item"), timestamp=at(1000), payload=_j(type=F.lit("message"), role=F.lit("assistant"))), counted, counted,
    )


def codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(logs.normalize_codex(codex_log(spark, sf_dir)))


def grok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    use = _j(inputTokens=c("input_tokens") + c("cache_read_tokens"), cachedReadTokens=c("cache_read_tokens"), outputTokens=c("output_tokens"), reasoningTokens=c("reasoning_tokens"), costUsdTicks=c("event_id") * 1000)
    models = F.when(c("event_id") % 2 == 0, F.create_map(F.lit("g-1"), use, F.lit("g-2"), use))
    usage = F.struct(*(use[k].alias(k) for k in ("inputTokens", "cachedReadTokens", "outputTokens", "reasoningTokens", "costUsdTicks")), models.alias("modelUsage"))
    update = _j(sessionUpdate=F.lit("turn_completed"), prompt_id=F.concat(F.lit("p"), c("event_id").cast("string")), elapsed_ms=F.lit(700), usage=usage)
    raw = _lines(rows, _file("grok"), _j(method=F.lit("session/update"), timestamp=c("ts_start"), params=_j(sessionId=c("session_id"), update=update)), _j(method=F.lit("other")))
    return shown(logs.normalize_grok(raw))


def kimi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    folder = F.when(c("event_id") % 2 == 0, F.concat(F.lit("/w/"), c("session_id")))
    usage = _j(inputOther=c("input_tokens"), output=c("output_tokens"), inputCacheRead=c("cache_read_tokens"), inputCacheCreation=c("cache_write_5m_tokens"))
    raw = _lines(rows, _file("kimi"), _j(type=F.lit("config.update"), cwd=folder), _j(type=F.lit("usage.record"), time=c("ts_start"), model=c("model"), usage=usage))
    index = rows.select(c("session_id").alias("sessionId"), F.concat(F.lit("/i/"), c("session_id")).alias("workDir")).distinct()
    return shown(logs.normalize_kimi(raw, index))


def workbuddy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    usage = _j(prompt_tokens=c("input_tokens") + c("cache_read_tokens"), completion_tokens=c("output_tokens"), prompt_cache_hit_tokens=c("cache_read_tokens"), cached_tokens=F.lit(0), completion_thinking_tokens=c("reasoning_tokens"), credit=c("credits"))
    said = _j(timestamp=c("ts_start"), providerData=_j(messageId=F.concat(F.lit("w"), c("event_id").cast("string")), model=c("model"), requestModelName=c("request_model"), rawUsage=usage))
    return shown(logs.normalize_workbuddy(_lines(rows, _file("workbuddy"), said, _j(type=F.lit("other")))))


def opencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    data = F.to_json(_j(role=F.lit("assistant"), modelID=c("model"), time=_j(created=c("ts_start"), completed=c("ts_start") + 900), cost=c("cost_usd"), tokens=_j(input=c("input_tokens"), output=c("output_tokens") - c("reasoning_tokens"), reasoning=c("reasoning_tokens"), cache=_j(read=c("cache_read_tokens"), write=c("cache_write_5m_tokens")))))
    messages = rows.select(F.concat(F.lit("o"), c("event_id").cast("string")).alias("id"), "session_id", data.alias("data"), c("ts_start").alias("time_created"), c("ts_end").alias("time_updated"), "event_id")
    sessions = rows.select(c("session_id").alias("id"), F.lit("/w").alias("directory")).distinct()
    old, new = messages.where("event_id % 3 <> 0").drop("event_id"), messages.where("event_id % 2 = 0").drop("event_id")
    return shown(tables.normalize_opencode(new, old, sessions, sessions))


def minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    seconds = F.when(c("event_id") % 2 == 0, F.floor(c("ts_start") / 1000)).otherwise(c("ts_start"))
    usage = rows.select(c("event_id").alias("id"), "session_id", "model", seconds.alias("ts"), "input_tokens", "output_tokens", "cache_read_tokens", c("cache_write_5m_tokens").alias("cache_write_tokens"), (-c("reasoning_tokens")).alias("reasoning_tokens"), "cost_usd")
    sessions = rows.select("session_id", F.lit(None).cast("string").alias("project_workspace_dir"), F.lit("/m").alias("workspace_dir")).distinct()
    return shown(tables.normalize_minimax(usage, sessions, "main", ANCHOR_MS))


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    value = F.to_json(_j(type=c("event_id") % 3, createdAt=_iso(c("ts_start")), modelInfo=_j(modelName=c("model"))))
    kv = rows.select(c("event_id").alias("rowid"), F.concat_ws(":", F.lit("bubbleId"), "session_id", c("event_id").cast("string")).alias("key"), value.alias("value"))
    return shown(tables.normalize_cursor(kv))


def otlp_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir).where("ts_start IS NOT NULL"), F.col
    text = lambda k, v: _j(key=F.lit(k), value=_j(stringValue=v))
    point = _j(attributes=F.array(text("type", c("app")), text("session.id", c("session_id")), text("a", F.lit("1"))), asInt=c("event_id").cast("string"), timeUnixNano=F.concat(c("ts_start").cast("string"), F.lit("000000")))
    doc = F.to_json(_j(resourceMetrics=F.array(_j(scopeMetrics=F.array(_j(metrics=F.array(_j(name=F.lit("token.usage"), sum=_j(dataPoints=F.array(point))))))))))
    points = telemetry.otlp_points(rows.select(doc.alias("doc")))
    return telemetry.latest_points(None, points.withColumn("seq", c("value")))


def feed_openrouter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    item = lambda i: _j(id=i, pricing=_j(prompt=(c("input") / 1e6).cast("string"), completion=(c("output") / 1e6).cast("string"), input_cache_read=(c("cache_read") / 1e6).cast("string")))
    rows = quotes(spark, sf_dir).withColumn("doc", F.to_json(_j(data=F.array(item(F.concat(F.lit("Vendor/"), c("source"), F.lit("-"), c("model_id"))), item(F.concat("model_id", F.lit(":free")))))))
    out = feeds.parse_openrouter(rows.select("doc"), ANCHOR_MS)
    return out.select("source", "model_id", *(F.round(x, 6).alias(x) for x in ("input", "output", "cache_read")), "fetched_at")


QUERIES = {
    "normalize_claude": claude, "normalize_codex": codex, "normalize_grok": grok, "normalize_kimi": kimi, "normalize_workbuddy": workbuddy, "normalize_opencode": opencode,
    "normalize_minimax": minimax, "normalize_cursor": cursor, "otlp_latest": otlp_latest, "feed_openrouter": feed_openrouter,
}

_E = "event_id::VARCHAR"
_NAME = "NULLIF(model, '')"


def _oracle(where: str = "TRUE", **values: str) -> str:
    base = {
        "app": "''", "session_id": "session_id", "project": "NULL::VARCHAR", "model": _NAME, "ts_start": "ts_start", "ts_end": "NULL::BIGINT", "input_tokens": "input_tokens",
        "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_tokens", "cache_read_tokens": "cache_read_tokens", "cache_write_5m_tokens": "0::BIGINT", "cache_write_1h_tokens": "0::BIGINT",
        "cost_usd": "NULL::DOUBLE", "duration_ms": "NULL::BIGINT",
    }
    return f"WITH {DUCK_LEDGER} SELECT {', '.join(f'{v} AS {k}' for k, v in (base | values).items())} FROM ledger WHERE {where}"


_GROK = {"app": "'grok'", "ts_end": "ts_start + 700", "cost_usd": "ROUND(event_id * 1000 / 1e9, 8)", "duration_ms": "700::BIGINT"}
ORACLES = {
    "normalize_claude": _oracle(dedup_key=f"'claude:m' || {_E}", app="'claude'", project="'/w'", cache_write_5m_tokens="cache_write_5m_tokens", cache_write_1h_tokens="cache_write_1h_tokens", duration_ms="CASE WHEN ts_start IS NOT NULL THEN 5000::BIGINT END"),
    "normalize_codex": _oracle("input_tokens + output_tokens + cache_read_tokens + reasoning_tokens > 0", dedup_key=f"'codex:rollout-' || {_E} || ':300'", app="'codex'", session_id=_E, project="'/w'", duration_ms="CASE WHEN ts_start IS NOT NULL THEN 2000::BIGINT END"),
    "normalize_grok": _oracle("event_id % 2 <> 0", dedup_key=f"'grok:' || session_id || ':p' || {_E}", model="NULL::VARCHAR", **_GROK)
    + "".join(" UNION ALL " + _oracle("event_id % 2 = 0", dedup_key=f"'grok:' || session_id || ':p' || {_E} || ':{m}'", model=f"'{m}'", **_GROK).split(f"WITH {DUCK_LEDGER} ")[1] for m in ("g-1", "g-2")),
    "normalize_kimi": _oracle("input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens > 0", dedup_key=f"'kimi_code:/logs/kimi/' || session_id || '/rollout-' || {_E} || '.jsonl:100'", app="'kimi_code'", project="CASE WHEN event_id % 2 = 0 THEN '/w/' ELSE '/i/' END || session_id", reasoning_tokens="0::BIGINT", cache_write_5m_tokens="cache_write_5m_tokens"),
    "normalize_workbuddy": _oracle(dedup_key=f"'workbuddy:w' || {_E}", app="'workbuddy'", session_id=f"'rollout-' || {_E}"),
    "normalize_opencode": _oracle("event_id % 3 <> 0 OR event_id % 2 = 0", dedup_key=f"'opencode:o' || {_E}", app="'opencode'", project="'/w'", ts_end="ts_start + 900", cache_write_5m_tokens="cache_write_5m_tokens", cost_usd="CASE WHEN cost_usd > 0 THEN ROUND(cost_usd, 8) END", duration_ms="CASE WHEN ts_start IS NOT NULL THEN 900::BIGINT END"),
    "normalize_minimax": _oracle(
        "input_tokens + output_tokens + cache_read_tokens + cache_write_5m_tokens > 0", dedup_key=f"'minimax:main:' || {_E}", app="'minimax_code'", project="'/m'", reasoning_tokens="0::BIGINT",
        ts_start=f"CASE WHEN ts_start <= {ANCHOR_MS + 86_400_000} THEN CASE WHEN event_id % 2 = 0 THEN ts_start // 1000 * 1000 ELSE ts_start END END", cache_write_5m_tokens="cache_write_5m_tokens",
        cost_usd="CASE WHEN cost_usd > 0 THEN ROUND(cost_usd, 8) END",
    ),
    "normalize_cursor": _oracle("event_id % 3 = 1", dedup_key=f"'cursor:' || session_id || ':' || {_E}", app="'cursor'", **{f"{c}_tokens": "0::BIGINT" for c in ("input", "output", "reasoning", "cache_read")}),
    "otlp_latest": f"""WITH {DUCK_LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, app ORDER BY ts_start DESC, event_id DESC) AS k FROM ledger WHERE ts_start IS NOT NULL)
 SELECT 'token.usage' AS metric, session_id, 'a=1,type=' || app AS attr_sig, ts_start AS ts_ms, event_id::DOUBLE AS value FROM r WHERE k = 1""",
    "feed_openrouter": f"""WITH {DUCK_QUOTES} SELECT 'openrouter' AS source, lower(source || '-' || model_id) AS model_id, ROUND(input, 6) AS input, ROUND(output, 6) AS output, ROUND(cache_read, 6) AS cache_read,
 {ANCHOR_MS}::BIGINT AS fetched_at FROM quotes""",
}
