"""Normalizers of line logs: (path, line_offset, line) in, ledger rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.joins import carry_forward
from meterlake.sources.lines import any_ms, count, ledger_rows, parsed, raw_ref, stem, text

TICKS_PER_USD = 1e9

_CLAUDE = """type STRING, isSidechain BOOLEAN, timestamp STRING, sessionId STRING, cwd STRING, durationMs STRING, message STRUCT<id: STRING, model: STRING, stop_reason: STRING,
 usage: STRUCT<input_tokens: STRING, output_tokens: STRING, output_tokens_details: STRUCT<thinking_tokens: STRING>, cache_read_input_tokens: STRING, cache_creation_input_tokens: STRING,
 cache_creation: STRUCT<ephemeral_5m_input_tokens: STRING, ephemeral_1h_input_tokens: STRING>>>"""


def normalize_claude(raw: DataFrame) -> DataFrame:
    """Assistant lines, the last line of each message id; durations run from the user's line before the id's first line."""
    lines = parsed(raw, _CLAUDE).where("v.type IN ('user', 'assistant')").withColumn("side", F.coalesce("v.isSidechain", F.lit(False))).withColumn("ts", any_ms("v.timestamp"))
    asked = carry_forward(F.when(F.col("v.type") == "user", F.col("ts")), ["path", "side"], ["line_offset"])
    said = lines.withColumn("asked", asked).where("v.type = 'assistant' AND v.message.id IS NOT NULL")
    own = Window.partitionBy("path", "v.message.id")
    said = said.withColumns({"start": F.first("asked").over(own.orderBy("line_offset")), "last": F.row_number().over(own.orderBy(F.desc("line_offset")))}).where("last = 1")
    usage = lambda c: F.col(f"v.message.usage.{c}")
    split = usage("cache_creation").isNotNull()
    five = F.when(split, count(usage("cache_creation.ephemeral_5m_input_tokens"))).otherwise(count(usage("cache_creation_input_tokens")))
    return ledger_rows(
        said, dedup_key=F.concat(F.lit("claude:"), "v.message.id"), app="claude", session_id=text("v.sessionId"), project=text("v.cwd"),
        model=text("v.message.model"), request_model=text("v.message.model"), ts_start=F.col("ts"), input_tokens=count(usage("input_tokens")),
        output_tokens=count(usage("output_tokens")), reasoning_tokens=count(usage("output_tokens_details.thinking_tokens")), cache_read_tokens=count(usage("cache_read_input_tokens")),
        cache_write_5m_tokens=five, cache_write_1h_tokens=F.when(split, count(usage("cache_creation.ephemeral_1h_input_tokens"))),
        duration_ms=F.coalesce(F.col("v.durationMs").try_cast("bigint"), E.derived_duration(F.col("start"), F.col("ts"))), status=F.col("v.message.stop_reason"),
        provenance="local_jsonl", raw_ref=raw_ref(),
    )


_FIVE = "STRUCT<input_tokens: STRING, cached_input_tokens: STRING, cache_write_input_tokens: STRING, output_tokens: STRING, reasoning_output_tokens: STRING>"
_WINDOW = "STRUCT<used_percent: DOUBLE, window_minutes: BIGINT, resets_at: STRING, resets_in_seconds: BIGINT>"
_CODEX = f"""type STRING, timestamp STRING, payload STRUCT<type: STRING, role: STRING, model: STRING, cwd: STRING, info: STRUCT<last_token_usage: {_FIVE}, total_token_usage: {_FIVE}>,
 rate_limits: STRUCT<primary: {_WINDOW}, secondary: {_WINDOW}, plan_type: STRING, credits: STRUCT<has_credits: BOOLEAN, balance: STRING>>>"""


def _codex_lines(raw: DataFrame) -> DataFrame:
    return parsed(raw, _CODEX).withColumn("ts", any_ms("v.timestamp"))


def codex_steps(raw: DataFrame) -> DataFrame:
    """(path, line_offset, kind, ts, model, cwd, own) of the lines that matter to calls.

    kind: asked, tool, spoke, counted or turn (model and folder); own has the ten counters of a token_count.
    """
    lines = _codex_lines(raw)
    kind = (
        F.when(F.col("v.type") == "turn_context", "turn").when(F.col("v.type") == "token_usage_record", "spoke")
        .when(F.col("v.type") == "response_item", F.when(F.col("v.payload.type").isin("custom_tool_call_output", "function_call_output"), "tool")
              .when((F.col("v.payload.type") == "message") & (F.col("v.payload.role") == "user"), "asked")
              .when((F.col("v.payload.type") == "message") & (F.col("v.payload.role") == "developer"), "none").otherwise("spoke"))
        .when((F.col("v.type") == "event_msg") & (F.col("v.payload.type") == "task_started"), "asked")
        .when((F.col("v.type") == "event_msg") & (F.col("v.payload.type") == "token_count"), "counted")
    )
    five = lambda block: [count(f"v.payload.info.{block}.{c}") for c in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")]
    turn = lambda c: F.when(F.col("kind") == "turn", text(f"v.payload.{c}"))
    own = F.when(F.col("kind") == "counted", F.array(*five("last_token_usage"), *five("total_token_usage")))
    lines = lines.withColumn("kind", kind).where("kind <> 'none'")
    return lines.select("path", "line_offset", "kind", "ts", turn("model").alias("model"), turn("cwd").alias("cwd"), own.alias("own"))


def _codex_calls(steps: DataFrame) -> DataFrame:
    """(path, line_offset, ts, model, cwd, own, call_start, call_end) of counted calls, from whole files.

    What was asked and each counted call begin a stretch of lines. In it the model has spoken from its first output line
    on: a tool's result before that restarts the call, one after it starts the next. So a stretch is summed up by one
    aggregation, and a call needs its own stretch and the one before.
    """
    by_file = Window.partitionBy("path").orderBy("line_offset")
    latest = lambda c: F.last(c, ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("own", ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    used = sum((F.col("own")[i] for i in range(5)), F.lit(0))
    lines = steps.withColumns({"model": latest("model"), "cwd": latest("cwd"), "before": before})
    counted = F.coalesce((F.col("kind") == "counted") & ~F.col("own").eqNullSafe(F.col("before")) & (used > 0), F.lit(False))
    lines = lines.withColumn("counted", counted).withColumn("asked", (F.col("kind") == "asked") & F.col("ts").isNotNull())
    number = F.sum(F.col("asked").cast("int") + F.col("counted").cast("int")).over(by_file) - F.col("counted").cast("int")  # a counted call ends its stretch
    spoke = F.when((F.col("kind") == "spoke") & F.col("ts").isNotNull(), F.col("line_offset"))
    lines = lines.withColumn("stretch", number).withColumn("spoke", F.min(spoke).over(Window.partitionBy("path", "stretch")))
    tool = (F.col("kind") == "tool") & F.col("ts").isNotNull()
    after = F.coalesce(F.col("line_offset") > F.col("spoke"), F.lit(False))
    last_ts = lambda when: F.max_by(F.when(when, F.col("ts")), F.when(when, F.col("line_offset")))
    sums = lines.groupBy("path", "stretch").agg(
        F.max(F.when(F.col("asked"), F.col("ts"))).alias("asked"),
        last_ts(tool & ~after).alias("restarted"),
        last_ts(tool & after).alias("staged"),
        last_ts((F.col("kind") == "spoke") & F.col("ts").isNotNull()).alias("done"),
        F.max(F.when(F.col("counted"), F.struct("line_offset", "ts", "model", "cwd", "own"))).alias("call"),
    )
    following = Window.partitionBy("path").orderBy("stretch")
    carried = F.coalesce(F.lag("staged").over(following), F.lag("call.ts").over(following))
    spans = sums.withColumn("call_start", F.coalesce("restarted", "asked", carried)).where("call IS NOT NULL")
    return spans.select("path", "call.*", "call_start", F.coalesce("done", "call.ts").alias("call_end"))


def codex_rows(calls: DataFrame) -> DataFrame:
    """Ledger rows of (path, line_offset, ts, model, cwd, own, call_start, call_end)."""
    name = stem(F.col("path"))
    return ledger_rows(
        calls, dedup_key=F.concat(F.lit("codex:"), name, F.lit(":"), F.col("line_offset").cast("string")), app="codex", session_id=F.regexp_replace(name, "^(rollout-)+", ""),
        project=F.col("cwd"), model=F.col("model"), request_model=F.col("model"), ts_start=F.col("ts"), duration_ms=E.derived_duration(F.col("call_start"), F.col("call_end")),
        input_tokens=E.minus_cache(F.col("own")[0], F.col("own")[1], F.col("own")[2]), output_tokens=F.col("own")[3], reasoning_tokens=F.col("own")[4],
        cache_read_tokens=F.col("own")[1], cache_write_5m_tokens=F.col("own")[2], provenance="local_jsonl", raw_ref=raw_ref(),
    )


def normalize_codex(raw: DataFrame) -> DataFrame:
    """token_count lines whose counts differ from the token_count before; model and folder are those of the latest turn."""
    return codex_rows(_codex_calls(codex_steps(raw)))


def window_kind(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "window").when(minutes <= 360, "5h_block").when(minutes <= 1500, "daily").when(minutes <= 11000, "weekly").otherwise("monthly")


def codex_quotas(raw: DataFrame) -> DataFrame:
    """Rate limits in token_count lines, where the first window's share or reset changes; a balance is a row of credits."""
    lines = _codex_lines(raw).where("v.payload.type = 'token_count' AND v.payload.rate_limits IS NOT NULL")
    limits = F.col("v.payload.rate_limits")

    def window(name: str) -> Column:
        w = limits[name]
        return F.when(w["used_percent"].isNotNull(), F.struct(window_kind(w["window_minutes"]).alias("window_kind"), w["used_percent"].alias("used_percent"), any_ms(w["resets_at"]).alias("resets_at"), F.lit(None).cast("double").alias("used")))

    none = F.lit(None).cast("double")
    credits = F.when(limits["credits"]["balance"].try_cast("double").isNotNull(), F.struct(F.lit("credits").alias("window_kind"), none.alias("used_percent"), F.lit(None).cast("bigint").alias("resets_at"), limits["credits"]["balance"].try_cast("double").alias("used")))
    windows = F.filter(F.array(window("primary"), window("secondary"), credits), lambda w: w.isNotNull())
    main = F.col("windows")[0]
    first = F.struct(F.coalesce(main["used_percent"], F.lit(-1.0)).alias("a"), F.coalesce(main["resets_at"], F.lit(0)).alias("b"))
    # the windows are listed once, and only what is compared and shown is shuffled
    some = lines.select("path", "line_offset", "ts", F.explode(F.array(windows)).alias("windows")).where(F.size("windows") > 0).withColumn("sig", first)
    before = F.lag("sig").over(Window.partitionBy("path").orderBy("line_offset"))
    changed = some.withColumn("before", before).where(~F.col("sig").eqNullSafe(F.col("before")))
    return changed.select(F.lit("codex").alias("app"), F.lit(None).cast("string").alias("account"), F.col("ts").alias("captured_at"), F.explode("windows").alias("w")).select("app", "account", "captured_at", "w.*")


_GROK_USE = "inputTokens: STRING, cachedReadTokens: STRING, cacheCreationTokens: STRING, outputTokens: STRING, reasoningTokens: STRING, costUsdTicks: STRING, apiDurationMs: STRING"
_GROK = f"""method STRING, timestamp STRING, params STRUCT<sessionId: STRING, update: STRUCT<sessionUpdate: STRING, prompt_id: STRING, elapsed_ms: BIGINT,
 usage: STRUCT<{_GROK_USE}, modelUsage: MAP<STRING, STRUCT<{_GROK_USE}>>>>>"""


def normalize_grok(raw: DataFrame) -> DataFrame:
    """Completed turns: a row for each model used, or one for the turn."""
    turns = parsed(raw, _GROK, 'session/update"').where("v.method IN ('session/update', '_x.ai/session/update') AND v.params.update.sessionUpdate = 'turn_completed' AND v.params.update.usage IS NOT NULL")
    usage = F.col("v.params.update.usage")
    whole = F.struct(F.lit(None).cast("string").alias("key"), F.struct(*(usage[c.split(":")[0].strip()].alias(c.split(":")[0].strip()) for c in _GROK_USE.split(","))).alias("value"))
    each = F.transform(F.map_entries(usage["modelUsage"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    turns = turns.withColumn("u", F.explode(F.when(F.size(usage["modelUsage"]) > 0, each).otherwise(F.array(whole))))
    session = F.coalesce(text("v.params.sessionId"), F.element_at(F.split("path", "/"), -2))
    prompt = F.coalesce(text("v.params.update.prompt_id"), F.col("line_offset").cast("string"))
    use = lambda c: count(f"u.value.{c}")
    ts, elapsed = any_ms("v.timestamp"), F.col("v.params.update.elapsed_ms")
    ticks = F.col("u.value.costUsdTicks").try_cast("double")
    return ledger_rows(
        turns, dedup_key=F.concat_ws(":", F.lit("grok"), session, prompt, F.col("u.key")), app="grok", session_id=session, model=F.col("u.key"), request_model=F.col("u.key"),
        ts_start=ts, ts_end=ts + elapsed, input_tokens=E.minus_cache(use("inputTokens"), use("cachedReadTokens"), use("cacheCreationTokens")), output_tokens=use("outputTokens"),
        reasoning_tokens=use("reasoningTokens"), cache_read_tokens=use("cachedReadTokens"), cache_write_5m_tokens=use("cacheCreationTokens"), cost_usd=ticks / TICKS_PER_USD,
        cost_source=F.when(ticks.isNotNull(), "provider_reported"), duration_ms=elapsed, active_ms=F.col("u.value.apiDurationMs").try_cast("bigint"), provenance="local_jsonl", raw_ref=raw_ref(),
    )


_RAW_USAGE = """timestamp STRING, providerData STRUCT<messageId: STRING, model: STRING, requestModelId: STRING, requestModelName: STRING, rawUsage: STRUCT<prompt_tokens: STRING, completion_tokens: STRING,
 credit: STRING, cache_read_input_tokens: STRING, prompt_cache_hit_tokens: STRING, cached_tokens: STRING, prompt_tokens_details: STRUCT<cached_tokens: STRING>, cache_creation_input_tokens: STRING,
 prompt_cache_write_tokens: STRING, completion_tokens_details: STRUCT<reasoning_tokens: STRING>, completion_thinking_tokens: STRING>>"""


def normalize_raw_usage(raw: DataFrame, app: str, prefix: str) -> DataFrame:
    """Records with a provider's raw usage, whose cache and reasoning counts have several spellings."""
    lines = parsed(raw, _RAW_USAGE, "rawUsage").where("v.providerData.rawUsage IS NOT NULL")
    use = lambda c: count(f"v.providerData.rawUsage.{c}")
    read = F.greatest(*map(use, ("cache_read_input_tokens", "prompt_cache_hit_tokens", "cached_tokens", "prompt_tokens_details.cached_tokens")))
    write = F.greatest(use("cache_creation_input_tokens"), use("prompt_cache_write_tokens"))
    own = F.coalesce(text("v.providerData.messageId"), F.concat("path", F.lit("@"), F.col("line_offset").cast("string")))
    return ledger_rows(
        lines, dedup_key=F.concat(F.lit(f"{prefix}:"), own), app=app, session_id=stem(F.col("path")), model=text("v.providerData.model"),
        request_model=F.coalesce(text("v.providerData.requestModelId"), text("v.providerData.requestModelName")), ts_start=any_ms("v.timestamp"),
        input_tokens=E.minus_cache(use("prompt_tokens"), read, write), output_tokens=use("completion_tokens"),
        reasoning_tokens=F.greatest(use("completion_tokens_details.reasoning_tokens"), use("completion_thinking_tokens")), cache_read_tokens=read, cache_write_5m_tokens=write,
        credits=F.col("v.providerData.rawUsage.credit").try_cast("double"), provenance="local_jsonl", raw_ref=raw_ref(),
    )


def normalize_workbuddy(raw: DataFrame) -> DataFrame:
    return normalize_raw_usage(raw, "workbuddy", "workbuddy")


def normalize_codebuddy_cli(raw: DataFrame) -> DataFrame:
    return normalize_raw_usage(raw, "codebuddy_cli", "codebuddy_cli")


_KIMI = "type STRING, time STRING, model STRING, cwd STRING, usage STRUCT<inputOther: STRING, output: STRING, inputCacheRead: STRING, inputCacheCreation: STRING>"


def normalize_kimi(raw: DataFrame, index: DataFrame) -> DataFrame:
    """usage.record lines; the project is the file's first configured folder, else that of the session index."""
    lines = parsed(raw, _KIMI).withColumn("session", F.element_at(F.split("path", "/"), -2))
    first = F.first(F.when(F.col("v.type") == "config.update", text("v.cwd")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = index.select(F.col("sessionId").alias("session"), F.col("workDir").alias("_dir"))
    used = lines.withColumn("project", first).where("v.type = 'usage.record' AND v.usage IS NOT NULL").join(known, "session", "left")
    use = lambda c: count(f"v.usage.{c}")
    used = used.where(use("inputOther") + use("output") + use("inputCacheRead") + use("inputCacheCreation") > 0)
    return ledger_rows(
        used, dedup_key=F.concat(F.lit("kimi_code:"), "path", F.lit(":"), F.col("line_offset").cast("string")), app="kimi_code", session_id=F.col("session"), project=F.coalesce("project", "_dir"),
        model=text("v.model"), request_model=text("v.model"), ts_start=any_ms("v.time"), input_tokens=use("inputOther"), output_tokens=use("output"), cache_read_tokens=use("inputCacheRead"),
        cache_write_5m_tokens=use("inputCacheCreation"), provenance="local_jsonl", raw_ref=raw_ref(),
    )


_COMMAND = """type STRING, id STRING, timestamp STRING, cwd STRING, model STRING, message STRUCT<role: STRING>,
 usage STRUCT<inputTokens: STRING, outputTokens: STRING, cacheReadTokens: STRING, cacheWriteTokens: STRING, cacheWriteTokens1h: STRING, costUsd: STRING>"""


def normalize_commandcode(raw: DataFrame) -> DataFrame:
    """Assistant messages; the hourly cache write is at most the whole, the rest is the short one; the header's folder wins over the path's."""
    lines = parsed(raw, _COMMAND)
    every = Window.partitionBy("path").orderBy("line_offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cwd = F.coalesce(F.first(text("v.cwd"), ignorenulls=True).over(every), F.element_at(F.split("path", "/"), -2))
    said = lines.withColumn("cwd", cwd).where("v.message.role = 'assistant' AND v.usage IS NOT NULL")
    use = lambda c: count(f"v.usage.{c}")
    hour = F.least(use("cacheWriteTokens1h"), use("cacheWriteTokens"))
    cost = F.col("v.usage.costUsd").try_cast("double")
    own = F.coalesce(text("v.id"), F.concat("path", F.lit("@"), F.col("line_offset").cast("string")))
    return ledger_rows(
        said, dedup_key=F.concat(F.lit("commandcode:"), own), app="commandcode", session_id=stem(F.col("path")), project=F.col("cwd"), model=text("v.model"), request_model=text("v.model"),
        ts_start=any_ms("v.timestamp"), input_tokens=use("inputTokens"), output_tokens=use("outputTokens"), cache_read_tokens=use("cacheReadTokens"), cache_write_1h_tokens=hour,
        cache_write_5m_tokens=use("cacheWriteTokens") - hour, cost_usd=F.when(cost > 0, cost), cost_source=F.when(cost > 0, "provider_reported"), provenance="local_jsonl", raw_ref=raw_ref(),
    )


_QODER = """type STRING, timestamp STRING, uuid STRING, cwd STRING, sessionId STRING, directories ARRAY<STRING>, message STRUCT<id: STRING, model: STRING, stop_reason: STRING, usage: STRUCT<billable: BOOLEAN,
 input_tokens: STRING, cache_read_input_tokens: STRING, cache_creation_input_tokens: STRING, output_tokens: STRING, credits: STRING, original_credits: STRING, request_id: STRING>>"""


def normalize_qoder(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Billable assistant lines; the key is the first id that is there, the model goes through the vendor's (name, target) aliases."""
    lines = parsed(raw, _QODER).withColumn("ts", any_ms("v.timestamp"))
    asked = carry_forward(F.when(F.col("v.type") == "user", F.col("ts")), ["path"], ["line_offset"])
    said = lines.withColumn("asked", asked).where("v.type = 'assistant' AND v.message.usage IS NOT NULL AND v.message.usage.billable IS NOT FALSE")
    names = aliases.select(F.col("name").alias("_name"), F.col("target").alias("_target"))
    said = said.join(names, F.col("v.message.model") == F.col("_name"), "left")
    use = lambda c: count(f"v.message.usage.{c}")
    own = F.coalesce(text("v.message.usage.request_id"), text("v.message.id"), text("v.uuid"), F.concat("path", F.lit("@"), F.col("line_offset").cast("string")))
    credits = F.coalesce(F.col("v.message.usage.credits").try_cast("double"), F.col("v.message.usage.original_credits").try_cast("double"))
    return ledger_rows(
        said, dedup_key=F.concat(F.lit("qoder:"), own), app="qoder", session_id=text("v.sessionId"), project=F.coalesce(text("v.cwd"), text(F.get("v.directories", 0))),
        model=F.coalesce("_target", text("v.message.model")), request_model=text("v.message.model"), ts_start=F.col("ts"), input_tokens=use("input_tokens"), output_tokens=use("output_tokens"),
        cache_read_tokens=use("cache_read_input_tokens"), cache_write_5m_tokens=use("cache_creation_input_tokens"), credits=credits,
        duration_ms=E.derived_duration(F.col("asked"), F.col("ts")), status=F.col("v.message.stop_reason"), provenance="local_jsonl", raw_ref=raw_ref(),
    )


_DSH = """seq BIGINT, type STRING, time STRING, data STRUCT<turn: STRING, step: STRING, usage: STRUCT<input_tokens: STRING, output_tokens: STRING, cache_read_tokens: STRING, reasoning_tokens: STRING>,
 message: STRUCT<source: STRUCT<provider: STRING, model: STRING>>, header: STRUCT<config: STRUCT<provider: STRING, model: STRING>>>"""


def normalize_dsh(raw: DataFrame, after_seq: int = -1) -> DataFrame:
    """assistant/message rows with usage; calls begin at their step's first start, names come from the message or the latest header."""
    lines = parsed(raw, _DSH).withColumn("ts", any_ms("v.time"))
    header = lambda c: carry_forward(text(f"v.data.header.config.{c}"), ["path"], ["line_offset"])
    step = Window.partitionBy("path", "v.data.turn", "v.data.step")
    start = F.min(F.when(F.col("v.type") == "step/start", F.col("ts"))).over(step)
    said = lines.withColumns({"h_model": header("model"), "h_provider": header("provider"), "start": start})
    said = said.where("v.type = 'assistant/message' AND v.data.usage IS NOT NULL").where(F.col("v.seq") > after_seq)
    use = lambda c: count(f"v.data.usage.{c}")
    model = F.coalesce(text("v.data.message.source.model"), "h_model")
    session = stem(F.col("path"))
    return ledger_rows(
        said, dedup_key=F.concat_ws(":", F.lit("dsh"), session, F.col("v.seq").cast("string")), app="dsh", session_id=session, provider_id=F.coalesce(text("v.data.message.source.provider"), "h_provider"),
        model=model, request_model=model, ts_start=F.coalesce("start", "ts"), ts_end=F.col("ts"), duration_ms=E.derived_duration(F.col("start"), F.col("ts")),
        input_tokens=E.minus_cache(use("input_tokens"), use("cache_read_tokens")), output_tokens=use("output_tokens"), reasoning_tokens=use("reasoning_tokens"),
        cache_read_tokens=use("cache_read_tokens"), provenance="local_jsonl", raw_ref=raw_ref(),
    )
