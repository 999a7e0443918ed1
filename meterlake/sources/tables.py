"""Normalizers of exported vendor tables: ledger rows from DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.joins import new_era_first
from meterlake.sources.lines import any_ms, count, ledger_rows, text

#: Timestamps before 2020 are seconds that were taken for milliseconds.
YEAR_2020_MS = 1_577_836_800_000
#: Dollars that one credit of the IDE's list price costs.
KIRO_CREDIT_USD = 0.04


def _json(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def normalize_opencode(v2: DataFrame, v1: DataFrame, sessions_v2: DataFrame, sessions_v1: DataFrame) -> DataFrame:
    """Assistant messages of the newer tables, and those of the older ones that the newer lack, each with its session's folder."""
    columns = ["id", "session_id", "data", "time_created", "time_updated", "directory"]
    with_session = lambda m, s: m.join(s.select(F.col("id").alias("_sid"), "directory"), F.col("session_id") == F.col("_sid")).select(*columns)
    rows = new_era_first(with_session(v2, sessions_v2), with_session(v1, sessions_v1), "id").where(_json("data", "role") == "assistant")
    cost = _json("data", "cost").try_cast("double")
    reasoning = count(_json("data", "tokens.reasoning"))
    start, end = any_ms(_json("data", "time.created")), any_ms(_json("data", "time.completed"))
    return ledger_rows(
        rows, dedup_key=F.concat(F.lit("opencode:"), "id"), app="opencode", session_id=F.col("session_id"), project=text("directory"), provider_id=text(_json("data", "providerID")),
        model=text(_json("data", "modelID")), request_model=text(_json("data", "modelID")), ts_start=F.coalesce(start, F.col("time_created")), ts_end=end,
        input_tokens=count(_json("data", "tokens.input")), output_tokens=count(_json("data", "tokens.output")) + reasoning, reasoning_tokens=reasoning,
        cache_read_tokens=count(_json("data", "tokens.cache.read")), cache_write_5m_tokens=count(_json("data", "tokens.cache.write")), cost_usd=F.when(cost > 0, cost),
        cost_source=F.when(cost > 0, "provider_reported"), duration_ms=E.derived_duration(start, end), provenance="vendor_db", raw_ref=F.concat(F.lit("opencode#"), "id"),
    )


def normalize_zcode(usage: DataFrame) -> DataFrame:
    """Finished rows of the vendor's own provider; whether the input holds the cached part follows from the totals, else from the provider."""
    done = usage.where("status <> 'running'").where(~F.lower("provider_id").rlike("anthropic|openai"))
    read, write = count("cache_read_tokens"), count("cache_write_tokens")
    given, out = count("input_tokens"), count("output_tokens")
    whole = F.col("provider_total_tokens").try_cast("bigint") if "provider_total_tokens" in usage.columns else F.lit(None).cast("bigint")
    inclusive = (
        F.when(read + write == 0, F.lit(False)).when(whole == given + out, F.lit(True)).when(whole == given + read + write + out, F.lit(False))
        .when(given < read + write, F.lit(False)).otherwise(F.lit(True))
    )
    return ledger_rows(
        done, dedup_key=F.concat_ws(":", F.lit("zcode"), F.col("logical_request_id"), F.col("attempt_index").cast("string")), app="zcode", session_id=F.col("session_id"),
        provider_id=F.ltrim(F.element_at(F.split("provider_id", ":"), -1)), model=text("model_id"), request_model=text("model_id"), ts_start=any_ms(F.col("started_at").cast("string")),
        ts_end=any_ms(F.col("completed_at").cast("string")), input_tokens=F.when(inclusive, E.minus_cache(given, read, write)).otherwise(given), output_tokens=out,
        reasoning_tokens=count("reasoning_tokens"), cache_read_tokens=read, cache_write_5m_tokens=write, duration_ms=F.col("duration_ms"), ttft_ms=F.col("time_to_first_token_ms"),
        status=F.col("status"), error=text("error_type"), provenance="vendor_db", raw_ref=F.concat(F.lit("zcode#"), F.col("rowid").cast("string")),
    )


def normalize_minimax(usage: DataFrame, sessions: DataFrame, profile: str, anchor_ms: int) -> DataFrame:
    """Usage with its session's folder; seconds become milliseconds, times beyond the clock null, negative counts 0; empty rows go."""
    folders = sessions.select("session_id", F.coalesce(text("project_workspace_dir"), text("workspace_dir")).alias("folder"))
    ms = F.when(F.col("ts") < YEAR_2020_MS // 1000, None).when(F.col("ts") < YEAR_2020_MS, F.col("ts") * 1000).otherwise(F.col("ts"))
    ms = F.when(ms <= anchor_ms + 86_400_000, ms)
    parts = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
    rows = usage.join(folders, "session_id", "left").where(sum((count(c) for c in parts), F.lit(0)) > 0)
    cost = F.col("cost_usd").try_cast("double")
    return ledger_rows(
        rows, dedup_key=F.concat_ws(":", F.lit("minimax"), F.lit(profile), F.col("id").cast("string")), app="minimax_code", session_id=F.col("session_id"), project=F.col("folder"),
        model=text("model"), request_model=text("model"), ts_start=ms, input_tokens=count("input_tokens"), output_tokens=count("output_tokens"), reasoning_tokens=count("reasoning_tokens"),
        cache_read_tokens=count("cache_read_tokens"), cache_write_5m_tokens=count("cache_write_tokens"), cost_usd=F.when(cost > 0, cost), cost_source=F.when(cost > 0, "provider_reported"),
        provenance="vendor_db", raw_ref=F.concat(F.lit(f"{profile}#"), F.col("id").cast("string")),
    )


def normalize_devin(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant nodes with usage; the session's model fills in, but never for the compactor. Snapshots of a request share its key."""
    known = sessions.select(F.col("id").alias("_sid"), F.col("model").alias("_model"), "working_directory")
    rows = nodes.where((_json("chat_message", "role") == "assistant") & _json("chat_message", "usage").isNotNull()).join(known, F.col("session_id") == F.col("_sid"), "left")
    own = text(_json("chat_message", "model"))
    model = F.when(F.coalesce(own, F.lit("")) == "compactor", own).otherwise(F.coalesce(own, text("_model")))
    request = F.coalesce(text(_json("chat_message", "request_id")), F.col("row_id").cast("string"))
    use = lambda c: count(_json("chat_message", f"usage.{c}"))
    return ledger_rows(
        rows, dedup_key=F.concat_ws(":", F.lit("devin"), "session_id", request), app="devin", session_id=F.col("session_id"), project=text("working_directory"), model=model, request_model=own,
        ts_start=any_ms(_json("chat_message", "created_at")), input_tokens=use("input_tokens"), output_tokens=use("output_tokens"), cache_read_tokens=use("cache_read_tokens"),
        cache_write_5m_tokens=use("cache_write_tokens"), provenance="vendor_db", raw_ref=F.concat(F.lit("devin#"), F.col("row_id").cast("string")),
    )


def normalize_cursor(kv: DataFrame) -> DataFrame:
    """User turns of the editor's bubbles, as rows without tokens."""
    rows = kv.where(F.col("key").startswith("bubbleId:") & (_json("value", "type") == "1"))
    part = lambda i: F.get(F.split("key", ":"), i)
    return ledger_rows(
        rows, dedup_key=F.concat_ws(":", F.lit("cursor"), part(1), part(2)), app="cursor", session_id=part(1), model=text(_json("value", "modelInfo.modelName")),
        ts_start=any_ms(_json("value", "createdAt")), provenance="vendor_db", raw_ref=F.concat(F.lit("cursor#"), F.col("rowid").cast("string")),
    )


def normalize_freebuff(messages: DataFrame, threads: DataFrame, handles: DataFrame) -> DataFrame:
    """Messages with a total above 0; the thread's catalog handle becomes a model through a (name, target) table."""
    known = threads.select(F.col("id").alias("_tid"), F.col("model").alias("_handle"))
    names = handles.select(F.col("name").alias("_name"), F.col("target").alias("_target"))
    rows = messages.join(known, F.col("thread_id") == F.col("_tid"), "left").join(names, F.col("_handle") == F.col("_name"), "left")
    use = lambda c: count(_json("metrics_json", c))
    rows = rows.where(use("inputTokens") + use("outputTokens") + use("cacheReadTokens") > 0)
    return ledger_rows(
        rows, dedup_key=F.concat_ws(":", F.lit("freebuff"), "thread_id", F.col("seq").cast("string")), app="freebuff", session_id=F.col("thread_id"), model=F.coalesce("_target", text("_handle")),
        request_model=text("_handle"), ts_start=F.col("ts"), input_tokens=use("inputTokens"), output_tokens=use("outputTokens"), reasoning_tokens=F.least(use("reasoningTokens"), use("outputTokens")),
        cache_read_tokens=use("cacheReadTokens"), provenance="vendor_db", raw_ref=F.concat(F.lit("freebuff#"), F.col("seq").cast("string")),
    )


def freebuff_daily_spend(receipts: DataFrame, anchor_ms: int) -> DataFrame:
    """Spend by UTC day of distinct settled receipts over a week, today's marked."""
    settled = receipts.where("status = 'settled'").dropDuplicates(["receiptId"])
    day = E.day_index(F.col("updatedAt"))
    days = settled.groupBy(day.alias("day")).agg(F.sum("freebucks").alias("spent"))
    today = anchor_ms // 86_400_000
    return days.where(F.col("day") > today - 7).withColumn("is_today", F.col("day") == today)


def workbuddy_context(usage: DataFrame) -> DataFrame:
    """How full each session's context is, as quota rows."""
    return usage.where("size > 0").select(
        F.lit("workbuddy").alias("app"), F.col("session_id").alias("account"), F.lit("session_ctx").alias("window_kind"), F.col("updated_at").alias("captured_at"),
        F.col("used").cast("double").alias("used"), F.col("size").cast("double").alias("limit_value"), (F.col("used") * 100.0 / F.col("size")).alias("used_percent"),
    )


def codebuddy_ide(requests: DataFrame, folders: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The latest snapshot of each request, where it differs from what was emitted before.

    ``requests`` has (request_id, conversation, model, ts, mtime, stem, input_tokens, output_tokens, cache_read_tokens,
    cache_write_tokens, reasoning_tokens, duration_ms, credits), ``previous`` (dedup_key, content).
    """
    values = [c for c in requests.columns if c not in ("request_id", "conversation")]
    latest = requests.groupBy("request_id").agg(F.max_by(F.struct("conversation", *values), F.struct("ts", "mtime", "stem")).alias("s")).select("request_id", "s.*")
    rows = latest.join(folders.select("conversation", "cwd"), "conversation", "left").withColumn("content", F.sha2(F.to_json(F.struct(*values)), 256))
    key = F.concat(F.lit("codebuddy_ide:"), "request_id")
    if previous is not None:
        rows = rows.withColumn("_key", key).join(previous.select(F.col("dedup_key").alias("_key"), "content"), ["_key", "content"], "left_anti")
    return ledger_rows(
        rows, dedup_key=key, app="codebuddy_ide", session_id=F.col("conversation"), project=F.col("cwd"), model=text("model"), request_model=text("model"), ts_start=F.col("ts"),
        input_tokens=E.minus_cache(count("input_tokens"), count("cache_read_tokens"), count("cache_write_tokens")), output_tokens=count("output_tokens"), reasoning_tokens=count("reasoning_tokens"),
        cache_read_tokens=count("cache_read_tokens"), cache_write_5m_tokens=count("cache_write_tokens"), credits=F.col("credits").try_cast("double"), duration_ms=F.col("duration_ms"),
        provenance="local_json", raw_ref=F.concat(F.col("stem"), F.lit("#"), "request_id"),
    )


def cline_v3(documents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Assistant messages with metrics of (task, messages JSON); the sidecar fills in model and folder."""
    schema = "array<struct<id: string, role: string, ts: string, metrics: struct<inputTokens: string, outputTokens: string, cacheReads: string, cacheWrites: string, cost: string>, modelInfo: struct<id: string, provider: string>>>"
    said = documents.select("task", F.explode(F.from_json("messages", schema)).alias("m")).where("m.role = 'assistant' AND m.metrics IS NOT NULL")
    said = said.join(sidecar.select("task", F.col("model").alias("_model"), F.col("provider").alias("_provider"), "cwd"), "task", "left")
    use = lambda c: count(f"m.metrics.{c}")
    cost = F.col("m.metrics.cost").try_cast("double")
    model = F.coalesce(text("m.modelInfo.id"), text("_model"))
    return ledger_rows(
        said, dedup_key=F.concat_ws(":", F.lit("cline"), "task", F.coalesce("m.id", "m.ts")), app="cline", session_id=F.col("task"), project=F.col("cwd"), provider_id=F.coalesce(text("m.modelInfo.provider"), text("_provider")),
        model=model, request_model=model, ts_start=any_ms("m.ts"), input_tokens=E.minus_cache(use("inputTokens"), use("cacheReads"), use("cacheWrites")), output_tokens=use("outputTokens"),
        cache_read_tokens=use("cacheReads"), cache_write_5m_tokens=use("cacheWrites"), cost_usd=F.when(cost > 0, cost), cost_source=F.when(cost > 0, "provider_reported"), provenance="local_json",
    )


def kiro_credits(turns: DataFrame) -> DataFrame:
    """Usage summaries of the IDE's sessions (path, session_id, project, model, execution_id, offset, kind, ts, credits).

    A summary belongs to the execution that it names, or else to the one that a turn_start mark opened and no turn_end
    closed; it starts with that turn, or when it was written. Summaries outside of turns count as well. Each has its
    place in the file in its key, and costs the list price.
    """
    opened = F.when(F.col("kind") == "turn_start", F.struct(text("execution_id").alias("exec"), F.col("ts").alias("ts")))
    mark = opened.when(F.col("kind") == "turn_end", F.struct(F.lit(None).cast("string").alias("exec"), F.lit(None).cast("long").alias("ts")))
    turn = F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    return kiro_rows(turns.withColumn("turn", turn).where("kind = 'usage_summary' AND credits > 0"))


def kiro_rows(used: DataFrame) -> DataFrame:
    """Ledger rows of usage summaries with the ``turn`` (exec, ts) that was open when they were written."""
    owner = F.coalesce(text("execution_id"), F.col("turn.exec"))
    place = F.concat(F.lit("@"), F.col("offset").cast("string"))
    start = F.coalesce("turn.ts", "ts")
    model = F.when(F.lower("model") == "auto", "kiro-auto").otherwise(text("model"))
    return ledger_rows(
        used, dedup_key=F.concat(F.lit("kiro-v2:"), F.coalesce("session_id", F.lit("")), F.coalesce(F.concat(F.lit(":"), owner), F.lit("")), place), app="kiro", session_id=F.col("session_id"),
        project=F.col("project"), provider_id="kiro", model=model, request_model=model, ts_start=start, ts_end=F.col("ts"), duration_ms=E.derived_duration(start, F.col("ts")),
        credits=F.col("credits"), cost_usd=F.col("credits") * KIRO_CREDIT_USD, cost_source="provider_reported", provenance="local_jsonl", raw_ref=F.concat("path", place),
    )


def recover_models(generations: DataFrame) -> DataFrame:
    """Generations (session_id, label, model, ...) with missing models taken from siblings.

    A label stands for a model if it has just one in the conversation; rows without a label get the conversation's only
    model, provided that every label was resolved.
    """
    named = generations.where("model IS NOT NULL AND label IS NOT NULL").groupBy("session_id", "label").agg(F.count_distinct("model").alias("n"), F.first("model").alias("_by_label"))
    joined = generations.join(named.where("n = 1").drop("n"), ["session_id", "label"], "left").withColumn("_found", F.coalesce("model", "_by_label"))
    whole = joined.groupBy("session_id").agg(F.count_distinct("_found").alias("_models"), F.first("_found", ignorenulls=True).alias("_only"), F.count_if(F.col("label").isNotNull() & F.col("_found").isNull()).alias("_open"))
    sole = F.when(F.col("label").isNull() & (F.col("_models") == 1) & (F.col("_open") == 0), F.col("_only"))
    return joined.join(whole, "session_id").withColumn("model", F.coalesce("_found", sole)).select(*generations.columns)
