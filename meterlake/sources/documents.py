"""Normalizers of whole session documents and of decoded generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.joins import asof_join, keep_first_owner, subtract_coverage
from meterlake.sources.lines import any_ms, count, ledger_rows, stem, text
from meterlake.sources.tables import KIRO_CREDIT_USD, recover_models

#: Tokens of a context window where a session names none.
DEFAULT_WINDOW = 200_000.0
#: Generations before this time (2023-01-01) or more than a day ahead of the clock have no believable timestamp.
BELIEVABLE_FROM_MS, SKEW_MS = 1_672_531_200_000, 86_400_000

_TURN = """struct<metering_usage: array<struct<unit: string, value: string>>, input_token_count: string, output_token_count: string, cache_read_input_token_count: string, cache_write_input_token_count: string,
 final_context_usage_percentage: string, context_usage_percentage: string, total_request_count: string, message_ids: array<string>, turn_duration: struct<secs: bigint, nanos: bigint>, end_timestamp: string,
 model: string, end_reason: string>"""
_KIRO = f"""struct<session_id: string, cwd: string, session_state: struct<rts_model_state: struct<model_info: struct<model_id: string, context_window_tokens: string>>,
 conversation_metadata: struct<last_context_usage: struct<model_id: string>, user_turn_metadatas: array<{_TURN}>>>>"""


def _positive(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def _credits(items: Column, value: str, unit: str | None = None) -> Column:
    """The positive amounts of an array of usages, in credits; null if there are none."""
    mine = F.filter(items, lambda m: F.lower(F.coalesce(m[unit], F.lit("credit"))) == "credit") if unit else items
    amounts = F.filter(F.transform(mine, lambda m: _positive(m[value])), lambda v: v.isNotNull())
    return F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda a, v: a + v))


def _named(model: Column) -> Column:
    return F.when(F.lower(model) == "auto", "kiro-auto").otherwise(F.nullif(model, F.lit("")))


def normalize_kiro_cli(documents: DataFrame) -> DataFrame:
    """A row for each turn of (path, doc) sessions that has credits, counters or a context fill.

    Without counters the volume is estimated: the mean of the fills before and after the turn, of the window, for every
    request; the fill before is the last known one. Turns begin their duration before their end.
    """
    doc = documents.select("path", F.from_json("doc", _KIRO).alias("d")).where("d IS NOT NULL")
    meta, info = "d.session_state.conversation_metadata", "d.session_state.rts_model_state.model_info"
    turns = doc.select("path", "d", F.posexplode(f"{meta}.user_turn_metadatas").alias("turn", "t"))
    end = F.coalesce(_positive(F.col("t.final_context_usage_percentage")), _positive(F.col("t.context_usage_percentage")))
    turns = turns.withColumns({"end_fill": end, "credit": _credits(F.col("t.metering_usage"), "value", "unit")})
    before = F.last("end_fill", ignorenulls=True).over(Window.partitionBy("path").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, _positive(F.col("t.context_usage_percentage")), F.col("end_fill"))
    use = lambda c: count(f"t.{c}_token_count")
    recorded = use("input") + use("output") + use("cache_read_input") + use("cache_write_input")
    window = F.coalesce(_positive(F.col(f"{info}.context_window_tokens")), F.lit(DEFAULT_WINDOW))
    requests = F.greatest(count("t.total_request_count"), F.coalesce(F.size("t.metering_usage"), F.lit(0)), F.lit(1))
    guess = F.round((start + F.col("end_fill")) / 2 / 100 * window * requests).cast("long")
    turns = turns.withColumns({"recorded": recorded, "guess": F.coalesce(F.when(recorded == 0, guess), F.lit(0))})
    turns = turns.where("credit IS NOT NULL OR recorded + guess > 0")
    session = F.coalesce(text("d.session_id"), stem(F.col("path")))
    spent = F.col("t.turn_duration.secs") * 1000 + F.call_function("div", F.coalesce("t.turn_duration.nanos", F.lit(0)), F.lit(1_000_000))
    ended = any_ms("t.end_timestamp")
    model = _named(F.coalesce(text("t.model"), text(f"{info}.model_id"), text(f"{meta}.last_context_usage.model_id")))
    return ledger_rows(
        turns, dedup_key=F.concat_ws(":", F.lit("kiro_cli"), session, F.coalesce(text(F.get("t.message_ids", 0)), F.col("turn").cast("string"))), app="kiro", session_id=session, project=text("d.cwd"),
        provider_id="kiro", model=model, request_model=model, ts_start=F.coalesce(ended - spent, ended), ts_end=ended, input_tokens=use("input"), output_tokens=use("output"),
        cache_read_tokens=use("cache_read_input"), cache_write_5m_tokens=use("cache_write_input"), unclassified_tokens=F.col("guess"), credits=F.col("credit"),
        cost_usd=F.col("credit") * KIRO_CREDIT_USD, cost_source=F.when(F.col("credit").isNotNull(), "provider_reported"), duration_ms=spent, active_ms=spent, status=text("t.end_reason"),
        provenance="local_jsonl", raw_ref=F.concat("path", F.lit("#turn"), F.col("turn").cast("string")),
    )


def normalize_kiro_v1(documents: DataFrame) -> DataFrame:
    """Execution documents (path, doc) with credits above 0; the same facts go by several field names."""
    at = lambda p: F.get_json_object("doc", f"$.{p}")
    some = lambda *paths: F.coalesce(*(text(at(p)) for p in paths))
    doc = documents.where(at("executions").isNull()).withColumn("credit", _credits(F.from_json(at("usageSummary"), "array<struct<usage: string>>"), "usage")).where("credit > 0")
    own = F.coalesce(some("executionId", "id"), F.element_at(F.split("path", "/"), -1))
    session = F.coalesce(some("sessionId", "chatSessionId", "conversationId", "workflowId", "metadata.workflowId", "metadata.sessionId"), F.element_at(F.split("path", "/"), -2))
    model = _named(some("modelId", "modelID", "modelName", "model.id", "model.name", "model", "metadata.modelId", "metadata.modelID", "metadata.modelName"))
    time = lambda *names: F.coalesce(*(any_ms(at(p)) for n in names for p in (n, f"metadata.{n}")))
    start, end = time("startTime", "createdAt", "timestamp"), time("endTime", "updatedAt")
    return ledger_rows(
        doc, dedup_key=F.concat_ws(":", F.lit("kiro_v1"), session, own), app="kiro", session_id=session, provider_id="kiro", model=model, request_model=model, ts_start=start, ts_end=end,
        duration_ms=E.derived_duration(start, end), credits=F.col("credit"), cost_usd=F.col("credit") * KIRO_CREDIT_USD, cost_source="provider_reported", provenance="local_jsonl", raw_ref=F.col("path"),
    )


def normalize_cline_v2(messages: DataFrame, model_usage: DataFrame, tasks: DataFrame, anchor_ms: int) -> DataFrame:
    """Requests of (task, at, say, ts, text JSON) rows, a finished one in place of the start before it; the model is the one in force then.

    ``model_usage`` has (task, ts, model, provider), ``tasks`` (task, cwd, provider). Times ahead of the clock are the clock's.
    """
    kinds = {"api_req_started": "started", "api_req_finished": "finished", "subagent_usage": "subagent", "deleted_api_reqs": "deleted"}
    kind = F.coalesce(*(F.when(F.col("say") == k, v) for k, v in kinds.items()))
    rows = messages.withColumn("kind", kind).where("kind IS NOT NULL")
    pair = Window.partitionBy("task", F.col("kind").isin("started", "finished")).orderBy("at")
    rows = rows.withColumn("next", F.lead("kind").over(pair)).where("kind <> 'started' OR next IS NULL OR next <> 'finished'")
    given = F.from_json("text", "struct<tokensIn: string, tokensOut: string, cacheReads: string, cacheWrites: string, cost: string, reasoningTokenCount: string>")
    rows = rows.withColumns({"u": given, "ts": F.least("ts", F.lit(anchor_ms))})
    use = lambda c: count(f"u.{c}")
    cost = F.col("u.cost").try_cast("double")
    rows = rows.where((use("tokensIn") + use("tokensOut") + use("cacheReads") + use("cacheWrites") > 0) | F.coalesce(cost > 0, F.lit(False)))
    named = asof_join(rows, model_usage.select("task", "ts", F.struct("model", "provider").alias("in_force")), "task", "ts", "in_force")
    named = named.join(tasks.select("task", "cwd", F.col("provider").alias("_provider")), "task", "left")
    suffix = F.when(F.col("kind").isin("subagent", "deleted"), F.concat(F.lit(":"), "kind")).otherwise("")
    return ledger_rows(
        named, dedup_key=F.concat(F.lit("cline:"), "task", F.lit(":"), F.coalesce("ts", F.lit(0)).cast("string"), suffix), app="cline", session_id=F.col("task"), project=F.col("cwd"),
        provider_id=F.coalesce("_provider", "in_force.provider"), model=F.col("in_force.model"), ts_start=F.col("ts"), input_tokens=use("tokensIn"), output_tokens=use("tokensOut"),
        reasoning_tokens=use("reasoningTokenCount"), cache_read_tokens=use("cacheReads"), cache_write_5m_tokens=use("cacheWrites"), cost_usd=cost,
        cost_source=F.when(cost.isNotNull(), "provider_reported"), provenance="local_json",
    )


def normalize_antigravity(generations: DataFrame, steps: DataFrame, trajectories: DataFrame, dictionary: DataFrame, ledger: DataFrame | None, anchor_ms: int) -> DataFrame:
    """Decoded generations: the first reporter of a response keeps it, here and against the ledger.

    ``generations`` has (session_id, idx, response_id, in1, in2, cache_read, text_out, thinking, model, label, gen_ts),
    ``steps`` (session_id, response_id, gen_idx, ts), ``trajectories`` (session_id, created_ms, mtime_ms, workspace),
    ``dictionary`` (name, target, provider) of canonical models. Times come from the generation, its response's step,
    its number's step, the trajectory or the file, whichever is first and believable.
    """
    used = generations.where("coalesce(in1, 0) + coalesce(in2, 0) + coalesce(cache_read, 0) + coalesce(text_out, 0) + coalesce(thinking, 0) > 0")
    named = recover_models(used.withColumn("model", F.when(F.lower("model") == "auto", None).otherwise(F.col("model"))))
    first = F.row_number().over(Window.partitionBy("response_id").orderBy("session_id", "idx"))
    named = named.withColumn("_first", first).where("response_id IS NULL OR _first = 1")
    by_response = steps.where("response_id IS NOT NULL").groupBy("session_id", "response_id").agg(F.min("ts").alias("response_ts"))
    by_number = steps.where("gen_idx IS NOT NULL").groupBy("session_id", F.col("gen_idx").alias("idx")).agg(F.min("ts").alias("number_ts"))
    joined = named.join(by_response, ["session_id", "response_id"], "left").join(by_number, ["session_id", "idx"], "left").join(trajectories, "session_id", "left")
    names = dictionary.select(F.lower("name").alias("_name"), F.col("target").alias("_target"), F.col("provider").alias("_provider"))
    joined = joined.join(names, F.lower("model") == F.col("_name"), "left")
    believable = lambda c: F.when(F.col(c).between(BELIEVABLE_FROM_MS, anchor_ms + SKEW_MS), F.col(c))
    ts = F.coalesce(believable("gen_ts"), believable("response_ts"), believable("number_ts"), F.col("created_ms"), F.col("mtime_ms"))
    key = F.when(F.col("response_id").isNotNull(), F.concat(F.lit("agy:"), "response_id")).otherwise(F.concat(F.lit("agy:"), "session_id", F.lit(":"), F.col("idx").cast("string")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = ledger_rows(
        joined, dedup_key=key, app="gemini_antigravity", session_id=F.col("session_id"), project=F.col("workspace"), provider_id=F.col("_provider"), model=F.coalesce("_target", "model"),
        request_model=F.when(F.lower("_target") != F.lower("model"), F.col("model")), ts_start=ts, input_tokens=zero("in1") + zero("in2"), output_tokens=zero("text_out") + zero("thinking"),
        reasoning_tokens=zero("thinking"), cache_read_tokens=zero("cache_read"), provenance="local_db", raw_ref=F.concat("session_id", F.lit("#gen:"), F.col("idx").cast("string")),
    )
    return rows if ledger is None else keep_first_owner(rows, ledger)


def normalize_traces(documents: DataFrame, exact: DataFrame) -> DataFrame:
    """Traces of (path, doc) documents as rows of what exact ledger rows of the same app leave uncovered.

    A trace names its model only if it used a single one; without an id, a start or an end it is left out.
    """
    shape = """struct<sessionId: string, trace: struct<traceId: string, sessionId: string, startedAt: string, endedAt: string, duration: bigint, status: string, totalTokens: string,
     modelInfo: struct<models: array<string>, totalInputTokens: bigint, totalOutputTokens: bigint, totalCachedTokens: string>>>"""
    doc = documents.select("path", F.from_json("doc", shape).alias("d"))
    info = "d.trace.modelInfo"
    traces = doc.select(
        text("d.trace.traceId").alias("trace_id"), F.coalesce(text("d.trace.sessionId"), text("d.sessionId")).alias("session_id"), any_ms("d.trace.startedAt").alias("start_ms"),
        any_ms("d.trace.endedAt").alias("end_ms"), F.when(F.size(f"{info}.models") == 1, text(F.get(f"{info}.models", 0))).alias("model"), count("d.trace.totalTokens").alias("total"),
        F.col(f"{info}.totalInputTokens").alias("input"), F.col(f"{info}.totalOutputTokens").alias("output"), count(f"{info}.totalCachedTokens").alias("cached"),
        F.when(F.col("d.trace.duration") > 0, F.col("d.trace.duration")).alias("spent"), text("d.trace.status").alias("status"), "path",
    ).where("trace_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")
    own = exact.where((F.col("app") == "codebuddy_cli") & ~F.col("dedup_key").startswith("codebuddy_cli:trace:"))
    left = subtract_coverage(traces.drop("spent", "status", "path"), own.select("session_id", "model", "ts_start", E.tokens_total().alias("tokens")))
    rows = left.join(traces.select("trace_id", "spent", "status", "path"), "trace_id")
    return ledger_rows(
        rows, dedup_key=F.concat(F.lit("codebuddy_cli:trace:"), "trace_id"), app="codebuddy_cli", session_id=F.col("trace_id"), model=F.col("model"), ts_start=F.col("start_ms"),
        ts_end=F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms")), input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"), cache_read_tokens=F.col("cache_read_tokens"),
        unclassified_tokens=F.col("unclassified_tokens"), duration_ms=F.col("spent"), status=F.col("status"), provenance="local_jsonl", raw_ref=F.col("path"),
    )
