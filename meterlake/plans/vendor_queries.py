"""Queries of further normalizers, price feeds and ledger upkeep: what vendors write is made from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.functions import labels
from meterlake.operators import cube as C
from meterlake.operators import joins as J
from meterlake.operators import ledger as L
from meterlake.operators import metrics as M
from meterlake.operators import pricing as P
from meterlake.operators import quotas as Q
from meterlake.plans.fixtures import ANCHOR_MS, DUCK_LEDGER, DUCK_QUOTAS, DUCK_QUOTES, OFFSET, ledger, quotas, quotes
from meterlake.plans.oracles import DAY, HEAD, MODEL
from meterlake.plans.oracles import ORACLES as LEDGER_ORACLES
from meterlake.plans.price_oracles import _VOTE, _canon
from meterlake.plans.source_queries import _E, _NAME, _file, _iso, _j, _lines, _oracle, shown
from meterlake.sources import documents, feeds, logs, tables, telemetry

def _bad() -> Column:
    return F.lit('{"type": "assistant", "message": {broken')


def _raw(df: DataFrame, path: Column, *lines: Column) -> DataFrame:
    """Like _lines, with a line that is no JSON at the end of each file."""
    good = _lines(df, path, *lines)
    return good.unionByName(df.select(path.alias("path"), F.lit(9000).cast("long").alias("line_offset"), _bad().alias("line")))


def _id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("event_id").cast("string"))


def _even(value: Column, by: int = 2) -> Column:
    return F.when(F.col("event_id") % by == 0, value)


def codebuddy_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    usage = _j(prompt_tokens=c("input_tokens") + c("cache_read_tokens"), completion_tokens=c("output_tokens"), cached_tokens=c("cache_read_tokens"), completion_thinking_tokens=c("reasoning_tokens"))
    said = _j(timestamp=c("ts_start"), providerData=_j(messageId=_even(_id("w")), model=c("model"), rawUsage=usage))
    return shown(logs.normalize_codebuddy_cli(_raw(rows, _file("codebuddy"), said, _j(type=F.lit("other")))))


def commandcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    usage = _j(inputTokens=c("input_tokens"), outputTokens=c("output_tokens"), cacheReadTokens=c("cache_read_tokens"), cacheWriteTokens=c("cache_write_5m_tokens"), cacheWriteTokens1h=c("cache_write_1h_tokens"), costUsd=c("cost_usd"))
    said = _j(type=F.lit("message"), id=_even(_id("c")), timestamp=_iso(c("ts_start")), model=c("model"), message=_j(role=F.lit("assistant")), usage=usage)
    return shown(logs.normalize_commandcode(_raw(rows, _file("command"), _j(type=F.lit("session"), cwd=F.lit("/c")), said, _j(message=_j(role=F.lit("user"))))))


def qoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    usage = _j(billable=c("event_id") % 7 != 0, input_tokens=c("input_tokens"), output_tokens=c("output_tokens"), cache_read_input_tokens=c("cache_read_tokens"), cache_creation_input_tokens=c("cache_write_5m_tokens"), credits=c("credits"), request_id=_even(_id("r")))
    said = _j(type=F.lit("assistant"), timestamp=_iso(c("ts_start")), sessionId=c("session_id"), directories=F.array(F.lit("/q")), message=_j(id=_id("q"), model=c("model"), usage=usage))
    raw = _raw(rows, _file("qoder"), _j(type=F.lit("user"), timestamp=_iso(c("ts_start") - 4000)), said)
    aliases = rows.where("model IN ('alpha-1', 'beta-2')").select(c("model").alias("name"), F.upper("model").alias("target")).distinct()
    return shown(logs.normalize_qoder(raw, aliases))


def dsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    config = _j(type=F.lit("session"), data=_j(header=_j(config=_j(provider=F.lit("deep"), model=F.lit("header-model")))))
    step = lambda kind, ts, **more: _j(seq=c("event_id"), type=F.lit(kind), time=ts, data=_j(turn=F.lit("1"), step=F.lit("1"), **more))
    usage = _j(input_tokens=c("input_tokens") + c("cache_read_tokens"), output_tokens=c("output_tokens"), cache_read_tokens=c("cache_read_tokens"), reasoning_tokens=c("reasoning_tokens"))
    said = step("assistant/message", _iso(c("ts_start")), usage=usage, message=_j(source=_j(model=c("model"))))
    return shown(logs.normalize_dsh(_raw(rows, _file("dsh"), config, step("step/start", _iso(c("ts_start") - 2000)), step("step/start", _iso(c("ts_start") - 1000)), said)))


def zcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    cached, kind = c("cache_read_tokens") + c("cache_write_5m_tokens"), c("event_id") % 3
    given = F.when(kind == 1, c("input_tokens")).otherwise(c("input_tokens") + cached)
    usage = rows.select(
        c("event_id").alias("rowid"), F.when(c("event_id") % 10 == 0, "running").otherwise("done").alias("status"), F.when(c("event_id") % 11 == 0, "my:Anthropic").otherwise("zai: own").alias("provider_id"),
        _id("z").alias("logical_request_id"), F.lit(1).alias("attempt_index"), "session_id", c("model").alias("model_id"), c("ts_start").alias("started_at"), c("ts_end").alias("completed_at"), given.alias("input_tokens"),
        "output_tokens", "reasoning_tokens", "cache_read_tokens", c("cache_write_5m_tokens").alias("cache_write_tokens"), F.when(kind < 2, c("input_tokens") + cached + c("output_tokens")).alias("provider_total_tokens"),
        "duration_ms", c("ttft_ms").alias("time_to_first_token_ms"), F.lit(None).cast("string").alias("error_type"),
    )
    return shown(tables.normalize_zcode(usage))


def devin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    model = F.when(c("event_id") % 13 == 0, "compactor").otherwise(_even(c("model")))
    usage = _j(input_tokens=c("input_tokens"), output_tokens=c("output_tokens"), cache_read_tokens=c("cache_read_tokens"), cache_write_tokens=c("cache_write_5m_tokens"))
    said = _j(role=F.when(c("event_id") % 17 == 0, "user").otherwise("assistant"), model=model, request_id=_even(_id("d"), 3), created_at=_iso(c("ts_start")), usage=usage)
    nodes = rows.select(c("event_id").alias("row_id"), "session_id", F.to_json(said).alias("chat_message"))
    sessions = rows.select(c("session_id").alias("id"), F.lit("session-model").alias("model"), F.lit("/d").alias("working_directory")).distinct()
    return shown(tables.normalize_devin(nodes, sessions))


def freebuff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    metrics = F.to_json(_j(inputTokens=c("input_tokens"), outputTokens=c("output_tokens"), cacheReadTokens=c("cache_read_tokens"), reasoningTokens=c("reasoning_tokens") * 100))
    messages = rows.select(c("session_id").alias("thread_id"), c("event_id").alias("seq"), metrics.alias("metrics_json"), c("ts_start").alias("ts"))
    threads = rows.select(c("session_id").alias("id"), F.concat(F.lit("handle-"), F.substring("session_id", -1, 1)).alias("model")).distinct()
    handles = threads.where("model < 'handle-5'").select(c("model").alias("name"), F.concat(F.lit("real-"), F.substring("model", -1, 1)).alias("target")).distinct()
    return shown(tables.normalize_freebuff(messages, threads, handles))


def freebuff_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    receipts = rows.select(F.when(c("event_id") % 9 == 0, "open").otherwise("settled").alias("status"), _id("x").alias("receiptId"), c("ts_start").alias("updatedAt"), (c("event_id") % 40).alias("freebucks"))
    return tables.freebuff_daily_spend(receipts.unionByName(receipts.where("freebucks > 20")), ANCHOR_MS)


def context_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    out = tables.workbuddy_context(rows.select("session_id", c("ts_start").alias("updated_at"), c("input_tokens").alias("used"), (c("event_id") % 9 * 1000).alias("size")))
    return out.withColumn("used_percent", F.round("used_percent", 6))


def codebuddy_ide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    snapshot = lambda mtime, out: rows.select(
        _id("i").alias("request_id"), c("session_id").alias("conversation"), "model", c("ts_start").alias("ts"), F.lit(mtime).alias("mtime"), F.lit("f").alias("stem"), (c("input_tokens") + c("cache_read_tokens")).alias("input_tokens"),
        out.alias("output_tokens"), "cache_read_tokens", F.lit(0).alias("cache_write_tokens"), "reasoning_tokens", "duration_ms", "credits",
    )
    folders = rows.select(c("session_id").alias("conversation"), F.lit("/i").alias("cwd")).distinct()
    return shown(tables.codebuddy_ide(snapshot(1, F.lit(0).cast("long")).unionByName(snapshot(2, c("output_tokens"))), folders))


def cline_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    metrics = _j(inputTokens=c("input_tokens") + c("cache_read_tokens"), outputTokens=c("output_tokens"), cacheReads=c("cache_read_tokens"), cacheWrites=F.lit(0), cost=c("cost_usd"))
    said = F.struct(_even(_id("m")).alias("id"), F.lit("assistant").alias("role"), c("ts_start").alias("ts"), metrics.alias("metrics"), F.when(c("event_id") % 3 == 0, _j(id=F.lit("own-model"), provider=F.lit("p"))).alias("modelInfo"))
    made = rows.select(_id("t").alias("task"), F.to_json(F.array(said)).alias("messages")).where("messages IS NOT NULL")
    sidecar = rows.select(_id("t").alias("task"), c("model"), F.lit("side").alias("provider"), F.lit("/v3").alias("cwd"))
    return shown(tables.cline_v3(made, sidecar)).where("dedup_key IS NOT NULL")


def cline_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir).where("ts_start IS NOT NULL"), F.col
    usage = F.to_json(_j(tokensIn=c("input_tokens"), tokensOut=c("output_tokens"), cacheReads=c("cache_read_tokens"), cacheWrites=c("cache_write_5m_tokens"), reasoningTokenCount=c("reasoning_tokens")))
    step = lambda at, say, text: rows.select(_id("t").alias("task"), F.lit(at).alias("at"), F.lit(say).alias("say"), c("ts_start").alias("ts"), text.alias("text"))
    messages = step(0, "api_req_started", F.lit("{}")).unionByName(step(1, "api_req_finished", usage)).unionByName(step(2, "text", F.lit("hello"))).unionByName(step(3, "subagent_usage", F.lit("{broken")))
    models = rows.select(_id("t").alias("task"), F.lit(0).cast("long").alias("ts"), c("model"), F.lit("p").alias("provider"))
    return shown(documents.normalize_cline_v2(messages, models, rows.select(_id("t").alias("task"), F.lit("/v2").alias("cwd"), F.lit(None).cast("string").alias("provider")), ANCHOR_MS))


def kiro_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    turn = _j(metering_usage=F.array(_j(unit=F.lit("credit"), value=c("credits"))), input_token_count=c("input_tokens"), output_token_count=c("output_tokens"), cache_read_input_token_count=c("cache_read_tokens"), message_ids=F.array(_id("m")), turn_duration=_j(secs=F.lit(3), nanos=F.lit(0)), end_timestamp=c("ts_start"), model=c("model"))
    doc = _j(session_id=c("session_id"), cwd=F.lit("/k"), session_state=_j(conversation_metadata=_j(user_turn_metadatas=F.array(turn))))
    made = rows.select(_id("/k/").alias("path"), F.to_json(doc).alias("doc")).unionByName(rows.select(_id("/bad/").alias("path"), _bad().alias("doc")))
    return shown(documents.normalize_kiro_cli(made))


def kiro_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    spent = (c("event_id") % 5 / 2).cast("double")
    mark = lambda at, kind, own, ts, used: F.struct(F.lit(at).cast("long").alias("offset"), F.lit(kind).alias("kind"), own.cast("string").alias("execution_id"), ts.cast("long").alias("ts"), used.cast("double").alias("credits"))
    none = F.lit(None)
    marks = F.array(
        mark(0, "turn_start", _id("e"), c("ts_start") - 1000, none), mark(100, "usage_summary", _even(_id("own")), c("ts_start"), spent), mark(200, "turn_end", none, c("ts_start"), none), mark(300, "usage_summary", none, c("ts_start"), spent)
    )
    return rows.select(_id("/k/").alias("path"), "session_id", F.lit("/p").alias("project"), F.when(c("event_id") % 4 == 0, "AUTO").otherwise(c("model")).alias("model"), F.explode(marks).alias("m")).select("*", "m.*").drop("m")


def kiro_shown(df: DataFrame) -> DataFrame:
    return df.select("dedup_key", "session_id", "project", "model", "ts_start", "ts_end", "duration_ms", "credits", F.round("cost_usd", 8).alias("cost_usd"), "cost_source", "raw_ref")


def kiro_ide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kiro_shown(tables.kiro_credits(kiro_marks(spark, sf_dir)))


def kiro_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    doc = _j(executionId=_even(_id("e")), id=_id("i"), sessionId=c("session_id"), modelName=c("model"), startTime=c("ts_start"), endTime=c("ts_end"), usageSummary=F.array(_j(usage=c("credits")), _j(usage=F.lit(-1.0))))
    made = rows.select(_id("/v1/").alias("path"), F.to_json(doc).alias("doc")).unionByName(rows.select(_id("/bad/").alias("path"), _bad().alias("doc")))
    return shown(documents.normalize_kiro_v1(made))


def antigravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    response = F.when(c("event_id") % 3 != 0, _id("r"))
    generations = rows.select(
        "session_id", c("event_id").alias("idx"), response.alias("response_id"), c("input_tokens").alias("in1"), F.lit(0).alias("in2"), c("cache_read_tokens").alias("cache_read"), c("output_tokens").alias("text_out"),
        c("reasoning_tokens").alias("thinking"), F.concat(F.lit("Raw-"), (c("event_id") % 3).cast("string")).alias("model"), F.lit(None).cast("string").alias("label"), c("ts_start").alias("gen_ts"),
    )
    steps = rows.where("event_id % 3 = 1").select("session_id", response.alias("response_id"), F.lit(None).cast("long").alias("gen_idx"), F.lit(1_700_000_000_000).alias("ts"))
    trajectories = rows.select("session_id", F.lit(1_600_000_000_000).alias("created_ms"), F.lit(0).cast("long").alias("mtime_ms"), F.lit("/a").alias("workspace")).distinct()
    names = rows.select(F.lit("raw-0").alias("name"), F.lit("model-zero").alias("target"), F.lit("maker").alias("provider")).distinct()
    return shown(documents.normalize_antigravity(generations, steps, trajectories, names, rows.where("event_id % 31 = 0").select(F.concat(F.lit("agy:"), _id("r")).alias("dedup_key"), F.lit("other").alias("session_id")), ANCHOR_MS))


def sibling_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, c = spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.col
    model = F.when(c("turn") % 3 == 1, F.concat(F.lit("m"), ((c("conv_id") + F.floor(c("turn") / 6)) % 2).cast("string")))
    label = F.when(c("turn") % 5 != 4, F.concat(F.lit("L"), (c("turn") % 2).cast("string")))
    return tables.recover_models(turns.select(c("conv_id").cast("string").alias("session_id"), "turn", label.alias("label"), model.alias("model")))


def _limits(used: Column, resets: Column) -> Column:
    return _j(primary=_j(used_percent=used.cast("double"), window_minutes=F.lit(300), resets_at=resets), secondary=_j(used_percent=F.lit(5.0), window_minutes=F.lit(10080), resets_at=resets))


def codex_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir).where("ts_start IS NOT NULL"), F.col
    line = lambda used: _j(type=F.lit("event_msg"), timestamp=_iso(c("ts_start")), payload=_j(type=F.lit("token_count"), rate_limits=_limits(used, c("ts_start") + 5000)))
    used = c("event_id") % 100
    return logs.codex_quotas(_raw(rows, _file("codex"), line(used), line(used), line(used + 1))).drop("account", "used")


def codex_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir).where("ts_start IS NOT NULL"), F.col
    window = lambda used, seconds: _j(used_percent=used.cast("double"), limit_window_seconds=F.lit(seconds), reset_at=c("ts_start") + 7000)
    doc = _j(rate_limit=_j(primary_window=window(c("event_id") % 90, 18_000), secondary_window=_even(window(F.lit(3), 604_800))), credits=_j(balance=_even(F.lit("12.5"), 5)))
    return telemetry.codex_quota_response(rows.select(c("event_id").alias("captured_at"), F.to_json(doc).alias("doc")))


def cursor_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    doc = _j(individualUsage=_j(plan=_j(used=c("event_id") % 700, limit=F.lit(1000)), onDemand=_even(_j(used=F.lit(50), limit=F.lit(0)))))
    out = telemetry.cursor_quota_response(rows.select(c("event_id").alias("captured_at"), F.to_json(doc).alias("doc")))
    return out.withColumn("used_percent", F.round("used_percent", 6))


def _feed(parse, doc):
    """A feed whose documents hold one model of the quotes each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col
        rows = quotes(spark, sf_dir).withColumn("id", F.concat("source", F.lit("-"), "model_id"))
        made = rows.select(F.to_json(doc(c)).alias("doc")).unionByName(rows.limit(1).select(_bad().alias("doc")))  # one document is no JSON
        out = parse(made, ANCHOR_MS)
        return out.select("source", "model_id", *(F.round(x, 6).alias(x) for x in ("input", "output", "cache_read")), "fetched_at")

    return query


def _per_token(c, name: str) -> Column:
    return (c(name) / 1e6).cast("string")


FEEDS = {
    "feed_models_dev": _feed(feeds.parse_models_dev, lambda c: F.create_map(F.lit("maker"), _j(models=F.create_map(c("id"), _j(cost=_j(input=c("input"), output=c("output"), cache_read=c("cache_read"))))))),
    "feed_litellm": _feed(feeds.parse_litellm, lambda c: F.create_map(c("id"), _j(input_cost_per_token=_per_token(c, "input"), output_cost_per_token=_per_token(c, "output"), cache_read_input_token_cost=_per_token(c, "cache_read")))),
    "feed_llmpricing": _feed(feeds.parse_llmpricing, lambda c: _j(models=F.array(_j(id=c("id"), cheapest=_j(input=c("input"), output=c("output"), cache_read=c("cache_read")))))),
    "feed_vercel": _feed(feeds.parse_vercel, lambda c: _j(data=F.array(_j(id=c("id"), pricing=_j(input=_per_token(c, "input"), output=_per_token(c, "output"), input_cache_read=_per_token(c, "cache_read")))))),
    "feed_helicone": _feed(feeds.parse_helicone, lambda c: _j(data=F.array(*(_j(provider=F.lit(p), model=F.concat("id", F.lit(more)), operator=F.lit("equals"), input_cost_per_1m=c("input"), output_cost_per_1m=c("output"), prompt_cache_read_per_1m=c("cache_read")) for p, more in (("OpenAI", ""), ("RESELLER", "x")))))),
    "feed_langfuse": _feed(feeds.parse_langfuse, lambda c: F.array(_j(modelName=c("id"), pricingTiers=F.array(_j(isDefault=F.lit(True), prices=F.create_map(F.lit("input"), c("input") / 1e6, F.lit("output"), c("output") / 1e6, F.lit("input_cached_tokens"), c("cache_read") / 1e6)))))),
    "feed_llm_prices": _feed(feeds.parse_llm_prices, lambda c: _j(prices=F.array(*(_j(id=F.concat("id", F.lit(more)), name=F.lit(name), input=c("input"), output=c("output"), input_cached=c("cache_read")) for name, more in (("plain", ""), ("long > 200k", "x")))))),
    "feed_portkey": _feed(feeds.parse_portkey, lambda c: F.create_map(*(x for k in (c("id"), F.lit("default")) for x in (k, _j(pricing_config=_j(pay_as_you_go=_j(request_token=_j(price=c("input") / 1e4), response_token=_j(price=c("output") / 1e4), cache_read_input_token=_j(price=c("cache_read") / 1e4)))))))),
    "feed_seed": _feed(feeds.parse_seed, lambda c: F.create_map(c("id"), F.array(c("input"), c("output"), c("cache_read"), F.lit(0.0)))),
}


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"), F.repeat(F.char(F.col("n_nationkey") % 26 + 65), 3).alias("code"), (F.lit(1.0) + F.col("n_nationkey") / 10).alias("rate"))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _nations(spark, sf_dir), F.col
    json = lambda keep: rows.where(keep).select(F.to_json(_j(result=F.lit("success"), rates=F.create_map(F.lower("code"), c("rate"), F.lit("bad"), F.lit(-1.0)))).alias("doc"))
    primary, fallback = feeds.parse_fx_json(json("n < 10")), feeds.parse_fx_fallback(json("n >= 5"))
    ecb = feeds.parse_fx_ecb(rows.select(F.concat(F.lit("<Cube currency='"), F.when(c("n") == 0, "USD").otherwise(c("code")), F.lit("' rate='"), c("rate").cast("string"), F.lit("'/>")).alias("doc")))
    every = primary.unionByName(fallback).unionByName(ecb)
    return feeds.pick_rates(every, "LLL").unionByName(ecb).select("source", "currency", F.round("rate", 8).alias("rate"))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = ledger(spark, sf_dir), F.col
    rows = rows.withColumns({"cost_usd": F.when(c("event_id") % 8 != 0, c("cost_usd") + 1e-11), "raw_ref": F.concat(F.when(c("event_id") % 2 == 0, "=").otherwise("a,"), "dedup_key"), "project": F.lit('say "hi"'), "cost_source": _even(F.lit("computed"))})
    rows = rows.withColumn("output_tokens", c("output_tokens") * 8).withColumn("duration_ms", F.when(c("duration_ms") > 0, F.lit(1000).cast("long")))
    return L.csv_rows(rows, OFFSET)


def read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = F.when(c("event_id") % 35 == 0, "").otherwise(F.repeat(F.concat(F.lit("line "), c("event_id").cast("string"), F.lit(";")), 40))
    rows = ledger(spark, sf_dir).select("event_id", text.alias("text"))
    files = rows.select(_id("/f/").alias("path"), F.encode("text", "UTF-8").alias("content"))
    kind, size = c("event_id") % 5, F.length("text")
    at = F.when(kind == 1, size).when(kind == 4, size + 5).otherwise(F.greatest(size - 3, F.lit(0)))
    before = F.sha2(F.when(kind == 3, "rewritten").otherwise(F.substring("text", F.greatest(at - 255, F.lit(1)), F.least(at, F.lit(256)))), 256)
    cursors = rows.where("event_id % 5 <> 0").select(_id("/f/").alias("path"), at.cast("long").alias("last_byte_offset"), before.alias("fingerprint"))
    plan = L.read_plan(L.file_tails(files, cursors), cursors)
    moved = L.advance(cursors, plan).select("path", c("last_byte_offset").alias("cursor"))
    return plan.drop("tail").join(moved, "path", "left")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    new = rows.withColumn("session_id", F.when(F.col("event_id") % 3 == 0, F.lit("thief")).otherwise(F.col("session_id")))
    return J.keep_first_owner(new, rows.where("event_id % 2 = 0")).groupBy("session_id").agg(F.count("*").alias("events"))


def vanished_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    return J.vanished(rows, rows.where("event_id % 4 <> 1"), "dedup_key")


def currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _nations(spark, sf_dir).select(F.col("code").alias("currency"), "rate")
    by_app = ledger(spark, sf_dir).groupBy("app").agg(F.sum("cost_usd").alias("cost_usd"))
    both = [J.to_currency(by_app, rates, code).select("app", F.lit(code).alias("code"), F.round("cost", 6).alias("cost")) for code in ("HHH", "none")]
    return both[0].unionByName(both[1])


def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    names = rows.where("model >= 'b'").select(F.col("model").alias("name"), F.upper("model").alias("target")).distinct()
    return J.map_names(rows.select("model"), names, "model").groupBy("model").agg(F.count("*").alias("events"))


def active_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.day_ranges(ledger(spark, sf_dir).where("ts_start IS NOT NULL AND event_id % 7 = 0").select(F.floor(F.col("ts_start") / 86_400_000).alias("day")).where("day % 5 <> 0"))


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flags = ledger(spark, sf_dir).select(c("app").alias("source"), (c("event_id") % 2 == 0).alias("written"), (c("event_id") % 6 == 0).alias("merged"), (c("event_id") % 5 == 0).alias("gated"))
    return L.batch_report(flags)


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One app gone, another's reasoning tokens put right, rows of two files to be read again left out."""
    rows = ledger(spark, sf_dir).withColumn("raw_ref", F.concat(F.lit("/f"), (F.col("event_id") % 10).cast("string"), F.lit("#"), "dedup_key"))
    again = rows.where("event_id % 10 < 2").select(F.element_at(F.split("raw_ref", "#"), 1).alias("path")).distinct()
    left = L.repair_reread(L.repair_reasoning(L.delete_app(rows, "cursor"), "codex"), again)
    return left.groupBy("app").agg(F.count("*").alias("events"), F.sum("output_tokens").alias("output_tokens"))


def event_tps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("dedup_key", F.round(E.output_tps(), 6).alias("tps"))


def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for searching, guarded cells, counts as they are shown, and display names of apps."""
    rows, c = ledger(spark, sf_dir), F.col
    odd = F.concat(F.element_at(F.array(*map(F.lit, ("=", "a,", 'b"', "Él-", "x "))), (c("event_id") % 5 + 1).cast("int")), "session_id")
    size = c("input_tokens") * c("event_id") * c("event_id")
    return rows.select(
        "dedup_key", labels.shown(c("app"), labels.APP_NAMES).alias("app_name"), E.flatten(odd).alias("flat"), E.csv_guard(odd).alias("cell"), E.fmt_exact(size).alias("exact"), E.fmt_compact(size).alias("compact"),
        E.file_path(F.concat(F.lit("file:///w/a%20b+"), "session_id")).alias("path"), E.fmt_duration(c("duration_ms")).alias("spent"),
    )


def quota_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotas(spark, sf_dir)
    return Q.append_quotas(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).select("id", "app", "account", "window_kind", "captured_at")


def quote_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quote_groups(quotes(spark, sf_dir)).select("canon", "source", "model_id", "display")


def price_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disputed models of the whole book that have both words in a spelling, with who said what in order of trust."""
    found = P.search_prices(P.price_rows(quotes(spark, sf_dir)), "M-1, 1", True)
    said = F.array_join(F.transform("quotes", lambda q: F.concat_ws(":", q["source"], q["model_id"], q["stance"], F.round(q["cache_read"], 4).cast("decimal(18,4)").cast("string"))), " ")
    return found.select("canon", "display", "agree", "total", F.size("quotes").alias("quotes"), said.alias("said"))


def range_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, zone, out = ledger(spark, sf_dir), "Asia/Shanghai", None
    for key in ("today", "week", "month", "all", "custom"):
        low, high = M.range_bounds(key, ANCHOR_MS, zone, ANCHOR_MS, ANCHOR_MS - 3_600_000)
        one = M.event_count(M.scope(rows, low, high)).toDF("events").select(F.lit(key).alias("preset"), "events", F.lit(M.is_hourly(key, low, high, zone)).alias("hourly"))
        out = one if out is None else out.unionByName(one)
    return out


def overview_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the overview shows of the last week, one figure a row."""
    rows = ledger(spark, sf_dir)
    midnight = (ANCHOR_MS + 28_800_000) // 86_400_000 * 86_400_000 - 28_800_000
    parts = C.overview(rows, C.build_cube(rows, OFFSET), ANCHOR_MS, OFFSET, midnight - 6 * 86_400_000, midnight + 86_400_000, quotas=quotas(spark, sf_dir))
    figure = lambda part, name, value: parts[part].select(F.lit(part).alias("part"), name.cast("string").alias("name"), F.round(value.cast("double"), 6).alias("value"))
    c, none = F.col, F.lit("")
    shown = [
        figure("today", none, c("events")), figure("all", none, c("events")), figure("span", none, E.headline_tokens()), figure("by_app", c("app"), c("cost_usd")), figure("by_model", c("model"), c("events")),
        figure("trend", c("date"), E.headline_tokens()), figure("trend30", c("date"), c("tokens")), figure("average30", none, c("tokens")), figure("unpriced", c("name"), c("n")), figure("quotas", c("app"), c("n")),
    ]
    out = shown[0]
    for one in shown[1:]:
        out = out.unionByName(one)
    return out


QUERIES = {
    "normalize_codebuddy_cli": codebuddy_cli, "normalize_commandcode": commandcode, "normalize_qoder": qoder, "normalize_dsh": dsh, "normalize_zcode": zcode, "normalize_devin": devin,
    "normalize_freebuff": freebuff, "freebuff_spend": freebuff_spend, "context_fill": context_fill, "normalize_codebuddy_ide": codebuddy_ide, "normalize_cline_v3": cline_v3, "normalize_cline_v2": cline_v2,
    "normalize_kiro_cli": kiro_cli, "normalize_kiro_ide": kiro_ide, "normalize_kiro_v1": kiro_v1, "normalize_antigravity": antigravity, "sibling_models": sibling_models, "codex_limits": codex_limits,
    "codex_quota_response": codex_response, "cursor_quota_response": cursor_response, **FEEDS, "fx_rates": fx_rates, "csv_export": csv_export, "read_plan": read_plan, "ownership": ownership,
    "vanished_keys": vanished_keys, "currency": currency, "alias_names": alias_names, "active_ranges": active_ranges, "batch_report": batch_report, "repairs": repairs,
    "event_tps": event_tps, "shown_names": shown_names, "quota_append": quota_append, "quote_groups": quote_groups, "price_search": price_search, "range_presets": range_presets, "overview_bundle": overview_bundle,
}

_LOG = "'rollout-' || " + _E
_TIMED = "CASE WHEN ts_start IS NOT NULL THEN {}::BIGINT END"
_USED = "input_tokens + output_tokens + cache_read_tokens"
_COST = "CASE WHEN cost_usd > 0 THEN ROUND(cost_usd, 8) END"
_SPENT = "ROUND(credits * 0.04, 8)"
_SUMMARY = "event_id, session_id, CASE WHEN event_id % 4 = 0 THEN 'kiro-auto' ELSE NULLIF(model, '') END AS model, ts_start AS ts, (event_id % 5) / 2 AS spent FROM ledger WHERE event_id % 5 > 0"


def _led(sql: str) -> str:
    return f"WITH {DUCK_LEDGER} {sql}"


def _book(source: str, cache_read: str = "ROUND(cache_read, 6)") -> str:
    return f"WITH {DUCK_QUOTES} SELECT '{source}' AS source, lower(source || '-' || model_id) AS model_id, ROUND(input, 6) AS input, ROUND(output, 6) AS output, {cache_read} AS cache_read, {ANCHOR_MS}::BIGINT AS fetched_at FROM quotes"


_ZERO = "ROUND(COALESCE(cache_read, 0), 6)"
_CSV_TPS = "CASE WHEN unclassified_tokens <= 0 THEN output_tokens * 8 * 1000.0 / (CASE WHEN duration_ms > 0 THEN 1000 WHEN ts_end - ts_start > 0 AND ts_end - ts_start <= 1800000 THEN ts_end - ts_start END) END"
ORACLES = {
    "normalize_codebuddy_cli": _oracle(dedup_key=f"'codebuddy_cli:' || CASE WHEN event_id % 2 = 0 THEN 'w' || {_E} ELSE '/logs/codebuddy/' || session_id || '/rollout-' || {_E} || '.jsonl@0' END", app="'codebuddy_cli'", session_id=_LOG),
    "normalize_commandcode": _oracle(
        dedup_key=f"'commandcode:' || CASE WHEN event_id % 2 = 0 THEN 'c' || {_E} ELSE '/logs/command/' || session_id || '/rollout-' || {_E} || '.jsonl@100' END", app="'commandcode'", session_id=_LOG, project="'/c'", reasoning_tokens="0::BIGINT",
        cache_write_5m_tokens="cache_write_5m_tokens - LEAST(cache_write_5m_tokens, cache_write_1h_tokens)", cache_write_1h_tokens="LEAST(cache_write_5m_tokens, cache_write_1h_tokens)", cost_usd=_COST,
    ),
    "normalize_qoder": _oracle(
        "event_id % 7 <> 0", dedup_key=f"'qoder:' || CASE WHEN event_id % 2 = 0 THEN 'r' ELSE 'q' END || {_E}", app="'qoder'", project="'/q'", model=f"CASE WHEN model IN ('alpha-1', 'beta-2') THEN upper(model) ELSE {_NAME} END",
        reasoning_tokens="0::BIGINT", cache_write_5m_tokens="cache_write_5m_tokens", duration_ms=_TIMED.format(4000),
    ),
    "normalize_dsh": _oracle(dedup_key=f"'dsh:rollout-' || {_E} || ':' || {_E}", app="'dsh'", session_id=_LOG, model=f"COALESCE({_NAME}, 'header-model')", ts_start="ts_start - 2000", ts_end="ts_start", duration_ms=_TIMED.format(2000)),
    "normalize_zcode": _oracle("event_id % 10 <> 0 AND event_id % 11 <> 0", dedup_key=f"'zcode:z' || {_E} || ':1'", app="'zcode'", ts_end="ts_end", cache_write_5m_tokens="cache_write_5m_tokens", duration_ms="duration_ms"),
    "normalize_devin": _oracle(
        "event_id % 17 <> 0", dedup_key=f"'devin:' || session_id || ':' || CASE WHEN event_id % 3 = 0 THEN 'd' ELSE '' END || {_E}", app="'devin'", project="'/d'", reasoning_tokens="0::BIGINT",
        model=f"CASE WHEN event_id % 13 = 0 THEN 'compactor' WHEN event_id % 2 = 0 THEN COALESCE({_NAME}, 'session-model') ELSE 'session-model' END", cache_write_5m_tokens="cache_write_5m_tokens",
    ),
    "normalize_freebuff": _oracle(
        f"{_USED} > 0", dedup_key=f"'freebuff:' || session_id || ':' || {_E}", app="'freebuff'", model="CASE WHEN right(session_id, 1) < '5' THEN 'real-' ELSE 'handle-' END || right(session_id, 1)", reasoning_tokens="LEAST(reasoning_tokens * 100, output_tokens)",
    ),
    "freebuff_spend": _led(f"SELECT (ts_start // 86400000)::BIGINT AS day, SUM(event_id % 40)::BIGINT AS spent, ts_start // 86400000 = {ANCHOR_MS // 86_400_000} AS is_today FROM ledger WHERE event_id % 9 <> 0 AND ts_start // 86400000 > {ANCHOR_MS // 86_400_000 - 7} GROUP BY 1, 3"),
    "context_fill": _led("SELECT 'workbuddy' AS app, session_id AS account, 'session_ctx' AS window_kind, ts_start AS captured_at, input_tokens::DOUBLE AS used, (event_id % 9 * 1000)::DOUBLE AS limit_value, ROUND(input_tokens * 100.0 / (event_id % 9 * 1000), 6)::DOUBLE AS used_percent FROM ledger WHERE event_id % 9 > 0"),
    "normalize_codebuddy_ide": _oracle(dedup_key=f"'codebuddy_ide:i' || {_E}", app="'codebuddy_ide'", project="'/i'", duration_ms="duration_ms"),
    "normalize_cline_v3": _oracle(
        "TRUE", dedup_key=f"CASE WHEN event_id % 2 = 0 THEN 'cline:t' || {_E} || ':m' || {_E} WHEN ts_start IS NULL THEN 'cline:t' || {_E} ELSE 'cline:t' || {_E} || ':' || ts_start::VARCHAR END", app="'cline'", session_id=f"'t' || {_E}", project="'/v3'",
        model=f"CASE WHEN event_id % 3 = 0 THEN 'own-model' ELSE {_NAME} END", reasoning_tokens="0::BIGINT", cost_usd=_COST,
    ),
    "normalize_cline_v2": _oracle(
        f"ts_start IS NOT NULL AND {_USED} + cache_write_5m_tokens > 0", dedup_key=f"'cline:t' || {_E} || ':' || LEAST(ts_start, {ANCHOR_MS})::VARCHAR", app="'cline'", session_id=f"'t' || {_E}", project="'/v2'", model="model",
        ts_start=f"LEAST(ts_start, {ANCHOR_MS})", cache_write_5m_tokens="cache_write_5m_tokens",
    ),
    "normalize_kiro_cli": _oracle(
        f"credits > 0 OR {_USED} > 0", dedup_key=f"'kiro_cli:' || session_id || ':m' || {_E}", app="'kiro'", project="'/k'", ts_start="ts_start - 3000", ts_end="ts_start", reasoning_tokens="0::BIGINT", duration_ms="3000::BIGINT",
        cost_usd=f"CASE WHEN credits > 0 THEN {_SPENT} END",
    ),
    "normalize_kiro_ide": _led(f"""SELECT 'kiro-v2:' || session_id || ':' || CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'e' END || {_E} || '@100' AS dedup_key, session_id, '/p' AS project, model, ts - 1000 AS ts_start, ts AS ts_end,
 CASE WHEN ts IS NOT NULL THEN 1000::BIGINT END AS duration_ms, spent AS credits, ROUND(spent * 0.04, 8) AS cost_usd, 'provider_reported' AS cost_source, '/k/' || {_E} || '@100' AS raw_ref FROM (SELECT {_SUMMARY})
 UNION ALL SELECT 'kiro-v2:' || session_id || '@300', session_id, '/p', model, ts, ts, NULL, spent, ROUND(spent * 0.04, 8), 'provider_reported', '/k/' || {_E} || '@300' FROM (SELECT {_SUMMARY})"""),
    "normalize_kiro_v1": _oracle(
        "credits > 0", dedup_key=f"'kiro_v1:' || session_id || ':' || CASE WHEN event_id % 2 = 0 THEN 'e' ELSE 'i' END || {_E}", app="'kiro'", ts_end="ts_end", cost_usd=_SPENT, **{f"{c}_tokens": "0::BIGINT" for c in ("input", "output", "reasoning", "cache_read")},
        duration_ms="CASE WHEN ts_end - ts_start > 0 AND ts_end - ts_start <= 1800000 THEN ts_end - ts_start END",
    ),
    "normalize_antigravity": _oracle(
        f"{_USED} + reasoning_tokens > 0 AND NOT (event_id % 31 = 0 AND event_id % 3 <> 0)", dedup_key=f"'agy:' || CASE WHEN event_id % 3 <> 0 THEN 'r' ELSE session_id || ':' END || {_E}", app="'gemini_antigravity'", project="'/a'",
        model="CASE WHEN event_id % 3 = 0 THEN 'model-zero' ELSE 'Raw-' || (event_id % 3)::VARCHAR END", output_tokens="output_tokens + reasoning_tokens",
        ts_start=f"CASE WHEN ts_start BETWEEN 1672531200000 AND {ANCHOR_MS + 86_400_000} THEN ts_start WHEN event_id % 3 = 1 THEN 1700000000000 ELSE 1600000000000 END",
    ),
    "sibling_models": """WITH g AS (SELECT conv_id::VARCHAR AS session_id, turn, CASE WHEN turn % 5 <> 4 THEN 'L' || (turn % 2)::VARCHAR END AS label, CASE WHEN turn % 3 = 1 THEN 'm' || ((conv_id + turn // 6) % 2)::VARCHAR END AS model FROM conversations),
 n AS (SELECT session_id, label, MIN(model) AS by_label FROM g WHERE model IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2 HAVING COUNT(DISTINCT model) = 1),
 j AS (SELECT g.*, COALESCE(model, by_label) AS found FROM g LEFT JOIN n USING (session_id, label)),
 w AS (SELECT session_id, COUNT(DISTINCT found) AS models, MIN(found) AS one, COUNT(*) FILTER (WHERE label IS NOT NULL AND found IS NULL) AS unknown FROM j GROUP BY 1)
 SELECT session_id, turn, label, COALESCE(found, CASE WHEN label IS NULL AND models = 1 AND unknown = 0 THEN one END) AS model FROM j JOIN w USING (session_id)""",
    "codex_limits": _led("""SELECT 'codex' AS app, ts_start AS captured_at, k AS window_kind, CASE WHEN k = 'weekly' THEN 5.0 ELSE event_id % 100 + more END::DOUBLE AS used_percent, ts_start + 5000 AS resets_at
 FROM ledger, (VALUES (0), (1)) AS m(more), (VALUES ('5h_block'), ('weekly')) AS w(k) WHERE ts_start IS NOT NULL"""),
    "codex_quota_response": _led("""SELECT 'codex' AS app, event_id AS captured_at, '5h_block' AS window_kind, (event_id % 90)::DOUBLE AS used_percent, ts_start + 7000 AS resets_at, NULL::DOUBLE AS used FROM ledger WHERE ts_start IS NOT NULL
 UNION ALL SELECT 'codex', event_id, 'weekly', 3.0, ts_start + 7000, NULL FROM ledger WHERE ts_start IS NOT NULL AND event_id % 2 = 0 UNION ALL SELECT 'codex', event_id, 'credits', NULL, NULL, 12.5 FROM ledger WHERE ts_start IS NOT NULL AND event_id % 5 = 0"""),
    "cursor_quota_response": _led("""SELECT 'cursor' AS app, event_id AS captured_at, 'plan' AS window_kind, (event_id % 700) / 100 AS used, 10.0::DOUBLE AS limit_value, ROUND((event_id % 700) * 100 / 1000, 6) AS used_percent FROM ledger
 UNION ALL SELECT 'cursor', event_id, 'on_demand', 0.5, 0.0, NULL FROM ledger WHERE event_id % 2 = 0"""),
    "feed_models_dev": _book("models.dev", _ZERO), "feed_litellm": _book("litellm", _ZERO), "feed_llmpricing": _book("llmpricing", _ZERO), "feed_vercel": _book("vercel"), "feed_helicone": _book("helicone"),
    "feed_langfuse": _book("langfuse"), "feed_llm_prices": _book("llm-prices"), "feed_portkey": _book("portkey"), "feed_seed": _book("seed"),
    "fx_rates": """WITH n AS (SELECT n_nationkey AS n, repeat(chr(65 + n_nationkey % 26), 3) AS code, 1 + n_nationkey / 10 AS rate FROM nation), e AS (SELECT 'ecb' AS source, CASE WHEN n = 0 THEN 'USD' ELSE code END AS currency, rate / (SELECT rate FROM n WHERE n = 0) AS rate FROM n)
 SELECT source, currency, ROUND(rate, 8) AS rate FROM (SELECT 'fallback' AS source, code AS currency, rate FROM n WHERE n >= 5 UNION ALL SELECT * FROM e UNION ALL SELECT 'ecb', 'EUR', 1 / (SELECT rate FROM n WHERE n = 0))""",
    "csv_export": _led(f"""SELECT strftime(make_timestamp((COALESCE(ts_start, 0) + 28800000) * 1000), '%Y-%m-%dT%H:%M:%S') || '+08:00' AS ts, app, COALESCE(model, '') AS model, '' AS pricing_model, '"say ""hi""' || chr(34) AS project, session_id AS session,
 input_tokens::VARCHAR AS input, (output_tokens * 8)::VARCHAR AS output, reasoning_tokens::VARCHAR AS reasoning, cache_read_tokens::VARCHAR AS cache_read, (cache_write_5m_tokens + cache_write_1h_tokens)::VARCHAR AS cache_write,
 COALESCE(printf('%.4f', credits), '') AS credits, CASE WHEN event_id % 8 <> 0 THEN printf('%.6f', cost_usd + 1e-11) ELSE '' END AS cost_usd, CASE WHEN event_id % 2 = 0 THEN 'computed' ELSE '' END AS cost_source,
 CASE WHEN duration_ms > 0 THEN '1000' ELSE '' END AS duration_ms, CASE WHEN event_id % 2 = 0 THEN '"''=' || dedup_key || '"' ELSE '"a,' || dedup_key || '"' END AS raw_ref, unclassified_tokens::VARCHAR AS unclassified_tokens,
 COALESCE(printf('%.3f', {_CSV_TPS}), '') AS speed_tps FROM ledger"""),
    "read_plan": _led(f"""SELECT '/f/' || {_E} AS path, action, (CASE action WHEN 'Full' THEN 0 WHEN 'Append' THEN place ELSE size END)::BIGINT AS from_offset, size AS length, CASE WHEN action <> 'Unchanged' THEN size ELSE place END::BIGINT AS cursor FROM (
 SELECT *, CASE WHEN event_id % 5 = 0 THEN CASE WHEN size = 0 THEN 'Unchanged' ELSE 'Full' END WHEN size < place THEN 'Pinned' WHEN size = place THEN 'Unchanged' WHEN event_id % 5 = 3 THEN 'Pinned' ELSE 'Append' END AS action FROM (
 SELECT event_id, size, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN size WHEN 4 THEN size + 5 ELSE GREATEST(size - 3, 0) END AS place FROM (SELECT event_id, (CASE WHEN event_id % 35 = 0 THEN 0 ELSE 40 * (6 + length({_E})) END)::BIGINT AS size FROM ledger)))"""),
    "ownership": _led("SELECT CASE WHEN event_id % 3 = 0 THEN 'thief' ELSE session_id END AS session_id, COUNT(*) AS events FROM ledger WHERE event_id % 2 <> 0 OR event_id % 3 <> 0 GROUP BY 1"),
    "vanished_keys": _led("SELECT dedup_key FROM ledger WHERE event_id % 4 = 1"),
    "currency": _led("SELECT app, code, ROUND(SUM(cost_usd) * rate, 6) AS cost FROM ledger, (SELECT 'HHH' AS code, 1 + n_nationkey / 10 AS rate FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'none', 1.0) GROUP BY app, code, rate"),
    "alias_names": _led("SELECT CASE WHEN model >= 'b' THEN upper(model) ELSE model END AS model, COUNT(*) AS events FROM ledger GROUP BY 1"),
    "active_ranges": _led("""SELECT MIN(day) AS first_day, MAX(day) AS last_day FROM (SELECT day, day - row_number() OVER (ORDER BY day) AS island FROM (SELECT DISTINCT ts_start // 86400000 AS day FROM ledger WHERE ts_start IS NOT NULL AND event_id % 7 = 0) WHERE day % 5 <> 0) GROUP BY island"""),
    "batch_report": _led("SELECT app AS source, COUNT(*) FILTER (WHERE event_id % 2 = 0) AS ingested, COUNT(*) FILTER (WHERE event_id % 6 = 0) AS merged, COUNT(*) FILTER (WHERE event_id % 5 = 0) AS skipped FROM ledger GROUP BY 1"),
    "repairs": _led("SELECT app, COUNT(*) AS events, SUM(output_tokens + CASE WHEN app = 'codex' THEN reasoning_tokens ELSE 0 END)::BIGINT AS output_tokens FROM ledger WHERE app <> 'cursor' AND event_id % 10 >= 2 GROUP BY 1"),
    "event_tps": _led(f"SELECT dedup_key, ROUND({_CSV_TPS.replace('output_tokens * 8', 'output_tokens').replace('THEN 1000 WHEN', 'THEN duration_ms WHEN')}, 6) AS tps FROM ledger"),
    "shown_names": _led(f"""SELECT dedup_key, CASE app WHEN 'claude' THEN 'Claude' WHEN 'codex' THEN 'Codex' WHEN 'cursor' THEN 'Cursor' WHEN 'opencode' THEN 'OpenCode' WHEN 'zcode' THEN 'ZCode' END AS app_name,
 lower(regexp_replace(odd, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS flat, CASE event_id % 5 WHEN 0 THEN '"''=' || session_id || '"' WHEN 1 THEN '"a,' || session_id || '"' WHEN 2 THEN '"b""' || session_id || '"' ELSE odd END AS cell,
 format('{{:,}}', size) AS exact, CASE WHEN size < 1000 THEN size::VARCHAR WHEN size < 1000000 THEN regexp_replace(printf('%.1f', size / 1e3), '\\.0$', '') || 'K' WHEN size < 1000000000 THEN regexp_replace(printf('%.1f', size / 1e6), '\\.0$', '') || 'M'
 ELSE regexp_replace(format('{{:,.1f}}', size / 1e9), '\\.0$', '') || 'B' END AS compact, '/w/a b+' || session_id AS path, CASE WHEN duration_ms >= 60000 THEN NULL ELSE (duration_ms // 1000)::VARCHAR || 's' END AS spent
 FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN 'a,' WHEN 2 THEN 'b"' WHEN 3 THEN 'Él-' ELSE 'x ' END || session_id AS odd, input_tokens * event_id * event_id AS size FROM ledger)"""),
    "quota_append": f"""WITH {DUCK_QUOTAS}, s AS (SELECT *, row_number() OVER (PARTITION BY app, account, window_kind ORDER BY captured_at DESC, id DESC) AS k FROM quotas WHERE id % 3 <> 0),
 b AS (SELECT * EXCLUDE (k), FALSE AS new FROM s WHERE k = 1 UNION ALL SELECT *, TRUE FROM quotas WHERE id % 3 = 0),
 l AS (SELECT *, row_number() OVER w AS n, lag(used) OVER w AS u, lag(used_percent) OVER w AS p, lag(resets_at) OVER w AS r FROM b WINDOW w AS (PARTITION BY app, account, window_kind ORDER BY captured_at, id))
 SELECT id, app, account, window_kind, captured_at FROM l WHERE new AND (n = 1 OR used IS DISTINCT FROM u OR used_percent IS DISTINCT FROM p OR resets_at IS DISTINCT FROM r)""",
    "quote_groups": f"""WITH {DUCK_QUOTES}, q AS (SELECT {_canon('model_id')} AS canon, source, model_id FROM quotes), d AS (SELECT canon, model_id AS display, row_number() OVER (PARTITION BY canon ORDER BY COUNT(*) DESC, model_id) AS k FROM q GROUP BY 1, 2)
 SELECT canon, source, model_id, display FROM q JOIN d USING (canon) WHERE k = 1""",
    "price_search": f"""WITH RECURSIVE {_VOTE}, d AS (SELECT canon, model_id AS display, row_number() OVER (PARTITION BY canon ORDER BY COUNT(*) DESC, model_id) AS k FROM q GROUP BY 1, 2),
 a AS (SELECT st.canon, COUNT(*) FILTER (WHERE stance = 'Agrees') AS agree, COUNT(*) FILTER (WHERE stance IN ('Agrees', 'Dissents')) AS total, COUNT(*)::INT AS quotes,
 string_agg(concat_ws(':', source, model_id, stance, round(coalesce(cache_read, 0), 4)::DECIMAL(18, 4)::VARCHAR), ' ' ORDER BY rank, model_id, source) AS said,
 string_agg(regexp_replace(lower(model_id), '[^a-z0-9]', '', 'g'), ' ') AS flat FROM st JOIN q USING (canon, source, model_id) GROUP BY 1)
 SELECT canon, display, agree, total, quotes, said FROM a JOIN d USING (canon) WHERE k = 1 AND agree < total AND flat LIKE '%m1%' AND flat LIKE '%1%'""",
    "range_presets": _led(f"""SELECT preset, COUNT(event_id) AS events, preset IN ('today', 'custom') AS hourly FROM (VALUES ('today', 0), ('week', 6), ('month', 29), ('all', NULL), ('custom', NULL)) AS k(preset, back)
 LEFT JOIN ledger ON preset = 'all' OR preset = 'custom' AND ts_start >= {ANCHOR_MS - 3_600_000} AND ts_start < {ANCHOR_MS} OR {DAY} BETWEEN {(ANCHOR_MS + 28_800_000) // 86_400_000} - back AND {(ANCHOR_MS + 28_800_000) // 86_400_000} GROUP BY 1"""),
    "overview_bundle": f"""WITH {DUCK_LEDGER}, {DUCK_QUOTAS}, r AS (SELECT *, {DAY} AS day, {HEAD} AS tokens, {MODEL} AS shown FROM ledger), t AS (SELECT {(ANCHOR_MS + 28_800_000) // 86_400_000} AS today),
 w AS (SELECT * FROM r, t WHERE day BETWEEN today - 6 AND today), m AS (SELECT d.day, COALESCE(SUM(tokens), 0) AS tokens FROM (SELECT unnest(range(today - 29, today + 1)) AS day FROM t) d LEFT JOIN r USING (day) GROUP BY 1)
 SELECT 'today' AS part, '' AS name, COUNT(*)::DOUBLE AS value FROM r, t WHERE day = today UNION ALL SELECT 'all', '', COUNT(*) FROM r UNION ALL SELECT 'span', '', SUM(tokens) FROM w
 UNION ALL SELECT 'by_app', app, ROUND(SUM(cost_usd), 6) FROM w GROUP BY 2 UNION ALL SELECT 'by_model', shown, COUNT(*) FROM w GROUP BY 2 UNION ALL SELECT 'trend', strftime(DATE '1970-01-01' + day::INT, '%Y-%m-%d'), SUM(tokens) FROM w GROUP BY 2
 UNION ALL SELECT 'trend30', strftime(DATE '1970-01-01' + day::INT, '%Y-%m-%d'), tokens FROM m UNION ALL SELECT 'average30', '', ROUND(AVG(tokens), 6) FROM m
 UNION ALL SELECT 'unpriced', name, n FROM (UNPRICED) UNION ALL SELECT 'quotas', app, COUNT(*) FROM (SELECT DISTINCT app, account, window_kind FROM quotas) GROUP BY 2""",
}
ORACLES["overview_bundle"] = ORACLES["overview_bundle"].replace("UNPRICED", LEDGER_ORACLES["unpriced_models"].split(f"WITH {DUCK_LEDGER}", 1)[1])
