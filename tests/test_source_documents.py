"""Normalizers of session documents on small made sessions."""

import json

from meterlake.sources import documents as D
from meterlake.sources import tables as T


def test_kiro_sessions_estimate_turns_without_counters(spark):
    turns = [
        {"metering_usage": [{"unit": "credit", "value": 0.5}, {"unit": "other", "value": 9}], "final_context_usage_percentage": 10, "end_timestamp": 1_700_000_010_000, "turn_duration": {"secs": 4, "nanos": 500_000_000}, "message_ids": ["m0"]},
        {"final_context_usage_percentage": 20, "total_request_count": 2, "model": "auto"},
        {"input_token_count": 7, "output_token_count": 3},
        {},
    ]
    doc = {"session_id": "s", "cwd": "/w", "session_state": {"rts_model_state": {"model_info": {"model_id": "x", "context_window_tokens": 1000}}, "conversation_metadata": {"user_turn_metadatas": turns}}}
    got = {r.dedup_key: r for r in D.normalize_kiro_cli(spark.createDataFrame([("/p/s.json", json.dumps(doc))], "path string, doc string")).collect()}
    assert set(got) == {"kiro_cli:s:m0", "kiro_cli:s:1", "kiro_cli:s:2"}
    first, second, third = got["kiro_cli:s:m0"], got["kiro_cli:s:1"], got["kiro_cli:s:2"]
    assert (first.credits, round(first.cost_usd, 6), first.ts_start, first.unclassified_tokens) == (0.5, 0.02, 1_700_000_005_500, 200)
    assert (second.unclassified_tokens, second.model, third.input_tokens, third.unclassified_tokens, third.model) == (300, "kiro-auto", 7, 0, "x")


def test_kiro_executions_need_credits(spark):
    docs = [("/w/a/1", {"usageSummary": [{"usage": 1.5}, {"usage": -1}], "executionId": "e", "metadata": {"workflowId": "wf"}, "startTime": 1_700_000_000_000}), ("/w/b/2", {"usageSummary": []}), ("/w/b/3", {"executions": [], "usageSummary": [{"usage": 1}]})]
    got = D.normalize_kiro_v1(spark.createDataFrame([(p, json.dumps(d)) for p, d in docs], "path string, doc string")).collect()
    assert [(r.dedup_key, r.credits, r.ts_start) for r in got] == [("kiro_v1:wf:e", 1.5, 1_700_000_000_000)]


def test_cline_requests_pair_and_take_the_model_in_force(spark):
    use = lambda n: json.dumps({"tokensIn": n, "tokensOut": 1})
    said = [("t", 0, "api_req_started", 10, use(1)), ("t", 1, "api_req_finished", 20, use(2)), ("t", 2, "text", 25, "hi"), ("t", 3, "api_req_started", 30, use(3)), ("t", 4, "api_req_started", 99, use(4)), ("t", 5, "subagent_usage", 40, use(5))]
    messages = spark.createDataFrame(said, "task string, at int, say string, ts long, text string")
    models = spark.createDataFrame([("t", 5, "m1", "p"), ("t", 30, "m2", "p")], "task string, ts long, model string, provider string")
    got = D.normalize_cline_v2(messages, models, spark.createDataFrame([("t", "/w", None)], "task string, cwd string, provider string"), 50).collect()
    assert sorted((r.dedup_key, r.input_tokens, r.model) for r in got) == [("cline:t:20", 2, "m1"), ("cline:t:30", 3, "m2"), ("cline:t:40:subagent", 5, "m2"), ("cline:t:50", 4, "m2")]


def test_generations_recover_models_and_times(spark):
    now = 1_700_000_000_000
    schema = "session_id string, idx long, response_id string, in1 long, in2 long, cache_read long, text_out long, thinking long, model string, label string, gen_ts long"
    gens = [("s", 0, "r0", 5, 1, 0, 2, 1, "M-Raw", "L", now), ("s", 1, "r0", 5, 1, 0, 2, 1, "M-Raw", "L", now), ("s", 2, "r2", 1, 0, 0, 1, 0, None, "L", 7), ("s", 3, None, 1, 0, 0, 1, 0, None, None, None), ("s", 4, "r4", 0, 0, 0, 0, 0, None, "L", now), ("s", 5, "own", 1, 0, 0, 0, 0, None, "L", now)]
    steps = spark.createDataFrame([("s", "r2", None, now + 2)], "session_id string, response_id string, gen_idx long, ts long")
    traj = spark.createDataFrame([("s", now + 9, now + 10, "/w")], "session_id string, created_ms long, mtime_ms long, workspace string")
    names = spark.createDataFrame([("m-raw", "model-1", "maker")], "name string, target string, provider string")
    ledger = spark.createDataFrame([("agy:own", "other")], "dedup_key string, session_id string")
    got = D.normalize_antigravity(spark.createDataFrame(gens, schema), steps, traj, names, ledger, now).collect()
    assert sorted((r.dedup_key, r.model, r.ts_start, r.output_tokens) for r in got) == [("agy:r0", "model-1", now, 3), ("agy:r2", "model-1", now + 2, 1), ("agy:s:3", "model-1", now + 9, 1)]
    two = T.recover_models(spark.createDataFrame([("q", "A", "m"), ("q", "B", "n"), ("q", None, None), ("q", "C", None)], "session_id string, label string, model string")).collect()
    assert sorted((str(r.label), r.model) for r in two) == [("A", "m"), ("B", "n"), ("C", None), ("None", None)]


def test_traces_leave_what_exact_rows_do_not_cover(spark):
    trace = lambda i, total, **more: json.dumps({"trace": {"traceId": i, "sessionId": "s", "startedAt": 1_700_000_000_000, "endedAt": 1_700_000_009_000, "totalTokens": total, "modelInfo": {"models": ["m"], "totalInputTokens": total - 1, "totalOutputTokens": 1, "totalCachedTokens": 1} | more}})
    docs = spark.createDataFrame([("p1", trace("a", 50)), ("p2", json.dumps({"trace": {"traceId": "no start"}})), ("p3", trace("b", 50).replace('"s"', '"other"'))], "path string, doc string")
    columns = "dedup_key string, app string, session_id string, model string, ts_start long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_5m_tokens long, cache_write_1h_tokens long, unclassified_tokens long"
    exact = spark.createDataFrame([("x", "codebuddy_cli", "s", "m", 1_700_000_001_000, 20, 0, 0, 0, 0, 0), ("y", "else", "s", "m", 1_700_000_001_000, 90, 0, 0, 0, 0, 0)], columns)
    got = {r.session_id: (r.input_tokens, r.output_tokens, r.cache_read_tokens, r.unclassified_tokens) for r in D.normalize_traces(docs, exact).collect()}
    assert got == {"a": (0, 0, 0, 30), "b": (48, 1, 1, 0)}
