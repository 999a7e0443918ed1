"""The registered ledger queries. Money and rates are rounded to 8 decimals, since sums of doubles depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators import calendar as K
from meterlake.operators import cube as C
from meterlake.operators import joins as J
from meterlake.operators import ledger as L
from meterlake.operators import metrics as M
from meterlake.operators import pricing as P
from meterlake.operators import quotas as Q
from meterlake.plans.fixtures import ANCHOR_MS, OFFSET, arrivals, ledger, quotas, quotes
from meterlake.schema import DAY_MS

A = ANCHOR_MS
TODAY = (A + E.offset_ms(OFFSET)) // DAY_MS
MIDNIGHT = TODAY * DAY_MS - E.offset_ms(OFFSET)
QUOTA_ANCHOR_MS = 880_000_000_000
_CONTENT = (
    "session_id model request_model ts_start ts_end input_tokens output_tokens reasoning_tokens cache_read_tokens cache_write_5m_tokens cache_write_1h_tokens "
    "unclassified_tokens credits cost_usd duration_ms ttft_ms active_ms"
).split()


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _ledger(use):
    return lambda spark, sf_dir: rounded(use(ledger(spark, sf_dir)))


def _cube_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    day = E.day_index(F.col("ts_start"), OFFSET)
    changed = [TODAY - 3, TODAY - 9]
    old = rows.where(F.coalesce(~day.isin([*changed, TODAY, TODAY - 1]), F.lit(True)))
    return rounded(C.refresh_cube(C.build_cube(old, OFFSET), rows, OFFSET, changed, A))


def _trend(rows: DataFrame) -> DataFrame:
    return M.trend_buckets(M.bucket_models(rows, OFFSET)).drop("top")


def _trend_top(rows: DataFrame) -> DataFrame:
    flat = M.trend_buckets(M.bucket_models(rows, OFFSET)).select("bucket", F.posexplode("top").alias("rank", "m"))
    return flat.select("bucket", (F.col("rank") + 1).alias("rank"), "m.model", "m.tokens")


def _activity(rows: DataFrame) -> DataFrame:
    return M.activity_daily(rows, A, OFFSET)


def _export(rows: DataFrame) -> DataFrame:
    return L.csv_rows(rows.withColumn("cost_usd", F.col("cost_usd") + 1e-11)).select("app", "cost_usd")


def _archive(rows: DataFrame) -> DataFrame:
    cold, kept = L.archive(rows, None, A - 10 * DAY_MS)
    both = cold.withColumn("part", F.lit("cold")).unionByName(kept.withColumn("part", F.lit("kept")))
    return both.groupBy("part").agg(F.count("*").alias("events"), F.sum(E.headline_tokens()).alias("tokens"))


def _page(rows: DataFrame) -> DataFrame:
    return M.events_page(rows, 2, 100).select("dedup_key", "app", E.model_expr().alias("model"), "ts_start", E.headline_tokens().alias("tokens"))


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ledger(spark, sf_dir).where("event_id % 2 = 0")
    return L.upsert_outcome(stored, arrivals(spark, sf_dir), OFFSET)


def _quotas(use):
    return lambda spark, sf_dir: use(quotas(spark, sf_dir))


def _ranked(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("live"), F.col("used_percent").desc_nulls_last(), "app", "id")  # a row a key: a few hundred
    return Q.rank_quotas(Q.latest_quotas(rows), QUOTA_ANCHOR_MS).withColumn("rank", F.row_number().over(order)).select("rank", "id", "app", "used_percent", "live")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = quotes(spark, sf_dir).select("model_id").distinct()
    raw = F.when(F.col("model_id").endswith(".1"), F.concat(F.lit("Vendor/"), F.upper("model_id"), F.lit(":free"))).otherwise(F.concat("model_id", F.lit("@2026[1m]")))
    return names.select(raw.alias("raw")).distinct().withColumn("model_key", E.model_key(F.col("raw"))).withColumn("canon_key", E.canon_key(F.col("model_key")))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_cost(rows: DataFrame) -> DataFrame:
    prices = {"input": 3.0, "output": 15.0, "cache_read": 0.3, "cache_write": 3.75, "tier_above_200k_input": 6.0, "tier_1h_cache_write": None, "tier_above_200k_output": 22.5, "tier_above_200k_cache_read": None}
    priced = rows.withColumns({c: F.lit(v).cast("double") for c, v in prices.items()})
    return priced.select("dedup_key", P.event_cost(50_000).alias("usd"))


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = quotes(spark, sf_dir).withColumn("fetched_at", A - 1000 * F.length("source").cast("bigint"))
    return P.price_freshness(prices, A)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as events spell the quoted models, so that they must be peeled to be found."""
    q = quotes(spark, sf_dir).select("model_id").distinct()
    spelled = F.concat(F.lit("vendor/openai."), "model_id", F.lit("-high")), F.concat("model_id", F.lit("-20250101")), F.col("model_id")
    return q.select(F.explode(F.array(*spelled)).alias("raw")).withColumn("request", F.lit(None).cast("string"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.expand_candidates(_names(spark, sf_dir).select(F.col("raw").alias("name")).distinct())


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.resolve(_names(spark, sf_dir), P.consensus(quotes(spark, sf_dir)))


def _reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.concat(F.lit("m-"), (F.col("event_id") % 150).cast("string"), F.lit("-1"))
    rows = ledger(spark, sf_dir).withColumns({"model": models, "cost_source": F.when(F.col("event_id") % 3 == 0, "provider_reported").otherwise("unpriced"), "request_model": F.lit(None).cast("string")})
    rows = rows.withColumn("cost_usd", F.when(F.col("event_id") % 3 == 0, F.col("cost_usd")).otherwise(0.0))
    resolved = P.resolve(P.names_of(rows), P.consensus(quotes(spark, sf_dir)))
    return rounded(P.reprice(rows, resolved, True).select("dedup_key", "pricing_model", "cost_source", "cost_usd"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    changes = turns.where("turn % 3 = 1").select("conv_id", "turn", F.concat(F.lit("m"), ((F.col("conv_id") + F.col("turn")) % 4).cast("string")).alias("model"))
    return J.asof_join(turns, changes.dropDuplicates(["conv_id", "turn"]), "conv_id", "turn", "model")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_quantity").cast("long").alias("q"))
    session = F.when(F.col("l_orderkey") % 50 != 0, F.concat(F.lit("s"), F.col("l_orderkey").cast("string")))
    traces = lines.groupBy("l_orderkey").agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.sum("q").alias("total"))
    model = F.when(F.col("l_orderkey") % 100 == 0, F.concat(F.lit("m"), F.col("l_orderkey").cast("string")))
    traces = traces.select(F.col("l_orderkey").alias("trace_id"), session.alias("session_id"), "start_ms", "end_ms", model.alias("model"), "total", (F.col("total") - 1).alias("input"), F.lit(1).cast("long").alias("output"), F.lit(1).cast("long").alias("cached"))
    exact = lines.where("l_linenumber % 2 = 0 AND l_orderkey % 3 <> 0").select(session.alias("session_id"), F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("model"), F.col("ts").alias("ts_start"), F.col("q").alias("tokens"))
    return J.subtract_coverage(traces, exact.where("session_id IS NOT NULL"))


def _totals_off(rows: DataFrame) -> DataFrame:
    return J.reconcile_totals(rows, rows.where("event_id % 50 <> 0"))


def _watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    path = F.concat(F.lit("C:/Logs/"), F.col("o_orderkey").cast("string"))
    ours = orders.where("o_orderkey % 7 <> 0").select(path.alias("path"), F.floor("price").cast("long").alias("tokens"))
    theirs = orders.where("o_orderkey % 5 <> 0").select(F.replace(F.lower(path), F.lit("/"), F.lit("\\")).alias("path"), (F.floor("price") + F.col("o_orderkey") % 3).cast("long").alias("tokens"))
    return rounded(J.reconcile_watermarks(ours, theirs))


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    sources = rows.groupBy(F.col("app").alias("source")).agg(F.max("ts_start").alias("last_synced_at"), F.count("*").alias("rows_ingested"))
    return J.source_health(sources, rows.where("app <> 'cursor'").select(F.col("app").alias("source"), "session_id").distinct())


QUERIES = {
    "totals_all": _ledger(M.totals),
    "totals_range": _ledger(lambda d: M.totals(M.scope(d, A - 7 * DAY_MS, A))),
    "totals_filtered": _ledger(lambda d: M.totals(M.scope(d, apps=["claude", "codex"], models=["alpha-1", "alias-x", "?"]))),
    "totals_empty_filter": _ledger(lambda d: M.totals(M.scope(d, apps=[]))),
    "by_app": _ledger(M.by_app),
    "by_model": _ledger(M.by_model),
    "app_names": _ledger(M.app_names),
    "model_names": _ledger(lambda d: M.model_names(d, ["claude", "codex"])),
    "event_count": _ledger(lambda d: M.event_count(M.scope(d, A - 7 * DAY_MS, A))),
    "unpriced_models": _ledger(M.unpriced_models),
    "daily_by_app": _ledger(lambda d: M.daily_by_app(d, OFFSET)),
    "hourly_by_app": _ledger(lambda d: M.hourly_by_app(d, OFFSET)),
    "activity_daily": _ledger(_activity),
    "hour_histogram": _ledger(lambda d: M.hour_histogram(d, OFFSET)),
    "today_hours": _ledger(lambda d: M.today_hours(d, A, OFFSET)),
    "bucket_models": _ledger(lambda d: M.bucket_models(d, OFFSET)),
    "trend_top_models": _ledger(_trend_top),
    "trend_moving_average": _ledger(lambda d: M.moving_average(_trend(d))),
    "trend_drawn": _ledger(lambda d: M.drawn(M.moving_average(_trend(d)))),
    "cube": _ledger(lambda d: C.build_cube(d, OFFSET)),
    "cube_overview_span": _ledger(lambda d: C.roll(C.cube_scope(C.build_cube(d, OFFSET), OFFSET, MIDNIGHT - 6 * DAY_MS, MIDNIGHT + DAY_MS))),
    "cube_refresh": _cube_refresh,
    "heatmap": _ledger(lambda d: C.heatmap(C.build_cube(d, OFFSET), A, OFFSET)),
    "speed_by_model": _ledger(M.speed_ranking),
    "speed_by_app": _ledger(lambda d: M.speed_ranking(d, "app", "total")),
    "speed_page": _ledger(lambda d: M.page_of(M.speed_ranking(d, "model", "decode"), 1, 2)),
    "rate_windows": _ledger(lambda d: M.rate_windows(d, A)),
    "rate_timeline": _ledger(lambda d: M.rate_timeline(d, A)),
    "peak_minute_1h": _ledger(lambda d: M.peak_minute_1h(d, A)),
    "peak_minute_24h": _ledger(lambda d: M.peak_minute_24h(d, A)),
    "top_models_1h": _ledger(lambda d: M.top_models_1h(d, A)),
    "top_apps_1h": _ledger(lambda d: M.top_apps_1h(d, A)),
    "activity_status": _ledger(lambda d: M.activity_status(d, A)),
    "rollups_full": _ledger(lambda d: L.rollups(d, OFFSET)),
    "rollups_partial": _ledger(lambda d: L.rollup_days(d, [TODAY, TODAY - 1, TODAY - 9], OFFSET)),
    "events_page": _ledger(_page),
    "export_rows": _ledger(lambda d: M.export_rows(d).select("dedup_key", "app", "ts_start", F.regexp_replace(F.format_number(F.col("cost_usd") + 1e-11, 4), ",", "").alias("cost_usd"))),
    "billable_gate": _ledger(lambda d: L.gate(d, ["cursor"]).groupBy("app").agg(F.count("*").alias("events"))),
    "upsert_final": lambda spark, sf_dir: L.fold(arrivals(spark, sf_dir)).select("dedup_key", "app", *_CONTENT, "completeness", "seq"),
    "upsert_outcome": _outcome,
    "archive_split": _ledger(_archive),
    "retention": _ledger(lambda d: L.prune(d, A - 10 * DAY_MS).groupBy("app").agg(F.count("*").alias("events"))),
    "replace_by_key": lambda spark, sf_dir: L.replace_by_key(None, arrivals(spark, sf_dir)).select("dedup_key", "app", *_CONTENT, "seq"),
    "quotas_latest": _quotas(lambda q: Q.latest_quotas(q)),
    "quotas_ranked": _quotas(_ranked),
    "quotas_groups": _quotas(lambda q: Q.quota_groups(Q.latest_quotas(q), QUOTA_ANCHOR_MS).drop("rows")),
    "quotas_changed_only": _quotas(lambda q: Q.changed_only(q).drop("captured_at")),
    "quotas_pruned": _quotas(lambda q: Q.prune_quotas(q, QUOTA_ANCHOR_MS - 30 * DAY_MS).select("id", "app", "account", "window_kind", "captured_at")),
    "active_streaks": _ledger(lambda d: K.active_streaks(_activity(d))),
    "calendar_weeks": _ledger(lambda d: K.calendar_weeks(_activity(d), A, OFFSET)),
    "calendar_cumulative": _ledger(lambda d: K.calendar_cumulative(_activity(d))),
    "calendar_intensity": _ledger(lambda d: K.calendar_intensity(_activity(d))),
    "calendar_stats": _ledger(lambda d: K.calendar_stats(_activity(d), A, OFFSET)),
    "receipt": _ledger(K.receipt),
    "pie_slices": _ledger(lambda d: K.pie_slices(M.by_model(d).select("name", "tokens"))),
    "shares_top_k": _ledger(lambda d: K.top_k_others(M.by_model(d).select("name", "tokens"), "name", "tokens")),
    "model_series": _ledger(lambda d: K.model_series(M.bucket_models(d, OFFSET))),
    "model_keys": _keys,
    "event_cost": lambda spark, sf_dir: _event_cost(ledger(spark, sf_dir)),
    "price_freshness": _freshness,
    "price_consensus": lambda spark, sf_dir: rounded(P.consensus(quotes(spark, sf_dir))),
    "price_stances": lambda spark, sf_dir: P.stances(quotes(spark, sf_dir)),
    "candidates": _candidates,
    "resolve_prices": _resolved,
    "reprice_diff": _reprice,
    "asof_model": _asof,
    "trace_coverage": _coverage,
    "reconcile_totals": _ledger(_totals_off),
    "reconcile_watermarks": _watermarks,
    "source_health": _health,
}
