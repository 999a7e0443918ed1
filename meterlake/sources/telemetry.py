"""Telemetry points and landed quota responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.sources.lines import any_ms
from meterlake.sources.logs import window_kind

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
_POINTS = f"struct<dataPoints: array<struct<attributes: array<struct<key: string, value: {_VALUE}>>, asDouble: string, asInt: string, timeUnixNano: string>>>"
_OTLP = f"struct<resourceMetrics: array<struct<scopeMetrics: array<struct<metrics: array<struct<name: string, sum: {_POINTS}, gauge: {_POINTS}>>>>>>>"


def otlp_points(documents: DataFrame) -> DataFrame:
    """(metric, session_id, attr_sig, ts_ms, value) of the data points in (doc) export requests; points without a value go."""
    doc = documents.select(F.from_json("doc", _OTLP).alias("d")).select(F.explode("d.resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    points = doc.select("m.name", F.explode(F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).alias("p"))
    plain = F.transform(F.coalesce("p.attributes", F.array().cast(f"array<struct<key: string, value: {_VALUE}>>")), lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value")))
    session = F.get(F.filter(plain, lambda a: a["key"] == "session.id"), 0)["value"]
    value = F.coalesce(F.col("p.asDouble").try_cast("double"), F.col("p.asInt").try_cast("double"))
    out = points.select(F.col("name").alias("metric"), F.coalesce(session, F.lit("")).alias("session_id"), E.attr_sig(F.filter(plain, lambda a: a["key"] != "session.id")).alias("attr_sig"), E.epoch_ms(F.col("p.timeUnixNano").try_cast("bigint")).alias("ts_ms"), value.alias("value"))
    return out.where("value IS NOT NULL")


def latest_points(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The newest point of each series; older ones never win, of equals the later arrival (seq) does."""
    every = incoming if stored is None else stored.withColumn("seq", F.lit(-1)).unionByName(incoming, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy("metric", "session_id", "attr_sig").orderBy(F.desc("ts_ms"), F.desc("seq")))
    return every.withColumn("_row", newest).where("_row = 1").drop("_row", "seq")


def codex_quota_response(documents: DataFrame) -> DataFrame:
    """Windows of landed (captured_at, doc) responses: both windows, extra limits and the balance."""
    window = "struct<used_percent: double, limit_window_seconds: bigint, reset_at: string>"
    doc = documents.withColumn("d", F.from_json("doc", f"rate_limit struct<primary_window: {window}, secondary_window: {window}>, additional_rate_limits array<struct<limit_name: string, rate_limit: struct<primary_window: {window}>>>, credits struct<balance: string>"))

    def row(kind: Column, w: Column) -> Column:
        return F.when(w["used_percent"].isNotNull(), F.struct(kind.alias("window_kind"), w["used_percent"].alias("used_percent"), any_ms(w["reset_at"]).alias("resets_at"), F.lit(None).cast("double").alias("used")))

    first, second = F.col("d.rate_limit.primary_window"), F.col("d.rate_limit.secondary_window")
    second_kind = F.when(second["limit_window_seconds"] >= 6 * 86_400, "weekly").otherwise(window_kind(F.floor(second["limit_window_seconds"] / 60)))
    extra = F.transform(F.coalesce("d.additional_rate_limits", F.array().cast(f"array<struct<limit_name: string, rate_limit: struct<primary_window: {window}>>>")), lambda x: row(x["limit_name"], x["rate_limit"]["primary_window"]))
    balance = F.col("d.credits.balance").try_cast("double")
    money = F.when(balance.isNotNull(), F.struct(F.lit("credits").alias("window_kind"), F.lit(None).cast("double").alias("used_percent"), F.lit(None).cast("bigint").alias("resets_at"), balance.alias("used")))
    rows = F.filter(F.concat(F.array(row(window_kind(F.floor(first["limit_window_seconds"] / 60)), first), row(second_kind, second)), extra, F.array(money)), lambda w: w.isNotNull())
    return doc.select(F.lit("codex").alias("app"), "captured_at", F.explode(rows).alias("w")).select("app", "captured_at", "w.*")


def cursor_quota_response(documents: DataFrame) -> DataFrame:
    """The pools of landed (captured_at, doc) responses, cents as dollars."""
    pools = (("plan", "individualUsage.plan"), ("on_demand", "individualUsage.onDemand"), ("team", "teamUsage.onDemand"))
    number = lambda path: F.get_json_object("doc", f"$.{path}").try_cast("double")
    rows = F.array(*(F.struct(F.lit(n).alias("window_kind"), (number(f"{p}.used") / 100).alias("used"), (number(f"{p}.limit") / 100).alias("limit_value"), F.when(number(f"{p}.limit") > 0, number(f"{p}.used") * 100 / number(f"{p}.limit")).alias("used_percent")) for n, p in pools))
    return documents.select(F.lit("cursor").alias("app"), "captured_at", F.explode(F.filter(rows, lambda r: r["used"].isNotNull())).alias("w")).select("app", "captured_at", "w.*")
