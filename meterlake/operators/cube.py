"""The base cube, a table of additive measures by day, app and model, and what is rolled up from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.metrics import activity_daily, by_app, by_model, daily_by_app, densify, measures, rate_windows, scope, totals, unpriced_models
from meterlake.operators.quotas import latest_quotas
from meterlake.schema import DAY_MS

KEYS = ("day", "app", "model")
#: Beyond so many changed days a full build is cheaper.
MOST_DIRTY_DAYS = 60


def build_cube(df: DataFrame, offset: str) -> DataFrame:
    """Sums by local day, app and display model; rows without a start are under a null day."""
    day = E.day_index(F.col("ts_start"), offset)
    span = F.coalesce(F.sum(F.coalesce(E.effective_duration_ms(), F.lit(0))), F.lit(0)).cast("long")
    return df.groupBy(day.alias("day"), "app", E.model_expr().alias("model")).agg(*measures(), span.alias("busy_ms"), *E.speed_sums())


def roll(cube: DataFrame, *keys: str) -> DataFrame:
    """The cube summed over all but ``keys``."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double" if c in ("credits", "cost_usd") else "long").alias(c) for c in cube.columns if c not in KEYS]
    return cube.groupBy(*keys).agg(*sums)


def day_aligned(ms: int | None, offset: str) -> bool:
    return ms is None or (ms + E.offset_ms(offset)) % DAY_MS == 0


def cube_scope(cube: DataFrame, offset: str, from_ms: int | None, to_ms: int | None, apps: Sequence[str] | None = None, models: Sequence[str] | None = None) -> DataFrame | None:
    """The cube's rows of a range, or None if a bound cuts a day and the rows themselves must answer."""
    if not (day_aligned(from_ms, offset) and day_aligned(to_ms, offset)):
        return None
    shift = E.offset_ms(offset)
    if from_ms is not None:
        cube = cube.where(F.col("day") >= (from_ms + shift) // DAY_MS)
    if to_ms is not None:
        cube = cube.where(F.col("day") < (to_ms + shift) // DAY_MS)
    for column, names in (("app", apps), ("model", models)):
        if names is not None:
            cube = cube.where(F.col(column).isin(list(names)) if names else F.lit(False))
    return cube


def refresh_cube(cube: DataFrame, df: DataFrame, offset: str, dirty_days: Sequence[int], anchor_ms: int) -> DataFrame:
    """The cube with its changed days, today and yesterday summed anew; all days if too many changed."""
    today = (anchor_ms + E.offset_ms(offset)) // DAY_MS
    days = sorted({*dirty_days, today, today - 1})
    if len(set(dirty_days)) > MOST_DIRTY_DAYS:
        return build_cube(df, offset)
    stale = F.coalesce(F.col("day").isin(days), F.lit(False))
    fresh = df.where(F.coalesce(E.day_index(F.col("ts_start"), offset).isin(days), F.lit(False)))
    return cube.where(~stale).unionByName(build_cube(fresh, offset))


def heat_days(anchor_ms: int, offset: str) -> tuple[int, int]:
    """From the Monday 52 weeks before this week to today."""
    today = (anchor_ms + E.offset_ms(offset)) // DAY_MS
    return today - (today + 3) % 7 - 52 * 7, today


def heatmap(cube: DataFrame, anchor_ms: int, offset: str) -> DataFrame:
    """One row a day of the 53 weeks up to today, days without rows being 0."""
    first, today = heat_days(anchor_ms, offset)
    sums = roll(cube.where(F.col("day").between(first, today)), "day")
    tokens = E.headline_tokens()
    sums = sums.select("day", "events", tokens.alias("tokens"), "cost_usd", "busy_ms")
    spine = cube.sparkSession.range(first, today + 1).select(F.col("id").cast("int").alias("day"))
    return densify(sums, spine, ["day"]).withColumn("date", E.date_of(F.col("day"))).orderBy("day")


def overview(df: DataFrame, cube: DataFrame, anchor_ms: int, offset: str, from_ms: int | None, to_ms: int | None, apps=None, models=None, quotas: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of the overview, from the cube where the bounds allow, else from the rows.

    Besides the sums of the range, of today and of all: the heat map, 30 dense days up to today with their average,
    models without a price, the rates of the last hours and, where they are given, the latest quotas by app.
    """
    shift = E.offset_ms(offset)
    midnight = (anchor_ms + shift) // DAY_MS * DAY_MS - shift
    span = cube_scope(cube, offset, from_ms, to_ms, apps, models)
    today = cube_scope(cube, offset, midnight, midnight + DAY_MS, apps, models)
    every = cube_scope(cube, offset, None, None, apps, models)
    rows = scope(df, from_ms, to_ms, apps, models)
    filtered = scope(df, apps=apps, models=models)
    last = (anchor_ms + shift) // DAY_MS
    sums = roll(every.where(F.col("day").between(last - 29, last)), "day").select("day", E.headline_tokens().alias("tokens"), "cost_usd")
    month = densify(sums, cube.sparkSession.range(last - 29, last + 1).select(F.col("id").cast("int").alias("day")), ["day"]).withColumn("date", E.date_of(F.col("day")))
    parts = {
        "today": roll(today), "all": roll(every), "heat": heatmap(every, anchor_ms, offset), "trend30": month.orderBy("day"), "average30": month.agg(F.avg("tokens").alias("tokens"), F.avg("cost_usd").alias("cost_usd")),
        "unpriced": unpriced_models(filtered), "rates": rate_windows(filtered, anchor_ms),
    }
    if quotas is not None:
        parts["quotas"] = latest_quotas(quotas).groupBy("app").agg(F.count("*").alias("n"), F.max("used_percent").alias("worst_pct")).orderBy("app")
    if span is None:
        trend = daily_by_app(rows.where("ts_start IS NOT NULL"), offset)
        parts["trend"] = trend.groupBy("date").agg(*(F.sum(c).alias(c) for c in trend.columns if c not in ("date", "app"))).orderBy("date")
        return parts | {"span": totals(rows), "by_app": by_app(rows), "by_model": by_model(rows), "activity": activity_daily(df, anchor_ms, offset)}
    dearest = lambda part, key: part.orderBy(F.desc("cost_usd"), key)
    return parts | {
        "span": roll(span),
        "by_app": dearest(roll(span, "app"), "app"),
        "by_model": dearest(roll(span, "model"), "model"),
        "trend": roll(span.where("day IS NOT NULL"), "day").withColumn("date", E.date_of(F.col("day"))).orderBy("day"),
        "activity": activity_daily(scope(df, apps=apps, models=models), anchor_ms, offset),
    }


