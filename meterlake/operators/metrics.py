"""Totals, shares, calendar buckets, rates and rankings over ledger rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.schema import DAY_MS, MINUTE_MS

RATE_WINDOWS = (("1m", 60_000), ("5m", 300_000), ("15m", 900_000), ("1h", 3_600_000), ("24h", 86_400_000))
SPEED_METRICS = {"": "output_tps", "output": "output_tps", "total": "total_tps", "input": "input_tps", "prefill": "prefill_tps", "decode": "decode_tps"}


def scope(df: DataFrame, from_ms: int | None = None, to_ms: int | None = None, apps: Sequence[str] | None = None, models: Sequence[str] | None = None) -> DataFrame:
    """Rows with from_ms <= ts_start < to_ms of these apps and display models. None sets no bound; an empty list keeps nothing."""
    if from_ms is not None:
        df = df.where(F.col("ts_start") >= from_ms)
    if to_ms is not None:
        df = df.where(F.col("ts_start") < to_ms)
    if apps is not None:
        df = df.where(F.col("app").isin(list(apps)) if apps else F.lit(False))
    if models is not None:
        df = df.where(E.model_expr().isin(list(models)) if models else F.lit(False))
    return df


def range_bounds(key: str, anchor_ms: int, tz: str, start: int | None = None, end: int | None = None) -> tuple[int | None, int | None]:
    """The half-open bounds of a preset: today, week (6 days back), month (29 back), all, custom (mended if swapped or empty)."""
    if key == "all":
        return None, None
    if key == "custom":
        if start is None or end is None:
            return start, end
        low, high = min(start, end), max(start, end)
        return low, high if high > low else low + DAY_MS
    zone = ZoneInfo(tz)
    today = datetime.fromtimestamp(anchor_ms / 1000, zone).date()
    midnight = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=zone).timestamp() * 1000)
    back = {"today": 0, "week": 6, "month": 29}[key]
    return midnight(today - timedelta(days=back)), midnight(today + timedelta(days=1))


def is_hourly(key: str, from_ms: int | None, to_ms: int | None, tz: str) -> bool:
    """Whether a range is drawn by hour: today, or a custom range inside one local day."""
    if key == "today":
        return True
    if key != "custom" or from_ms is None or to_ms is None:
        return False
    day = lambda ms: datetime.fromtimestamp(ms / 1000, ZoneInfo(tz)).date()
    return day(from_ms) == day(to_ms - 1)


def _sum(column: str | Column, kind: str = "long") -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast(kind)


def measures() -> list[Column]:
    """The additive measures of every total."""
    sums = {c: _sum(c).alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "unclassified_tokens", "cache_read_tokens")}
    return [
        F.count("*").alias("events"),
        *sums.values(),
        _sum(E.cache_write_tokens()).alias("cache_write_tokens"),
        _sum("credits", "double").alias("credits"),
        _sum("cost_usd", "double").alias("cost_usd"),
        _sum("active_ms").alias("active_ms"),
    ]


def totals(df: DataFrame) -> DataFrame:
    """One row of sums, zeros without rows."""
    return df.agg(*measures(), *E.speed_sums())


def _shares(df: DataFrame, name: Column, label: str) -> DataFrame:
    return (
        df.groupBy(name.alias(label))
        .agg(*measures(), _sum(E.headline_tokens()).alias("tokens"), *E.speed_sums())
        .orderBy(F.desc("cost_usd"), label)
    )


def by_app(df: DataFrame) -> DataFrame:
    """Sums by app, dearest first."""
    return _shares(df, F.col("app"), "app")


def by_model(df: DataFrame) -> DataFrame:
    """Sums by display model, dearest first."""
    return _shares(df, E.model_expr(), "name")


def dated(df: DataFrame) -> DataFrame:
    """Rows that have a start; the others are in no bucket."""
    return df.where(F.col("ts_start").isNotNull())


def daily_by_app(df: DataFrame, offset: str) -> DataFrame:
    day = E.date_of(E.day_index(F.col("ts_start"), offset))
    return dated(df).groupBy(day.alias("date"), "app").agg(*measures(), _sum(E.headline_tokens()).alias("tokens")).orderBy("date", "app")


def hourly_by_app(df: DataFrame, offset: str) -> DataFrame:
    return dated(df).groupBy(E.hour_label(F.col("ts_start"), offset).alias("hour"), "app").agg(*measures(), _sum(E.headline_tokens()).alias("tokens")).orderBy("hour", "app")


def bucket_label(offset: str, hourly: bool) -> Column:
    return E.hour_label(F.col("ts_start"), offset) if hourly else E.date_of(E.day_index(F.col("ts_start"), offset))


def bucket_models(df: DataFrame, offset: str, hourly: bool = False) -> DataFrame:
    """Events, tokens and cost by bucket (a day or an hour) and display model."""
    out = dated(df).groupBy(bucket_label(offset, hourly).alias("bucket"), E.model_expr().alias("model"))
    return out.agg(F.count("*").alias("events"), _sum(E.headline_tokens()).alias("tokens"), _sum("cost_usd", "double").alias("cost_usd")).orderBy("bucket", "model")


def trend_buckets(by_bucket: DataFrame, top: int = 20) -> DataFrame:
    """One row a bucket with its sums and its ``top`` models by tokens, an array of (model, tokens)."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("tokens"), "model"))
    named = by_bucket.withColumn("rank", rank)
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "model", "tokens"))))
    out = named.groupBy("bucket").agg(F.sum("events").alias("events"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), best.alias("best"))
    return out.withColumn("top", F.transform("best", lambda x: F.struct(x["model"].alias("model"), x["tokens"].alias("tokens")))).drop("best").orderBy("bucket")


def activity_daily(df: DataFrame, anchor_ms: int, offset: str, days: int = 365) -> DataFrame:
    """Events, tokens and cost of the last ``days`` days that have any."""
    today = (anchor_ms + E.offset_ms(offset)) // DAY_MS
    day = E.day_index(F.col("ts_start"), offset)
    recent = df.where(day.between(today - days + 1, today))
    return recent.groupBy(E.date_of(day).alias("date")).agg(F.count("*").alias("events"), _sum(E.headline_tokens()).alias("tokens"), _sum("cost_usd", "double").alias("cost_usd")).orderBy("date")


def activity_status(df: DataFrame, anchor_ms: int) -> DataFrame:
    """The latest start and whether it is within five minutes of the anchor."""
    latest = F.max("ts_start")
    return df.agg(latest.alias("latest_event_ms"), F.coalesce(F.abs(F.lit(anchor_ms) - latest) <= 300_000, F.lit(False)).alias("is_active"))


def hour_histogram(df: DataFrame, offset: str) -> DataFrame:
    return dated(df).groupBy(E.hour_of(F.col("ts_start"), offset).alias("hour")).agg(F.count("*").alias("events")).orderBy("hour")


def today_hours(df: DataFrame, anchor_ms: int, offset: str) -> DataFrame:
    """Today's sums by hour, app and model."""
    today = (anchor_ms + E.offset_ms(offset)) // DAY_MS
    rows = df.where(E.day_index(F.col("ts_start"), offset) == today)
    return rows.groupBy(E.hour_of(F.col("ts_start"), offset).alias("hour"), "app", E.model_expr().alias("model")).agg(*measures(), *E.speed_sums())


def app_names(df: DataFrame) -> DataFrame:
    return df.select("app").distinct().orderBy("app")


def model_names(df: DataFrame, apps: Sequence[str] | None = None) -> DataFrame:
    """Display models; they follow the app filter, not the model filter."""
    return scope(df, apps=apps).select(E.model_expr().alias("model")).distinct().orderBy("model")


def event_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("events"))


def unpriced(df: DataFrame) -> DataFrame:
    """Rows that should have a price and have none."""
    named = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.nullif(F.col("request_model"), F.lit("")))
    return df.where(F.col("pricing_model").isNull() & named.isNotNull() & has_tokens())


def has_tokens() -> Column:
    return (E.tokens_total() > 0) | (F.col("reasoning_tokens") > 0)


def unpriced_models(df: DataFrame) -> DataFrame:
    return unpriced(df).groupBy(E.model_expr().alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def speed_ranking(df: DataFrame, group_by: str = "model", metric: str = "output") -> DataFrame:
    """Rates by model or app, fastest first, unknown last, then by name."""
    if group_by not in ("", "model", "app") or metric not in SPEED_METRICS:
        raise ValueError(f"can't rank {group_by!r} by {metric!r}")
    name = F.col("app") if group_by == "app" else E.model_expr()
    rows = df.groupBy(name.alias("name")).agg(F.count("*").alias("events"), *E.speed_sums()).withColumns(E.speed_rates())
    return rows.orderBy(F.col(SPEED_METRICS[metric]).desc_nulls_last(), "name")


def page_of(df: DataFrame, page: int, size: int = 0, default: int = 25, most: int = 200) -> DataFrame:
    """One page of ordered rows; a page beyond the last is the last. Only a count reaches the driver."""
    size = default if size == 0 else min(max(size, 1), most)
    page = min(max(page, 0), max(0, df.count() - 1) // size)
    return df.offset(page * size).limit(size)


def events_page(df: DataFrame, page: int, size: int) -> DataFrame:
    """A page of rows, newest first."""
    size = min(max(size, 1), 1000)
    return df.orderBy(F.col("ts_start").desc_nulls_last(), "dedup_key").offset(max(page, 0) * size).limit(size)


def _with_rates(df: DataFrame, secs: Column) -> DataFrame:
    tokens = F.col("total_tokens")
    return df.withColumns(
        {
            "tokens_per_min": tokens / secs * 60,
            "tokens_per_sec": tokens / secs,
            "input_per_min": F.col("input_tokens") / secs * 60,
            "output_per_min": F.col("output_tokens") / secs * 60,
            "cost_per_hour": F.col("cost_usd") / secs * 3600,
            "requests_per_min": F.col("events") / secs * 60,
        }
    )


def rate_windows(df: DataFrame, anchor_ms: int) -> DataFrame:
    """Rates over the windows [anchor - w, anchor) that end at the anchor, one row each, in one pass over the last day."""
    widest = max(w for _, w in RATE_WINDOWS)
    recent = scope(df, anchor_ms - widest, anchor_ms)
    frames = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(w).cast("long").alias("ms")) for n, w in RATE_WINDOWS))
    rows = recent.withColumn("frame", F.explode(frames)).where(F.col("ts_start") >= anchor_ms - F.col("frame.ms"))
    sums = rows.groupBy(F.col("frame.window").alias("window")).agg(*measures(), _sum(E.headline_tokens()).alias("total_tokens"), *E.speed_sums())
    spark = df.sparkSession
    every = spark.createDataFrame([(n, w // 1000) for n, w in RATE_WINDOWS], "window string, window_secs long")
    zero = [c for c in sums.columns if c != "window"]
    dense = every.join(sums, "window", "left").fillna(0, zero)
    return _with_rates(dense, F.col("window_secs")).withColumns(E.speed_rates())


def _minutes(df: DataFrame, minute: Column) -> DataFrame:
    return df.groupBy(minute.alias("timestamp_ms")).agg(*measures(), _sum(E.headline_tokens()).alias("total_tokens"))


def rate_timeline(df: DataFrame, anchor_ms: int, offset: str = "+00:00") -> DataFrame:
    """Sixty minutes from anchor - 1 h, also those without rows."""
    first = anchor_ms - 3_600_000
    sums = _minutes(scope(df, first, anchor_ms), first + F.floor((F.col("ts_start") - first) / MINUTE_MS) * MINUTE_MS)
    spine = df.sparkSession.range(60).select((F.lit(first) + F.col("id") * MINUTE_MS).alias("timestamp_ms"))
    dense = densify(sums, spine, ["timestamp_ms"])
    label = F.date_format(F.timestamp_millis(F.col("timestamp_ms") + E.offset_ms(offset)), "HH:mm")
    return _with_rates(dense, F.lit(60)).withColumn("label", label).orderBy("timestamp_ms")


def peak_minute_1h(df: DataFrame, anchor_ms: int) -> DataFrame:
    """The busiest of the hour's minutes, the earliest of equals; zeros if all are empty."""
    best = rate_timeline(df, anchor_ms).orderBy(F.desc("total_tokens"), "timestamp_ms").limit(1)
    return best.withColumn("timestamp_ms", F.when(F.col("total_tokens") > 0, F.col("timestamp_ms")))


def peak_minute_24h(df: DataFrame, anchor_ms: int) -> DataFrame:
    """The busiest whole minute of the last day, ranked without unclassified tokens and reported with them; the earliest of equals."""
    sums = _minutes(scope(df, anchor_ms - DAY_MS, anchor_ms), F.floor(F.col("ts_start") / MINUTE_MS) * MINUTE_MS)
    ranked = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")
    return _with_rates(sums.orderBy(ranked.desc(), "timestamp_ms").limit(1), F.lit(60))


def _top_1h(df: DataFrame, anchor_ms: int, names: list[Column], limit: int) -> DataFrame:
    hour = scope(df, anchor_ms - 3_600_000, anchor_ms)
    sums = hour.groupBy(*names).agg(F.count("*").alias("events"), _sum(E.headline_tokens()).alias("total_tokens"), _sum("cost_usd", "double").alias("cost_usd"), *E.speed_sums())
    whole = hour.agg(_sum(E.headline_tokens()).alias("window_tokens"))
    share = F.when(F.col("window_tokens") > 0, F.col("total_tokens") / F.col("window_tokens") * 100).otherwise(0.0)
    # one row of sums beside each group
    out = sums.crossJoin(F.broadcast(whole)).withColumn("percentage", share).drop("window_tokens")
    out = out.withColumns({"tokens_per_min": F.col("total_tokens") / 60, "tokens_per_sec": F.col("total_tokens") / 3600})
    return out.withColumns(E.speed_rates()).orderBy(F.desc("total_tokens"), *(n for n in ("model", "app") if n in out.columns)).limit(limit)


def top_models_1h(df: DataFrame, anchor_ms: int, limit: int = 10) -> DataFrame:
    return _top_1h(df, anchor_ms, [E.model_expr().alias("model"), F.col("app")], limit)


def top_apps_1h(df: DataFrame, anchor_ms: int, limit: int = 10) -> DataFrame:
    return _top_1h(df, anchor_ms, [F.col("app")], limit)


def densify(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a row for every key of ``spine``, numbers that are missing being 0."""
    numbers = [f.name for f in df.schema if f.name not in keys and f.dataType.typeName() in ("long", "integer", "double")]
    return spine.join(df, keys, "left").fillna(0, numbers)


def position(bucket: Column) -> Column:
    """The number of a day ('YYYY-MM-DD') or an hour ('HH:00', or 'YYYY-MM-DD HH:00') bucket."""
    day = F.date_diff(F.to_date(F.substring(bucket, 1, 10)), F.lit("1970-01-01").cast("date"))
    return F.when(F.length(bucket) == 10, day).when(F.length(bucket) == 5, F.substring(bucket, 1, 2).cast("int")).otherwise(day * 24 + F.substring(bucket, 12, 2).cast("int"))


def moving_average(buckets: DataFrame, window: int = 7) -> DataFrame:
    """``buckets`` with the trailing average of tokens; missing buckets count as 0, and the divisor grows up to ``window``.

    There is one row a bucket of the calendar, so a single ordered window is small.
    """
    at = position(F.col("bucket"))
    run = Window.orderBy("position").rangeBetween(-(window - 1), 0)
    width = F.least(F.lit(window), F.col("position") - F.min("position").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return buckets.withColumn("position", at).withColumn("average", F.sum("tokens").over(run) / width).drop("position")


def drawn(averaged: DataFrame, cap: int = 60) -> DataFrame:
    """The last ``cap`` buckets; averages keep what came before."""
    return averaged.orderBy(F.desc("bucket")).limit(cap).orderBy("bucket")


def export_rows(df: DataFrame) -> DataFrame:
    """All rows, oldest first."""
    return df.orderBy(F.col("ts_start").asc_nulls_first(), "dedup_key")


def civil(day: int) -> str:
    return (date(1970, 1, 1) + timedelta(days=day)).isoformat()
