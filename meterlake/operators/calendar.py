"""Statistics of the activity calendar and of shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.schema import DAY_MS


def active_streaks(activity: DataFrame) -> DataFrame:
    """(first_date, last_date, days) of every run of active days; repeated dates count once."""
    days = activity.where("tokens > 0").select(F.to_date("date").alias("d")).distinct()
    # there are a few hundred days in a calendar, so one ordered window holds them
    island = F.date_sub("d", F.row_number().over(Window.orderBy("d")))
    runs = days.withColumn("island", island).groupBy("island").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("days"))
    return runs.select(F.date_format("a", "yyyy-MM-dd").alias("first_date"), F.date_format("b", "yyyy-MM-dd").alias("last_date"), "days")


def _week(anchor_ms: int, offset: str) -> tuple[int, Column]:
    """The Sunday that opens the 53 weeks, and each date's week from there."""
    today = (anchor_ms + E.offset_ms(offset)) // DAY_MS
    sunday = today - (today + 4) % 7 - 52 * 7
    day = F.date_diff(F.to_date("date"), F.lit("1970-01-01").cast("date"))
    return sunday, F.floor((day - sunday) / 7).cast("int")


def calendar_weeks(activity: DataFrame, anchor_ms: int, offset: str) -> DataFrame:
    _, week = _week(anchor_ms, offset)
    return activity.withColumn("week", week).where("week >= 0").groupBy("week").agg(F.sum("tokens").alias("tokens"), F.sum("events").alias("events")).orderBy("week")


def calendar_cumulative(activity: DataFrame) -> DataFrame:
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return activity.select("date", "tokens", F.sum("tokens").over(run).alias("cumulative"))


def calendar_intensity(activity: DataFrame) -> DataFrame:
    """Levels 0 to 4 of each day against the busiest."""
    most = F.max("tokens").over(Window.partitionBy())
    share = F.col("tokens") / F.col("most")
    level = F.when(F.col("tokens") <= 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return activity.withColumn("most", most).select("date", "tokens", level.cast("int").alias("level"))


def calendar_stats(activity: DataFrame, anchor_ms: int, offset: str) -> DataFrame:
    weeks = calendar_weeks(activity, anchor_ms, offset).agg(F.max("tokens").alias("max_week"))
    days = activity.agg(F.count_if(F.col("tokens") > 0).alias("active_days"), F.max("tokens").alias("max_day"), F.sum("tokens").alias("total"))
    return days.crossJoin(F.broadcast(weeks))  # one row each


def receipt(df: DataFrame, lines: int = 6) -> DataFrame:
    """Cache hits, dollars a million tokens, the largest app's share and how many models a receipt of ``lines`` leaves out."""
    tokens = F.sum(E.headline_tokens())
    fed = F.sum(F.col("input_tokens") + F.col("cache_read_tokens"))
    whole = df.agg(
        F.when(fed > 0, F.sum("cache_read_tokens") / fed * 100).otherwise(0.0).alias("cache_hit_pct"),
        F.when(tokens > 0, F.sum("cost_usd") / tokens * 1e6).otherwise(0.0).alias("usd_per_million"),
        F.greatest(F.count_distinct(E.model_expr()) - lines, F.lit(0)).alias("hidden_lines"),
    )
    apps = df.groupBy("app").agg(tokens.alias("t")).agg((F.max("t") / F.sum("t") * 100).alias("top_app_pct"))
    return whole.crossJoin(F.broadcast(apps))  # one row each


def pie_slices(shares: DataFrame, value: str = "tokens") -> DataFrame:
    """Shares of at least a ten-thousandth of the whole, largest first."""
    whole = shares.agg(F.sum(value).alias("_whole"))
    out = shares.crossJoin(F.broadcast(whole)).withColumn("percentage", F.col(value) / F.col("_whole") * 100).drop("_whole")  # one row
    return out.where((F.col(value) > 0.0001) & (F.col("percentage") >= 0.01)).orderBy(F.desc(value))


def top_k(df: DataFrame, value: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(value), name).limit(k)


def top_k_others(df: DataFrame, name: str, value: str, k: int = 4) -> DataFrame:
    """The ``k`` largest and the sum of the rest as 'others'; what is not above 0 is left out. ``df`` has a row a name."""
    kept = df.where(F.col(value) > 0)
    best = top_k(kept, value, name, k).select(F.col(name).alias("_best"), F.lit(True).alias("_is_best"))
    kept = kept.join(F.broadcast(best), F.col(name).eqNullSafe(F.col("_best")), "left")  # k rows
    label = F.when(F.col("_is_best"), F.col(name)).otherwise("others")
    return kept.groupBy(label.alias(name)).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def model_series(by_bucket: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` largest models' tokens in every bucket, 0 where a model has none."""
    best = top_k(by_bucket.groupBy("model").agg(F.sum("tokens").alias("all_tokens")), "all_tokens", "model", k).select("model")
    spine = by_bucket.select("bucket").distinct().crossJoin(F.broadcast(best))  # k rows beside each bucket
    return spine.join(by_bucket.select("bucket", "model", "tokens"), ["bucket", "model"], "left").fillna(0, ["tokens"])
