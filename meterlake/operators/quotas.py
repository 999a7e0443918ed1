"""Quota snapshots: the latest of each window, changes, ranking and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("app", "account", "window_kind")


def latest_quotas(quotas: DataFrame) -> DataFrame:
    """The newest snapshot of each key, a null account being a key; ties on time go to the largest id."""
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("captured_at"), F.desc("id")))
    return quotas.withColumn("_rank", newest).where("_rank = 1").drop("_rank")


def live(anchor_ms: int) -> Column:
    """Whether a window still runs: it has no reset, or one to come."""
    return F.col("resets_at").isNull() | (F.col("resets_at") >= anchor_ms)


def rank_quotas(quotas: DataFrame, anchor_ms: int) -> DataFrame:
    """Running windows first, then by used share, unknown shares last, then by app."""
    return quotas.withColumn("live", live(anchor_ms)).orderBy(F.desc("live"), F.col("used_percent").desc_nulls_last(), "app", "id")


def quota_groups(quotas: DataFrame, anchor_ms: int) -> DataFrame:
    """Per app its worst running share and its ranked windows; apps with a running window first."""
    row = F.struct((~F.col("live")).alias("ended"), (-F.col("used_percent")).alias("minus"), "id", "account", "window_kind", "used_percent", "resets_at")
    order = F.struct("ended", F.col("used_percent").isNull().alias("unknown"), (-F.col("used_percent")).alias("minus"), "id")
    rows = quotas.withColumn("live", live(anchor_ms)).withColumn("ended", ~F.col("live"))
    groups = rows.groupBy("app").agg(
        F.max(F.when(F.col("live"), F.col("used_percent"))).alias("worst_pct"), F.max("live").alias("live"), F.count("*").alias("windows"),
        F.array_sort(F.collect_list(F.struct(order.alias("order"), row.alias("row")))).alias("sorted"),
    )
    groups = groups.withColumn("rows", F.transform("sorted", lambda x: x["row"].dropFields("ended", "minus"))).drop("sorted")
    return groups.orderBy(F.desc("live"), F.col("worst_pct").desc_nulls_last(), "app")


def changed_only(quotas: DataFrame) -> DataFrame:
    """Snapshots that differ from the one before of their key."""
    order = Window.partitionBy(*KEY).orderBy("captured_at", "id")
    values = [c for c in ("used", "limit_value", "used_percent", "resets_at") if c in quotas.columns]
    now = F.struct(*values)
    return quotas.withColumns({"_before": F.lag(now).over(order), "_first": F.row_number().over(order) == 1}).where(F.col("_first") | ~now.eqNullSafe(F.col("_before"))).drop("_before", "_first")


def append_quotas(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new snapshots worth storing: those that differ from what comes before them, stored or new."""
    both = latest_quotas(stored).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return changed_only(both).where("_new").drop("_new")


def prune_quotas(quotas: DataFrame, cutoff_ms: int) -> DataFrame:
    """Snapshots from the cutoff on, and the last of each key."""
    last = F.max("id").over(Window.partitionBy(*KEY))
    return quotas.withColumn("_last", last).where((F.col("captured_at") >= cutoff_ms) | (F.col("id") == F.col("_last"))).drop("_last")
