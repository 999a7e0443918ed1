"""Joins of the ledger: as-of lookups, coverage of traces, ownership, reconciliation of two ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.metrics import totals
from meterlake.schema import DAY_MS

#: Parts into which the rows of a key are dealt, where a key may have very many.
SPREAD = 64


def asof_join(rows: DataFrame, changes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``rows`` with the value of the latest change of the same key at or before each row's time.

    Both sides meet in one sorted pass; nothing is expanded.
    """
    left = rows.select("*", F.lit(None).cast(changes.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    right = changes.select(F.col(key), F.col(ts), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_side = 1").drop("_side", "_value")


def carry_forward(column: Column, part: list[str], order: list) -> Column:
    """The last value so far that is not null."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def drop_repeats(df: DataFrame, part: list[str], order: list, columns: list[str]) -> DataFrame:
    """Rows that differ from the one before in some of ``columns``."""
    run = Window.partitionBy(*part).orderBy(*order)
    now = F.struct(*columns)
    return df.withColumns({"_before": F.lag(now).over(run), "_first": F.row_number().over(run) == 1}).where(F.col("_first") | ~now.eqNullSafe(F.col("_before"))).drop("_before", "_first")


def new_era_first(newer: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """All newer rows and the older ones whose key they lack; null keys match nothing."""
    return newer.unionByName(older.join(newer.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*newer.columns), allowMissingColumns=True)


def keep_first_owner(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """New rows but those whose key another session already has in the ledger."""
    owned = ledger.select(F.col("dedup_key").alias("_key"), F.col("session_id").alias("_owner"))
    return new.join(owned, (F.col("dedup_key") == F.col("_key")) & ~F.col("session_id").eqNullSafe(F.col("_owner")), "left_anti")


def vanished(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that were there before and are gone."""
    return previous.select(key).join(current.select(key), key, "left_anti").distinct()


def map_names(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``column`` through a (name, target) dictionary; names it lacks stay."""
    dictionary = names.select(F.col("name").alias("_name"), F.col("target").alias("_target"))
    return df.join(dictionary, F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_target", column)).drop("_name", "_target")


def to_currency(df: DataFrame, rates: DataFrame, code: str) -> DataFrame:
    """Costs in another currency; an unknown one converts at 1."""
    rate = rates.where(F.col("currency") == code).agg(F.coalesce(F.max("rate"), F.lit(1.0)).alias("_rate"))
    return df.crossJoin(F.broadcast(rate)).withColumn("cost", F.col("cost_usd") * F.col("_rate")).drop("_rate")  # one row


def counted_upto(points: DataFrame, rows: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """``points`` with _n and _sum: how many ``rows`` of the same key stand at or before their time, and their values' sum.

    Rows are summed up by key and day, then within the days that points fall on, so a key of very many rows is spread
    over its days and nothing is paired.
    """
    day = F.floor(F.col(ts) / DAY_MS)
    r = rows.select(*key, F.col(ts).alias("_at"), day.alias("_day"), F.col(value).alias("_value"), F.lit(1).alias("_n"))
    p = points.withColumns({"_at": F.col(ts), "_day": day})
    days = r.groupBy(*key, "_day").agg(F.count("*").alias("_n"), F.sum("_value").alias("_value"))
    days = days.unionByName(p.select(*key, "_day").distinct().withColumns({"_n": F.lit(0).cast("long"), "_value": F.lit(0).cast(days.schema["_value"].dataType)}))
    before = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.groupBy(*key, "_day").agg(F.sum("_n").alias("_n"), F.sum("_value").alias("_value"))  # a key has no more rows here than the calendar days
    days = days.select(*key, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"), F.coalesce(F.sum("_value").over(before), F.lit(0)).alias("_before"))
    both = p.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*key, "_day").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_n": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_sum": F.coalesce(F.sum("_value").over(upto), F.lit(0))}).where("_side = 1")
    found = seen.join(days, [*key, "_day"], "left")
    total = {"_n": F.col("_n") + F.coalesce("_n_before", F.lit(0)), "_sum": F.col("_sum") + F.coalesce("_before", F.lit(0))}
    return found.withColumns(total).select(*points.columns, "_n", "_sum")


def subtract_coverage(traces: DataFrame, exact: DataFrame) -> DataFrame:
    """Traces minus what exact rows of the same time already account for.

    ``traces`` has (trace_id, session_id, start_ms, end_ms, model, total, input, output, cached), ``exact`` rows
    (session_id, model, ts_start, tokens). A trace with a session meets that session's rows without a start or inside its
    span; one without meets all rows inside its span, of its model if it has one. A trace that exact rows cover, or one
    without a session that meets any, is dropped; what is left of the others is unclassified unless nothing was
    subtracted and its own split adds up. What lies in a span is what lies before its end less what lies before its start.
    """
    named = F.col("session_id").isNotNull()
    kind = F.when(named, "session").when(F.col("model").isNotNull(), "model").otherwise("all")
    spans = traces.select("trace_id", kind.alias("kind"), F.coalesce("session_id", "model", F.lit("")).alias("of"), "start_ms", "end_ms").where("end_ms >= start_ms")
    points = spans.select("trace_id", "kind", "of", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("end_ms").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("start_ms") - 1).alias("at")))).alias("p"))
    points = points.select("trace_id", "kind", "of", "p.sign", "p.at")
    keys = F.array(
        F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("of")), F.struct(F.lit("model").alias("kind"), F.col("model").alias("of")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("of"))
    )
    rows = exact.where("ts_start IS NOT NULL").select(F.explode(keys).alias("k"), F.col("ts_start").alias("at"), "tokens").select("k.*", "at", "tokens").where("of IS NOT NULL")
    # of models and of all, only what some trace asks for; few kinds of keys are asked for by name
    # keys but sessions may have very many rows, which are spread; they are asked for once in each part
    hot = F.col("kind") != "session"
    rows = rows.withColumn("part", F.when(hot, F.pmod("at", F.lit(SPREAD))).otherwise(0).cast("int"))
    asked = points.select("kind", "of").distinct().withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    rows = rows.join(asked, ["kind", "of", "part"], "left_semi").drop("part")
    met = counted_upto(points, rows, ["kind", "of"], "at", "tokens")
    met = met.select("trace_id", (F.col("sign") * F.col("_n")).alias("n"), (F.col("sign") * F.col("_sum")).alias("tokens"))
    untimed = exact.where("ts_start IS NULL").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    met = met.unionByName(traces.where(named).select("trace_id", "session_id").join(untimed, "session_id").select("trace_id", "n", "tokens"))
    covered = met.groupBy("trace_id").agg(F.sum("n").alias("exact_rows"), F.sum("tokens").alias("exact_tokens"))
    both = traces.join(covered, "trace_id", "left").fillna(0, ["exact_rows", "exact_tokens"])
    gone = (F.col("exact_rows") > 0) & (F.col("session_id").isNull() | (F.col("exact_tokens") >= F.col("total")))
    split = (F.col("exact_tokens") == 0) & (F.col("input") + F.col("output") == F.col("total")) & (F.col("cached") <= F.col("input"))
    split = F.coalesce(split, F.lit(False))
    return both.where(~gone & (F.col("total") > 0)).select(
        "trace_id", "session_id", "model", "start_ms", "end_ms",
        F.when(split, F.col("input") - F.col("cached")).otherwise(0).cast("long").alias("input_tokens"),
        F.when(split, F.col("output")).otherwise(0).cast("long").alias("output_tokens"),
        F.when(split, F.col("cached")).otherwise(0).cast("long").alias("cache_read_tokens"),
        F.when(split, 0).otherwise(F.greatest(F.col("total") - F.col("exact_tokens"), F.lit(0))).cast("long").alias("unclassified_tokens"),
    )


def _off(ours: Column, theirs: Column) -> Column:
    """How many percent ours is off; null against nothing."""
    return F.when(theirs != 0, F.abs(ours - theirs) / theirs * 100)


def reconcile_totals(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Totals of two ledgers beside each other, and how far they differ."""
    columns = ("cache_read_tokens", "output_tokens", "cost_usd")
    a, b = (totals(df).select(*(F.col(c).alias(f"{side}_{c}") for c in columns)) for side, df in (("our", ours), ("their", theirs)))
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.withColumns({f"{c}_off_pct": _off(F.col(f"our_{c}"), F.col(f"their_{c}")) for c in columns})


def norm_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\")))


def reconcile_watermarks(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Token counters by file of two ledgers (path, tokens) over the files both have, and the files only one has."""
    a = ours.select(norm_path(F.col("path")).alias("path"), F.col("tokens").alias("our"))
    b = theirs.where("tokens > 0").select(norm_path(F.col("path")).alias("path"), F.col("tokens").alias("their"))
    both = a.join(b, "path", "full_outer")
    met = F.col("our").isNotNull() & F.col("their").isNotNull()
    sums = both.agg(
        F.count_if(met).alias("joined"), F.coalesce(F.sum(F.when(met, F.col("our"))), F.lit(0)).alias("our_tokens"), F.coalesce(F.sum(F.when(met, F.col("their"))), F.lit(0)).alias("their_tokens"),
        F.count_if(F.col("their").isNull()).alias("only_ours"), F.count_if(F.col("our").isNull()).alias("only_theirs"),
    )
    return sums.withColumn("off_pct", _off(F.col("our_tokens"), F.col("their_tokens")))


def source_health(sources: DataFrame, cursors: DataFrame) -> DataFrame:
    """Sources with how many files are tracked of each."""
    tracked = cursors.groupBy("source").agg(F.count("*").alias("tracked_files"))
    return sources.join(tracked, "source", "left").fillna(0, ["tracked_files"]).orderBy("source")


def day_ranges(days: DataFrame) -> DataFrame:
    """Consecutive days as (first_day, last_day); there are as many days as the calendar has."""
    distinct = days.select("day").distinct()
    island = F.col("day") - F.row_number().over(Window.orderBy("day"))
    return distinct.withColumn("_island", island).groupBy("_island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("_island")


def exact_tokens() -> Column:
    return E.tokens_total()
