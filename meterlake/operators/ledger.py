"""Maintenance of the ledger: gates, upserts, rollups, retention and incremental read plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.schema import TOKEN_COLUMNS

ROLLUP_KEYS = ("date", "app", "provider_id", "request_model", "pricing_model")
#: Columns of an arrival that are not the row's content.
_ARRIVAL = ("seq", "completeness")


def gate(df: DataFrame, metadata_apps: Sequence[str] = ()) -> DataFrame:
    """Billable rows, and of sources that report metadata alone also those with a start."""
    metadata = F.col("app").isin(list(metadata_apps)) & F.col("ts_start").isNotNull() if metadata_apps else F.lit(False)
    return df.where(E.billable() | metadata)


def with_completeness(df: DataFrame) -> DataFrame:
    return df.withColumn("completeness", E.completeness())


def fold(arrivals: DataFrame) -> DataFrame:
    """The row that is left of each dedup_key after its arrivals in order of seq.

    An arrival replaces what is stored if it is at least as complete, so the most complete one stays, the latest of
    equals; the app stays that of the first arrival. Revisions are folded before the one shuffle, without a sort.
    """
    ranked = with_completeness(arrivals)
    rest = [c for c in ranked.columns if c not in ("dedup_key", "app")]
    best = F.max_by(F.struct(*rest), F.struct("completeness", "seq")).alias("_best")
    folded = ranked.groupBy("dedup_key").agg(best, F.min_by("app", "seq").alias("app"))
    return folded.select(*(F.col(c) if c in ("dedup_key", "app") else F.col(f"_best.{c}").alias(c) for c in ranked.columns))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` after the arrivals of ``incoming``, which has a seq from 0."""
    return fold(stored.withColumn("seq", F.lit(-1)).unionByName(incoming, allowMissingColumns=True))


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*_ARRIVAL, "dedup_key", "app", "event_id")]


def upsert_outcome(stored: DataFrame, incoming: DataFrame, offset: str) -> DataFrame:
    """By local day of the incoming rows: keys written and merged away, and whether a row without a start was written."""
    after = fold(incoming)
    same = _content(stored)
    before = with_completeness(stored).select("dedup_key", F.struct(*same).alias("_old"), F.col("completeness").alias("_old_completeness"))
    joined = after.join(before, "dedup_key", "left").withColumn("_new", F.struct(*same))
    written = F.col("_old_completeness").isNull() | ((F.col("completeness") >= F.col("_old_completeness")) & ~F.col("_new").eqNullSafe(F.col("_old")))
    day = E.date_of(E.day_index(F.col("ts_start"), offset))
    return joined.groupBy(day.alias("date")).agg(
        F.count_if(written).alias("written"), F.count_if(~written).alias("merged"), F.max(written & F.col("ts_start").isNull()).alias("needs_full_rollup")
    )


def replace_by_key(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The latest arrival of each key, complete or not: for sources that revise their rows in place."""
    every = incoming if stored is None else stored.withColumn("seq", F.lit(-1)).unionByName(incoming, allowMissingColumns=True)
    return every.withColumn("_rank", F.row_number().over(Window.partitionBy("dedup_key").orderBy(F.desc("seq")))).where("_rank = 1").drop("_rank")


def rollups(df: DataFrame, offset: str) -> DataFrame:
    """Daily sums by date, app, provider, requested and priced model; missing names are ''."""
    named = df.where(F.col("ts_start").isNotNull())
    name = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    keys = [E.date_of(E.day_index(F.col("ts_start"), offset)).alias("date"), *(name(c).alias(c) for c in ROLLUP_KEYS[1:])]
    zero = lambda c, kind="long": F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return named.groupBy(*keys).agg(F.count("*").alias("events"), *(zero(c) for c in TOKEN_COLUMNS), zero("credits", "double"), zero("cost_usd", "double"), zero("active_ms"))


def rollup_days(df: DataFrame, days: Sequence[int], offset: str) -> DataFrame:
    """Rollups of some days only."""
    return rollups(df.where(E.day_index(F.col("ts_start"), offset).isin(list(days))), offset)


def write_rollups(rolled: DataFrame, path: str) -> None:
    """Replace the written dates, and no others."""
    rolled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def prune(df: DataFrame, cutoff_ms: int) -> DataFrame:
    """Rows from the cutoff on; rows without a start stay."""
    return df.where(F.col("ts_start").isNull() | (F.col("ts_start") >= cutoff_ms))


def archive(df: DataFrame, cold: DataFrame | None, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the cold table, rows that stay): rows before the cutoff that it doesn't hold yet go there."""
    old = df.where(F.col("ts_start") < cutoff_ms)
    return (old if cold is None else old.join(cold.select("dedup_key"), "dedup_key", "left_anti")), prune(df, cutoff_ms)


def delete_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("dedup_key").distinct(), "dedup_key", "left_anti")


def delete_app(df: DataFrame, app: str) -> DataFrame:
    return df.where(~F.col("app").eqNullSafe(F.lit(app)))


def repair_reasoning(df: DataFrame, app: str) -> DataFrame:
    """One app's output tokens with its reasoning tokens, which it reports apart."""
    return df.withColumn("output_tokens", F.when(F.col("app") == app, F.col("output_tokens") + F.col("reasoning_tokens")).otherwise(F.col("output_tokens")))


def repair_reread(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows but those that came from these files, which will be read again."""
    path = F.element_at(F.split("raw_ref", "#"), 1)
    return df.withColumn("_path", path).join(paths.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti").drop("_path")


#: Bytes before a place in a file that are hashed to tell whether the file still is what it was.
TAIL_BYTES = 256


def file_tails(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """(path, length, before, tail) of files (path, content binary): hashes of the bytes before the cursor's place and before the end."""
    known = cursors.select("path", F.col("last_byte_offset").alias("_at"))
    joined = files.select("path", "content", F.length("content").cast("long").alias("length")).join(known, "path", "left")
    upto = lambda end: F.sha2(F.substring("content", F.greatest(end - (TAIL_BYTES - 1), F.lit(1)).cast("int"), F.least(end, F.lit(TAIL_BYTES)).cast("int")), 256)
    return joined.select("path", "length", F.when(F.col("length") >= F.col("_at"), upto(F.col("_at"))).alias("before"), upto(F.col("length")).alias("tail"))


def read_plan(tails: DataFrame, cursors: DataFrame) -> DataFrame:
    """What to read of each file: (path, action, from_offset, length, tail).

    ``tails`` has (path, length, before, tail) as of file_tails, ``cursors`` (path, last_byte_offset, fingerprint); no
    content is looked at. A file without a cursor is read in Full, if it isn't empty. A file as long as its cursor is
    Unchanged. A longer one is Append if the bytes before the cursor are what they were. All else was cut or rewritten: it
    is Pinned to its end, never replayed, and appended to from there once it grows.
    """
    known = cursors.select("path", "last_byte_offset", "fingerprint")
    joined = tails.select("path", "length", "before", "tail").join(known, "path", "left")
    at, length = F.coalesce("last_byte_offset", F.lit(0)), F.col("length")
    fresh = (at == 0) & F.col("fingerprint").isNull()
    action = (
        F.when(fresh, F.when(length == 0, "Unchanged").otherwise("Full")).when(length < at, "Pinned").when(length == at, "Unchanged")
        .when(F.col("before").eqNullSafe(F.col("fingerprint")), "Append").otherwise("Pinned")
    )
    start = F.when(F.col("action") == "Full", 0).when(F.col("action") == "Append", at).otherwise(length)
    return joined.withColumn("action", action).select("path", "action", start.cast("long").alias("from_offset"), "length", "tail")


def advance(cursors: DataFrame, plan: DataFrame) -> DataFrame:
    """The cursors after a plan's rows are in the ledger, pinned ones at their files' ends; a file read again before that changes nothing."""
    done = plan.where("action <> 'Unchanged'").select("path", F.col("length").alias("last_byte_offset"), F.col("tail").alias("fingerprint"))
    return cursors.join(done.select("path"), "path", "left_anti").select(*done.columns).unionByName(done)


def batch_report(outcome: DataFrame) -> DataFrame:
    """(source, ingested, merged, skipped) from flags by row: written, merged, gated."""
    return outcome.groupBy("source").agg(F.count_if("written").alias("ingested"), F.count_if("merged").alias("merged"), F.count_if("gated").alias("skipped"))


#: The export's columns, in order.
CSV_COLUMNS = (
    "ts", "app", "model", "pricing_model", "project", "session", "input", "output", "reasoning", "cache_read", "cache_write", "credits", "cost_usd", "cost_source", "duration_ms", "raw_ref",
    "unclassified_tokens", "speed_tps",
)


def export_csv(df: DataFrame, path: str, offset: str = "+00:00") -> None:
    """The ledger as a folder of CSV parts, oldest first, that make one file when they are put together: only the first begins with the header.

    Cells are guarded and quoted by csv_rows, so lines are written as they are.
    """
    order = [F.col("_part"), F.col("_at").asc_nulls_first(), F.col("_key")]
    cells = _csv_cells(df, offset)
    line = F.concat_ws(",", *(cells[c] for c in CSV_COLUMNS)).alias("value")
    rows = df.select(F.lit(1).alias("_part"), F.col("ts_start").alias("_at"), F.col("dedup_key").alias("_key"), line)
    head = df.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(None).cast("long").alias("_at"), F.lit("").alias("_key"), F.lit(",".join(CSV_COLUMNS)).alias("value"))
    head.unionByName(rows).orderBy(*order).select("value").write.mode("overwrite").text(path)


def csv_rows(df: DataFrame, offset: str = "+00:00") -> DataFrame:
    """The export's 18 text columns, oldest first: credits with 4 decimals, costs with 6 and rates with 3; what is null is empty.

    Times are local ones of ``offset``; a row without a time has that of 1970. Text cells are guarded and quoted.
    """
    cells = _csv_cells(df, offset)
    return df.orderBy(F.col("ts_start").asc_nulls_first(), "dedup_key").select(*(cells[c].alias(c) for c in CSV_COLUMNS))


def _csv_cells(df: DataFrame, offset: str) -> dict[str, Column]:
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    none = lambda value: F.coalesce(value.cast("string"), F.lit(""))
    number = lambda value, d: none(F.regexp_replace(F.format_number(value, d), ",", ""))
    ms = F.coalesce("ts_start", F.lit(0)) + E.offset_ms(offset)
    return {
        "ts": F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset)),
        **{c: E.csv_guard(have(c)) for c in ("app", "model", "pricing_model", "project")}, "session": E.csv_guard(have("session_id")),
        "input": none(F.col("input_tokens")), "output": none(F.col("output_tokens")), "reasoning": none(F.col("reasoning_tokens")),
        "cache_read": none(F.col("cache_read_tokens")), "cache_write": none(E.cache_write_tokens()), "credits": number(F.col("credits").cast("double"), 4),
        "cost_usd": number(F.col("cost_usd"), 6), "cost_source": none(have("cost_source")), "duration_ms": none(F.col("duration_ms")), "raw_ref": E.csv_guard(have("raw_ref")),
        "unclassified_tokens": none(F.col("unclassified_tokens")), "speed_tps": number(E.output_tps(), 3),
    }
