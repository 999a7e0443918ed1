"""Queries over log files that grow: they are written out from the given tables and read by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import ledger as L
from meterlake.plans.fixtures import DUCK_LEDGER, ledger
from meterlake.plans.stream_queries import new_folder
from meterlake.sources import ranges

_NO_CURSORS = "path string, last_byte_offset long, fingerprint string"


def _write_logs(rows: DataFrame, line: Column, path: str) -> None:
    """One file for each app, with its lines by event."""
    lines = rows.select("app", "event_id", line.alias("line")).repartition("app").sortWithinPartitions("app", "event_id")
    lines.select("app", "line").write.partitionBy("app").text(path)


def _line() -> Column:
    """Lines of some bytes beyond ASCII, some of them blank, some with a carriage return."""
    text = F.format_string('{"e":%d,"s":"%sé"}', "event_id", "session_id")
    return F.concat(F.when(F.col("event_id") % 17 == 0, "").otherwise(text), F.when(F.col("event_id") % 10 == 0, "\r").otherwise(""))


def _app() -> Column:
    return F.regexp_extract("path", "app=([^/]*)", 1)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines with their places, each file read in many ranges."""
    base = new_folder(spark, "logs")
    _write_logs(ledger(spark, sf_dir), _line(), f"{base}/logs")
    lines, _ = ranges.new_lines(spark, f"{base}/logs", spark.createDataFrame([], _NO_CURSORS), range_bytes=20_000)
    return lines.select(_app().alias("app"), "line_offset", "line")


def log_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files have got since a first pass, in batches of bounded bytes: one of them is as it was, one was rewritten.

    The first pass sees all events of one app and the lower half of the others'.
    """
    base = new_folder(spark, "appends")
    rows = ledger(spark, sf_dir)
    half = rows.agg(F.max("event_id")).first()[0] // 2
    first = rows.where((F.col("event_id") <= half) | (F.col("app") == "zcode"))
    _write_logs(first, F.when(F.col("app") == "cursor", F.regexp_replace(_line(), "e", "x")).otherwise(_line()), f"{base}/before")
    none = spark.createDataFrame([], _NO_CURSORS)
    cursors = L.advance(none, ranges.scan_plan(spark, f"{base}/before", none))
    _write_logs(rows, _line(), f"{base}/now")
    # a file that grew has the same path; these have the same app
    now = ranges.file_sizes(spark, f"{base}/now").select(_app().alias("app"), F.col("path").alias("now"))
    moved = cursors.withColumn("app", _app()).join(now, "app").select(F.col("now").alias("path"), "last_byte_offset", "fingerprint")
    ranges.scan_plan(spark, f"{base}/now", moved).write.parquet(f"{base}/plan")  # files are looked at once
    plan = spark.read.parquet(f"{base}/plan")
    ranges.batched(ranges.cut(plan, 5_000), 40_000).write.parquet(f"{base}/ranges")
    dealt = spark.read.schema("path string, start long, stop long, upto long, batch int").parquet(f"{base}/ranges")
    most = dealt.groupBy("batch").agg(F.sum(F.col("stop") - F.col("start")).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    ranges.read_ranges(dealt).write.parquet(f"{base}/lines")
    lines = spark.read.schema("path string, line_offset long, line string").parquet(f"{base}/lines")
    read = lines.groupBy(_app().alias("app")).agg(F.count("*").alias("n_lines"), F.sum("line_offset").alias("places"), F.sum(F.octet_length("line")).alias("bytes"))
    out = plan.select(_app().alias("app"), "action").join(read, "app", "left").na.fill(0, ["n_lines", "places", "bytes"])
    return out.withColumn("bounded", F.lit(most <= 40_000))


_LINE = """CASE WHEN event_id % 17 = 0 THEN '' ELSE '{"e":' || event_id::VARCHAR || ',"s":"' || session_id || 'é"}' END"""
_PLACED = f"""WITH {DUCK_LEDGER}, t AS (SELECT app, event_id, {_LINE} AS line, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS cr FROM ledger),
 o AS (SELECT *, coalesce(sum(strlen(line) + cr + 1) OVER (PARTITION BY app ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_offset FROM t)"""

QUERIES = {"log_lines": log_lines, "log_appends": log_appends}
ORACLES = {
    "log_lines": f"{_PLACED} SELECT app, line_offset, line FROM o WHERE line <> ''",
    "log_appends": f"""{_PLACED}, h AS (SELECT max(event_id) // 2 AS half FROM ledger)
 SELECT app, CASE app WHEN 'zcode' THEN 'Unchanged' WHEN 'cursor' THEN 'Pinned' ELSE 'Append' END AS action, count(*) FILTER (WHERE new) AS n_lines, coalesce(sum(line_offset) FILTER (WHERE new), 0)::BIGINT AS places,
 coalesce(sum(strlen(line)) FILTER (WHERE new), 0)::BIGINT AS bytes, true AS bounded FROM (SELECT o.*, line <> '' AND event_id > half AND app NOT IN ('zcode', 'cursor') AS new FROM o, h) GROUP BY app""",
}
