"""Streaming queries run to their end over landed files; their final state has a SQL oracle."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.ledger import with_completeness
from meterlake.plans import source_queries, vendor_queries
from meterlake.plans.fixtures import DUCK_ARRIVALS, DUCK_LEDGER, OFFSET, arrivals, ledger
from meterlake.plans.oracles import _COMPLETE, _ROLL, _VALUES, DAY, HEAD
from meterlake.plans.queries import rounded
from meterlake.streaming import streams


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints, so that every executor sees it; of this machine only in a local session that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _keyed_state(spark: SparkSession):
    """Stateful processors keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sets of arrivals, each ingested once it has landed, then all read again from the start: the replay changes nothing."""
    base = new_folder(spark, "upsert")
    rows = arrivals(spark, sf_dir)
    source = None
    for seq in range(4):
        rows.where(F.col("seq") == seq).write.mode("append").parquet(f"{base}/in")
        source = streams.landed(spark, f"{base}/in", rows.schema)
        streams.ingest_stream(source, f"{base}/ledger", f"{base}/progress", reread=True).awaitTermination()
    streams.ingest_stream(source, f"{base}/ledger", f"{base}/again", reread=True).awaitTermination()
    return with_completeness(streams.read_ledger(spark, f"{base}/ledger")).select("dedup_key", *_VALUES.split(", "), "completeness")


def stream_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger after some of its rows have moved to other days, in one batch of many keys and one of a few; the index is compacted between."""
    base = new_folder(spark, "moves")
    rows = arrivals(spark, sf_dir).where("seq = 0")
    moved = lambda wave, by: wave.withColumns({"ts_start": F.col("ts_start") + by * 86_400_000, "output_tokens": F.lit(1).cast("long"), "seq": F.lit(by)})
    waves = (rows, moved(rows.where("event_id % 7 = 0"), 1), moved(rows.where("event_id % 700 = 0"), 3))
    for n, wave in enumerate(waves):
        wave.write.mode("append").parquet(f"{base}/in")
        streams.ingest_stream(streams.landed(spark, f"{base}/in", rows.schema), f"{base}/ledger", f"{base}/progress", OFFSET, f"{base}/rollups", reread=True).awaitTermination()
        if n == 1:
            streams.compact_keys(spark, f"{base}/ledger")
    kept = streams.read_ledger(spark, f"{base}/ledger").groupBy(E.day_index(F.col("ts_start"), OFFSET).cast("long").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("dedup_key").alias("keys"), F.sum("output_tokens").alias("output_tokens"))
    sums = streams.read_ledger(spark, f"{base}/rollups").groupBy(F.datediff(F.to_date("date"), F.lit("1970-01-01")).cast("long").alias("day")).agg(F.sum("events").cast("long").alias("rolled"))
    return kept.join(sums, "day", "left")


def stream_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups that the ingest keeps for the days that its batches touch: the poor arrivals, then the full ones of some days."""
    base = new_folder(spark, "rollups")
    rows = arrivals(spark, sf_dir)
    some = (F.col("seq") == 1) & (E.day_index(F.col("ts_start"), OFFSET) % 3 == 0)
    for wave in (F.col("seq") == 0, some):
        rows.where(wave).write.mode("append").parquet(f"{base}/in")
        source = streams.landed(spark, f"{base}/in", rows.schema)
        streams.ingest_stream(source, f"{base}/ledger", f"{base}/progress", OFFSET, f"{base}/rollups", reread=True).awaitTermination()
    return rounded(streams.read_ledger(spark, f"{base}/rollups"))


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity windows over the whole table; the sink keeps the windows, which are as many as hours."""
    base = new_folder(spark, "rates")
    rows = ledger(spark, sf_dir).select("ts_start", "input_tokens", "output_tokens", "cache_read_tokens", "unclassified_tokens", "cost_usd")
    rows.write.parquet(f"{base}/in")
    windows = streams.velocity_stream(streams.landed(spark, f"{base}/in", rows.schema), "3650 days", "1 hour", "1 hour")
    keep = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/out/{batch_id}")
    query = windows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress.batchId
    return spark.read.schema(windows.schema).parquet(f"{base}/out/{last}").withColumn("cost_usd", F.round("cost_usd", 8))


def stream_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows at three bounds of a batch's bytes; no batch of several files is above its bound."""
    base = new_folder(spark, "bounded")
    rows = ledger(spark, sf_dir).select("dedup_key", "output_tokens")
    rows.repartition(12, "dedup_key").write.parquet(f"{base}/in")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{base}/in").agg(F.max("length"), F.sum("length")).first()
    out = None
    for part, bound in enumerate((files[0] + 1, files[1] // 2, files[1] + 1)):
        source = streams.landed(spark, f"{base}/in", rows.schema, max_bytes=bound).withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")})

        def keep(batch: DataFrame, batch_id: int, part: int = part) -> None:
            batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out/{part}")

        query = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/progress/{part}").trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.parquet(f"{base}/out/{part}")
        sums = got.select("batch", "file", "size").distinct().groupBy("batch").agg(F.sum("size").alias("bytes"))
        largest, batches = sums.agg(F.max("bytes"), F.count("*")).first()
        bounded = largest <= bound and batches == (1 if part == 2 else max(batches, 2))
        got = got.agg(F.lit(part).alias("part"), F.count("*").alias("events"), F.countDistinct("dedup_key").alias("keys"), F.sum("output_tokens").alias("output_tokens")).withColumn("bounded", F.lit(bounded))
        out = got if out is None else out.unionByName(got)
    return out


#: Events of two hours, made dense enough for sliding minutes; the first and the late half; and one far later, which closes all windows.
_DENSE_MS, _FLUSH_MS = 7_200_000, 36_000_000


def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of 5, 15 and 60 minutes, sliding by one, in append mode; of the late rows those within the watermark count."""
    base = new_folder(spark, "velocity")
    c = F.col
    rows = ledger(spark, sf_dir).select("event_id", "input_tokens", "output_tokens", "cache_read_tokens", "unclassified_tokens", "cost_usd")
    rows = rows.withColumn("ts_start", (c("event_id") * 977) % _DENSE_MS)
    flush = rows.limit(1).withColumn("ts_start", F.lit(_FLUSH_MS).cast("long"))
    for wave in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), flush):
        wave.write.mode("append").parquet(f"{base}/in")
        running = []
        for width in (5, 15, 60):
            windows = streams.velocities(streams.landed(spark, f"{base}/in", rows.schema), width)
            to = windows.writeStream.format("parquet").option("path", f"{base}/out/{width}").option("checkpointLocation", f"{base}/progress/{width}")
            running.append(to.trigger(availableNow=True).start())
        for query in running:
            query.awaitTermination()
    return spark.read.schema(windows.schema).parquet(*(f"{base}/out/{width}" for width in (5, 15, 60))).withColumn("cost_usd", F.round("cost_usd", 8))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive in any order, old ones and ones without a time last, some of them twice: each is let through once."""
    base = new_folder(spark, "late")
    rows = ledger(spark, sf_dir).select("dedup_key", "event_id", "ts_start", "output_tokens")
    late = F.when(F.col("ts_start").isNull(), 2).otherwise(1 - F.floor(F.col("event_id") / 500) % 2)
    waves = [rows.where(late == 0), rows.where(late <= 1), rows]
    for wave in waves:
        wave.write.mode("append").parquet(f"{base}/in")
        once = streams.without_repeats(streams.landed(spark, f"{base}/in", rows.schema))
        once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest point of each series after points have come in two waves, the newer first."""
    base = new_folder(spark, "metrics")
    c = F.col
    points = ledger(spark, sf_dir).where("ts_start IS NOT NULL").select(F.lit("tokens").alias("metric"), "session_id", c("app").alias("attr_sig"), c("ts_start").alias("ts_ms"), (c("ts_start") % 1_000_003).cast("double").alias("value"))
    with _keyed_state(spark):
        for newer in (True, False):
            points.where((F.floor(c("ts_ms") / 3_600_000) % 3 == 0) == newer).write.mode("append").parquet(f"{base}/in")
            changes = streams.metric_stream(streams.landed(spark, f"{base}/in", points.schema))
            keep = lambda batch, batch_id: batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")
            changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")  # what was emitted last, whatever it says
    return out.groupBy("metric", "session_id", "attr_sig").agg(F.max_by("ts_ms", "batch").alias("ts_ms"), F.max_by("value", "batch").alias("value"))


def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the time of the question before, where files grow between batches."""
    base = new_folder(spark, "parse")
    c = F.col
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = turns.select(F.concat(F.lit("/c/"), c("conv_id").cast("string")).alias("path"), c("turn").cast("long").alias("line_offset"), c("role").alias("kind"), (c("turn") * 1000 + 5).cast("long").alias("ts"))
    with _keyed_state(spark):
        for wave in (lines.where("line_offset < 3"), lines.where("line_offset >= 3")):
            wave.write.mode("append").parquet(f"{base}/in")
            parsed = streams.stateful_parse(streams.landed(spark, f"{base}/in", lines.schema))
            parsed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "line_offset", "ts", "asked")


def _in_segments(spark: SparkSession, rows: DataFrame, at: str, cuts: tuple[int, ...], parse) -> DataFrame:
    """What ``parse`` makes of rows that come in segments of their files, cut at these places."""
    base = new_folder(spark, "segments")
    with _keyed_state(spark):
        for low, high in zip((None, *cuts), (*cuts, None), strict=True):
            part = rows if low is None else rows.where(F.col(at) >= low)
            (part if high is None else part.where(F.col(at) < high)).write.mode("append").parquet(f"{base}/in")
            parsed = parse(streams.landed(spark, f"{base}/in", rows.schema))
            parsed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(f"{base}/out")


def stream_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codex logs in three segments: the model, what was asked and what was answered come before the count."""
    return source_queries.shown(_in_segments(spark, source_queries.codex_log(spark, sf_dir), "line_offset", (150, 250), streams.codex_stream))


def stream_kiro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kiro sessions in three segments: a turn is opened in the first, used in the second and closed in the third."""
    return vendor_queries.kiro_shown(_in_segments(spark, vendor_queries.kiro_marks(spark, sf_dir), "offset", (50, 150), streams.kiro_stream))


QUERIES = {"stream_upsert": stream_upsert, "stream_rollups": stream_rollups, "stream_moves": stream_moves, "stream_rates": stream_rates, "stream_late": stream_late, "stream_bounded": stream_bounded, "stream_velocity": stream_velocity, "stream_metrics": stream_metrics, "stream_parse": stream_parse, "stream_codex": stream_codex, "stream_kiro": stream_kiro}
ORACLES = {
    "stream_codex": source_queries.ORACLES["normalize_codex"],
    "stream_kiro": vendor_queries.ORACLES["normalize_kiro_ide"],
    "stream_upsert": f"""WITH {DUCK_ARRIVALS}, u AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_COMPLETE} DESC, seq DESC) AS k, {_COMPLETE} AS completeness FROM arrivals)
 SELECT dedup_key, {_VALUES}, completeness FROM u WHERE k = 1""",
    "stream_rates": f"""WITH {DUCK_LEDGER} SELECT (ts_start // 3600000 * 3600000)::BIGINT AS start_ms, (ts_start // 3600000 * 3600000 + 3600000)::BIGINT AS end_ms, COUNT(*) AS events,
 SUM({HEAD})::BIGINT AS tokens, ROUND(SUM(cost_usd), 8) AS cost_usd FROM ledger WHERE ts_start IS NOT NULL GROUP BY 1, 2""",
    "stream_moves": f"""WITH {DUCK_ARRIVALS}, m AS (SELECT dedup_key, CASE WHEN event_id % 7 = 0 THEN 1 ELSE output_tokens END AS output_tokens,
 {DAY} + CASE WHEN event_id % 700 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS d FROM arrivals WHERE seq = 0)
 SELECT d::BIGINT AS day, COUNT(*) AS events, COUNT(DISTINCT dedup_key) AS keys, SUM(output_tokens)::BIGINT AS output_tokens, CASE WHEN d IS NOT NULL THEN COUNT(*) END::BIGINT AS rolled FROM m GROUP BY d""",
    "stream_bounded": f"WITH {DUCK_LEDGER} SELECT part, COUNT(*) AS events, COUNT(DISTINCT dedup_key) AS keys, SUM(output_tokens)::BIGINT AS output_tokens, true AS bounded FROM ledger, (SELECT unnest([0, 1, 2])::INT AS part) GROUP BY part",
    "stream_velocity": f"""WITH {DUCK_LEDGER}, r AS (SELECT *, (event_id * 977) % {_DENSE_MS} AS ts FROM ledger), w AS (SELECT max(ts) - 1800000 AS mark FROM r WHERE event_id % 2 = 0),
 p AS (SELECT ts // 60000 AS minute, COUNT(*) AS events, SUM({HEAD})::BIGINT AS tokens, SUM(cost_usd) AS cost_usd FROM r, w WHERE event_id % 2 = 0 OR (ts // 60000 + 1) * 60000 > mark GROUP BY 1),
 s AS (SELECT width, minute - back AS first, events, tokens, cost_usd FROM p, (SELECT unnest([5, 15, 60]) AS width), unnest(range(0, width)) AS u(back))
 SELECT width::INT AS minutes, (first * 60000)::BIGINT AS start_ms, ((first + width) * 60000)::BIGINT AS end_ms, SUM(events)::BIGINT AS events, SUM(tokens)::BIGINT AS tokens, ROUND(SUM(cost_usd), 8) AS cost_usd FROM s GROUP BY 1, 2, 3""",
    "stream_rollups": f"""WITH {DUCK_ARRIVALS}, u AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY {_COMPLETE} DESC, seq DESC) AS k FROM arrivals WHERE seq = 0 OR seq = 1 AND {DAY} % 3 = 0)
 {_ROLL.replace('FROM ledger', 'FROM (SELECT * FROM u WHERE k = 1)')} GROUP BY 1, 2, 3, 4, 5""",
    "stream_late": f"WITH {DUCK_LEDGER} SELECT dedup_key, event_id, ts_start, output_tokens FROM ledger",
    "stream_metrics": f"WITH {DUCK_LEDGER} SELECT 'tokens' AS metric, session_id, app AS attr_sig, MAX(ts_start) AS ts_ms, (MAX(ts_start) % 1000003)::DOUBLE AS value FROM ledger WHERE ts_start IS NOT NULL GROUP BY 2, 3",
    "stream_parse": """SELECT '/c/' || t.conv_id::VARCHAR AS path, t.turn::BIGINT AS line_offset, (t.turn * 1000 + 5)::BIGINT AS ts, (u.turn * 1000 + 5)::BIGINT AS asked FROM conversations t
 ASOF LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user') u ON t.conv_id = u.conv_id AND t.turn >= u.turn WHERE t.role <> 'user'""",
}
