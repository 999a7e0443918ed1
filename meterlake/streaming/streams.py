"""Structured Streaming over landed rows: incremental upserts, latest metrics and velocity windows.

Ingest has no event-time watermark, since late rows must not be lost; a replayed batch changes nothing, because the
upsert is idempotent. Only the velocity windows have one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from meterlake.functions import exprs as E
from meterlake.operators.ledger import fold, gate, rollups, with_completeness
from meterlake.sources import logs, tables


def landed(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """A stream of Parquet files that land in a folder, at most ``max_files``, or files of ``max_bytes`` together, a batch (a larger file alone)."""
    reader = spark.readStream.schema(schema)
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        if value:
            reader = reader.option(name, value)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath)


#: A list of days: a row for each day, with the version that it was last written in.
_DAYS = "day bigint, version bigint"


def _versions(spark: SparkSession, sink: str) -> tuple[int, dict[int | None, int]]:
    """The newest complete version of a ledger, and the version that each of its days was last written in."""
    versions = []
    if _exists(spark, sink):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(sink)
        fs = jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for status in fs.listStatus(jpath):
            name = status.getPath().getName()
            if name.startswith("days") and _exists(spark, f"{sink}/{name}/_SUCCESS"):
                versions.append(int(name[4:]))
    newest = max(versions, default=-1)
    # a row for each day: as many as the calendar has
    return newest, {r.day: r.version for r in spark.read.schema(_DAYS).parquet(f"{sink}/days{newest:08d}").collect()} if versions else {}


def _written_days(spark: SparkSession, path: str) -> set[int | None]:
    """The days that a version's folder has rows of, by the names of its parts."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = {x.getPath().getName() for x in jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(jpath)}
    values = {name.removeprefix("day=") for name in names if name.startswith("day=")}
    return {None if value == "__HIVE_DEFAULT_PARTITION__" else int(value) for value in values}


def _folders(sink: str, days: dict[int | None, int]) -> list[str]:
    name = lambda day: "__HIVE_DEFAULT_PARTITION__" if day is None else day
    return [f"{sink}/v{version:08d}/day={name(day)}" for day, version in sorted(days.items(), key=str)]


def _read_days(spark: SparkSession, sink: str, days: dict[int | None, int]) -> DataFrame | None:
    return spark.read.parquet(*_folders(sink, days)) if days else None


def read_ledger(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of a ledger that merge_batch keeps, or of its rollups."""
    table = _read_days(spark, sink, _versions(spark, sink)[1])
    if table is None:
        raise FileNotFoundError(sink)
    return table


def _write_days(spark: SparkSession, sink: str, rows: DataFrame, touched: Collection[int | None], first: Callable[[DataFrame], None] | None = None) -> None:
    """The next version: ``rows``, as they are dealt, in place of the touched days, all other days as they are; ``first`` gets the written rows before it is complete."""
    newest, days = _versions(spark, sink)
    target = newest + 1
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{sink}/v{target:08d}")
    now = {d: v for d, v in days.items() if d not in touched} | dict.fromkeys(_written_days(spark, f"{sink}/v{target:08d}"), target)
    if first:
        first(spark.read.schema(rows.schema).parquet(f"{sink}/v{target:08d}"))
    # as JSON, since rows that Python hands over take a worker
    listed = F.from_json(F.lit(json.dumps([{"day": d, "version": v} for d, v in now.items()])), f"array<struct<{_DAYS}>>")
    spark.range(1, numPartitions=1).select(F.inline(listed)).write.mode("overwrite").parquet(f"{sink}/days{target:08d}")
    # readers of the version before still find its days; what only older ones used goes
    for version in set(range(max(0, newest - 20), newest)) - set(now.values()) - set(days.values()):
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/v{version:08d}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)


#: Parts of the key index.
KEY_BUCKETS = 64


def _key() -> Column:
    return F.xxhash64("dedup_key")


def _bucket() -> Column:
    return F.pmod(_key(), F.lit(KEY_BUCKETS)).cast("int")


def key_index(spark: SparkSession, sink: str, buckets: list[int]) -> DataFrame | None:
    """(key, day) of some parts of the index: days on which a key lies, or lay once. Only these parts' files are read."""
    if not _exists(spark, f"{sink}/keys"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/keys")
    there = {x.getPath().getName() for x in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)}
    parts = [f"{sink}/keys/{name}" for b in sorted(buckets) if (name := f"bucket={b}") in there]
    return spark.read.schema("key long, day long").parquet(*parts) if parts else None


def _add_keys(sink: str, own: DataFrame) -> None:
    """The index knows these (key, day) as well; it is only added to, and before the ledger's next version is complete.

    One that knows too much, from a hash that two keys share or a batch that failed, costs a day that is read in vain.
    """
    bucket = F.pmod("key", F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
    own.select("key", F.col("day").cast("long").alias("day"), bucket).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{sink}/keys")


def _days_of(spark: SparkSession, sink: str, own: DataFrame, days: set[int | None], buckets: list[int], few: bool, offset: str) -> set[int | None]:
    """The days of the stored rows with a batch's keys, apart from the days that it lies on itself. A ledger without an index gets one first."""
    if not _exists(spark, f"{sink}/keys"):
        stored = _read_days(spark, sink, _versions(spark, sink)[1])
        if stored is not None:
            _add_keys(sink, stored.select(_key().alias("key"), E.day_index(F.col("ts_start"), offset).alias("day")))
    known = key_index(spark, sink, buckets)
    if known is None:
        return set()
    # days that the batch lies on are touched anyhow, so keys are looked up on other days, if there are any
    away = F.col("day").isNotNull() & ~F.col("day").isin([d for d in days if d is not None])
    away = known.where(away if None in days else away | F.col("day").isNull())
    if not few and not away.select("day").distinct().count():
        return set()
    return {r.day for r in away.join(F.broadcast(own) if few else own, "key", "left_semi").select("day").distinct().collect()}


def compact_keys(spark: SparkSession, sink: str) -> None:
    """Rewrite the index as one file a bucket, each key and day once: for a pause between batches, which leave a file a bucket each."""
    path = f"{sink}/keys"
    whole = spark.read.schema("key long, day long, bucket int").parquet(path).repartition("bucket").distinct()  # one shuffle
    whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}.new")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.rename(Path(path), Path(f"{path}.old"))
    fs.rename(Path(f"{path}.new"), Path(path))
    fs.delete(Path(f"{path}.old"), True)


#: Rows of a batch up to which its keys are broadcast: 16 bytes each.
FEW_ROWS = 200_000


def _changes(stored: DataFrame, rows: DataFrame, offset: str, few: DataFrame | None = None) -> DataFrame:
    """Rows that replace what is stored of their key or are its first: (dedup_key, _found, _app, _was, day), with the stored row's app and day.

    Rows are compared by completeness and 128 bits of hashes over all columns but the app, which stays; only these, keys and days are shuffled.
    Where the batch has ``few`` keys, stored rows of other keys are neither hashed nor shuffled.
    """
    if few is not None:
        stored = stored.join(F.broadcast(few.select(F.col("key").alias("_key"))), _key() == F.col("_key"), "left_semi")
    both = stored.withColumn("_new", F.lit(False)).unionByName(rows.drop("seq", "day").withColumn("_new", F.lit(True)), allowMissingColumns=True)
    content = [c for c in both.columns if c not in ("dedup_key", "app", "completeness", "_new")]
    bits = [F.isnull(c).cast("long") * (1 << i % 62) for i, c in enumerate(content)]  # the hash passes over nulls
    nulls = [reduce(Column.__add__, bits[i : i + 62]) for i in range(0, len(bits), 62)]
    digest = F.struct(F.xxhash64(*content, *nulls).alias("a"), F.xxhash64(*nulls, *reversed(content)).alias("b"))
    day = E.day_index(F.col("ts_start"), offset).cast("long")
    marks = with_completeness(both.drop("completeness")).select("dedup_key", "app", "completeness", digest.alias("digest"), day.alias("day"), "_new")
    now, was = marks.where("_new").alias("now"), marks.where("NOT _new").withColumn("_found", F.lit(True)).alias("was")
    joined = now.join(was, F.col("now.dedup_key").eqNullSafe(F.col("was.dedup_key")), "left")
    replaces = (F.col("now.completeness") >= F.col("was.completeness")) & (F.col("now.digest") != F.col("was.digest"))
    found = F.col("was._found").isNotNull()
    return joined.where(~found | replaces).select("now.dedup_key", found.alias("_found"), F.col("was.app").alias("_app"), F.col("was.day").alias("_was"), "now.day")


#: Lets joins of shuffled rows hash their smaller side instead of sorting both, where all of its parts are as small as this.
_HASHED, _HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB"


def merge_batch(sink: str, offset: str, rollup_sink: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, reread: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: gate, price (``prepare``) and upsert a batch into a ledger kept by local day.

    Only the days that the batch's rows lie on, or lay on before, are read, and of these only the days of changed rows are
    written, and their rollups; an index of keys says which days to read, and a batch reads the parts of it that its keys fall into.
    Keys and digests tell the changed rows, so a batch of rows that are stored, or poorer, writes nothing; whole rows are folded only of keys that change.
    A list of days makes them the next version, which readers take up once it is complete, the rollups just before. A batch
    that is run again finds its rows stored already. It is kept for its three passes, or with ``reread`` read again in each,
    which is cheaper where batches are files as they landed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = gate(prepare(batch) if prepare else batch)
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(0))
        rows = rows.withColumn("day", E.day_index(F.col("ts_start"), offset))
        held = [] if reread else [rows.persist()]
        hashed = spark.conf.get(_HASHED, None)
        spark.conf.set(_HASHED, _HASHED_BYTES)
        try:
            days = _versions(spark, sink)[1]
            keyed = rows.select(_key().alias("key"), F.col("day").cast("long").alias("day")).persist()
            held.append(keyed)
            bucket = F.pmod("key", F.lit(KEY_BUCKETS)).cast("int")
            # calendar days, and KEY_BUCKETS at most
            n, dated, undated, buckets = keyed.agg(F.count("*"), F.collect_set("day"), F.count_if(F.isnull("day")), F.collect_set(bucket)).first()
            few = n <= FEW_ROWS
            touched = set(dated) | ({None} if undated else set())
            touched |= _days_of(spark, sink, keyed, touched, buckets, few, offset)
            stored = _read_days(spark, sink, {d: v for d, v in days.items() if d in touched})
            if stored is not None:
                changed = _changes(stored, rows, offset, keyed if few else None).persist()
                held.append(changed)
                touched = {r.day for r in changed.select(F.explode(F.when(F.col("_found"), F.array("day", "_was")).otherwise(F.array("day"))).alias("day")).distinct().collect()}  # calendar days
            if not touched:
                return
            own = rows.drop("day", "completeness")
            # hashes that are distinct are of distinct keys: then there are no revisions to fold
            revised = n != keyed.select("key").distinct().count()
            if stored is not None:
                keys = changed.select(F.col("dedup_key").alias("_key"), "_found", "_app")
                own = own.join(keys.distinct() if revised else keys, F.col("dedup_key").eqNullSafe(F.col("_key"))).withColumn("app", F.expr("IF(_found, _app, app)")).drop("_key", "_found", "_app")
            merged = (fold(own) if revised else own).drop("completeness", "seq")
            merged = merged.withColumn("day", E.day_index(F.col("ts_start"), offset))
            merged = merged.hint("rebalance", "day") if few else merged
            folders = _folders(sink, {d: v for d, v in days.items() if d in touched})
            if folders:
                # beside few rows the others stay in files as they are; small files share a task, which joins those of a day
                keys = changed.select(F.col("dedup_key").alias("_key"))
                old = spark.read.schema(stored.schema).parquet(*folders).join(F.broadcast(keys) if few else keys, F.col("dedup_key").eqNullSafe(F.col("_key")), "left_anti")
                merged = old.withColumn("day", E.day_index(F.col("ts_start"), offset)).unionByName(merged, allowMissingColumns=True)

            def before_it_is_complete(written: DataFrame) -> None:
                # the index gets the days that keys come to lie on
                own = written if stored is None else changed.where("NOT (_found AND _was <=> day)")
                _add_keys(sink, own.select(_key().alias("key"), "day"))
                if not rollup_sink:
                    return
                sums = rollups(written.drop("day"), offset)
                sums = sums if "day" in sums.columns else sums.withColumn("day", F.datediff(F.to_date("date"), F.lit("1970-01-01")).cast("long"))
                _write_days(spark, rollup_sink, sums.hint("rebalance", "day"), touched)

            # the rollups first: a batch that fails between the two still finds its rows to be changes when it is run again
            _write_days(spark, sink, merged if few else merged.hint("rebalance", "day"), touched, before_it_is_complete)
        finally:
            spark.conf.unset(_HASHED) if hashed is None else spark.conf.set(_HASHED, hashed)
            for kept in held:
                kept.unpersist()

    return step


def ingest_stream(source: DataFrame, sink: str, checkpoint: str, offset: str = "+00:00", rollup_sink: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, reread: bool = False) -> StreamingQuery:
    """Upsert all that has landed, batch by batch; a later call goes on where this one ends."""
    step = merge_batch(sink, offset, rollup_sink, prepare, reread)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(source: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows that were not sent before within ``delay`` of their arrival: a cheap filter before the upsert, which decides.

    The watermark is on the time of arrival, so rows are never too late, whatever their own time, null included.
    """
    timed = source.withColumn("_arrived", F.current_timestamp())
    return timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["dedup_key", "output_tokens"]).drop("_arrived")


#: Buckets that keys are dealt to: a processor is called, and its state read and written, once for each that a batch has rows of.
STATE_BUCKETS = 512


class _Keyed(StatefulProcessor):
    """The states of a bucket of keys, which expire one by one if nothing is added for ``ttl_ms``, where that is given.

    Calls and state accesses of Python cost milliseconds, so there is one of each for a bucket and none for a key. A
    bucket's states are one value: it grows with the keys, 1 in STATE_BUCKETS of them.
    """

    #: The columns of a key, of its state, of a row's order within its key, and of what a step reads and gives.
    KEY, STATE, ORDER, READ, COLUMNS = "path string", "", "line_offset", (), ()
    NUMBERS = ("ts",)

    def __init__(self, ttl_ms: int | None = None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._n_key = len(self.KEY.split(","))
        self._empty = (None,) * (len(self.STATE.split(",")))
        self._held = handle.getValueState("states", f"held array<struct<{self.KEY}, seen bigint, {self.STATE}>>", self._ttl_ms or None)

    def step(self, key: tuple, state: tuple, row: tuple, out: list[tuple]) -> tuple:
        """The state after a row, whose columns are READ."""
        raise NotImplementedError

    def done(self, key: tuple, before: tuple, state: tuple, out: list[tuple]) -> None:
        """After a key's last row of a batch."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        k, now = self._n_key, timer_values.getCurrentProcessingTimeInMs() if self._ttl_ms else None
        states, seen, out = {}, {}, []
        for held in self._held.get()[0] if self._held.exists() else ():
            own = tuple(held)
            if now is None or own[k] is None or now - own[k] <= self._ttl_ms:
                states[own[:k]], seen[own[:k]] = own[k + 1 :], own[k]
        names = [c.split()[0] for c in self.KEY.split(",")]
        lines = pd.concat(list(rows)).sort_values([*names, self.ORDER], kind="stable")
        given = zip(*(lines[c].astype(object).where(lines[c].notna(), None) for c in (*names, *self.READ)), strict=True)
        for own, part in groupby(given, key=lambda row: row[:k]):
            before = state = states.get(own, self._empty)
            for row in part:
                state = self.step(own, state, row[k:], out)
            self.done(own, before, state, out)
            states[own], seen[own] = state, now
        self._held.update(([(*own, seen[own], *state) for own, state in states.items()],))
        yield pd.DataFrame(out, columns=list(self.COLUMNS)).astype(dict.fromkeys(self.NUMBERS, "Int64"))

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, processor: _Keyed, out: str, mode: str) -> DataFrame:
    keys = [c.split()[0] for c in processor.KEY.split(",")]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(STATE_BUCKETS)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, out, mode, "ProcessingTime" if processor._ttl_ms else "None")


def _number(x) -> int | None:
    return None if x is None else int(x)


class LatestPoint(_Keyed):
    """The newest value of a series; an older point never wins, an equally new one does."""

    KEY, STATE, ORDER, READ = "metric string, session_id string, attr_sig string", "ts_ms bigint, value double", "ts_ms", ("ts_ms", "value")
    COLUMNS, NUMBERS = ("metric", "session_id", "attr_sig", "ts_ms", "value"), ("ts_ms",)

    def step(self, key, state, row, out):
        ts, value = row
        if ts is None or state[0] is not None and ts < state[0]:
            return state
        return int(ts), float("nan") if value is None else float(value)

    def done(self, key, before, state, out):
        if state != before:
            out.append((*key, *state))


def metric_stream(points: DataFrame) -> DataFrame:
    """Changes of the latest value of each series (metric, session_id, attr_sig); needs the RocksDB state store."""
    out = "metric string, session_id string, attr_sig string, ts_ms long, value double"
    return _keyed(points.select("metric", "session_id", "attr_sig", "ts_ms", "value"), LatestPoint(), out, "update")


class LastUserTime(_Keyed):
    """Assistant lines of a growing file with the time of the last user line, which may be of an earlier batch."""

    STATE, READ = "asked bigint", ("line_offset", "kind", "ts")
    COLUMNS, NUMBERS = ("path", "line_offset", "ts", "asked"), ("ts", "asked")

    def step(self, key, state, row, out):
        at, kind, ts = row
        if kind == "user":
            return (_number(ts),)
        out.append((*key, at, _number(ts), *state))
        return state


def stateful_parse(lines: DataFrame) -> DataFrame:
    """(path, line_offset, ts, asked) of assistant lines from a stream of (path, line_offset, kind, ts)."""
    return _keyed(lines, LastUserTime(), "path string, line_offset long, ts long, asked long", "append")


class CodexCalls(_Keyed):
    """Counted calls of a file, with the counters, the call in flight and the turn as earlier batches have left them."""

    STATE = "own array<bigint>, start bigint, done bigint, staged bigint, model string, cwd string"
    READ = ("line_offset", "kind", "ts", "model", "cwd", "own")
    COLUMNS, NUMBERS = ("path", "line_offset", "ts", "model", "cwd", "own", "call_start", "call_end"), ("ts", "call_start", "call_end")

    def step(self, key, state, row, out):
        before, start, done, staged, model, cwd = state
        at, kind, ts, its_model, its_cwd, own = row
        ts = _number(ts)
        if kind == "turn":
            model, cwd = its_model or model, its_cwd or cwd
        elif kind == "asked" and ts is not None:
            start, done, staged = ts, None, None
        elif kind == "tool" and ts is not None:
            start, staged = (ts, staged) if done is None else (start, ts)
        elif kind == "spoke" and ts is not None:
            done = ts
        elif kind == "counted":
            own = [int(x) for x in own]
            if (before is None or own != list(before)) and sum(own[:5]) > 0:
                out.append((*key, at, ts, model, cwd, own, start, ts if done is None else done))
                start, done, staged = ts if staged is None else staged, None, None
            before = own
        return before, start, done, staged, model, cwd


class KiroTurns(_Keyed):
    """Usage summaries of a file, with the turn that was open, which may have been opened in an earlier batch."""

    STATE, ORDER = "exec string, ts bigint", "offset"
    READ = ("session_id", "project", "model", "execution_id", "offset", "kind", "ts", "credits")
    COLUMNS, NUMBERS = ("path", "session_id", "project", "model", "execution_id", "offset", "ts", "credits", "turn_exec", "turn_ts"), ("ts", "turn_ts")

    def step(self, key, state, row, out):
        session_id, project, model, execution_id, offset, kind, ts, credits = row
        if kind == "turn_start":
            return execution_id or None, _number(ts)
        if kind == "turn_end":
            return None, None
        if kind == "usage_summary" and credits is not None and credits > 0:
            out.append((*key, session_id, project, model, execution_id, offset, _number(ts), credits, *state))
        return state


def codex_stream(raw: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Ledger rows of Codex logs from a stream of (path, line_offset, line): what whole files give, wherever batches cut them.

    A file's lines must come in order of batches; the state of one that is silent for ``ttl_ms`` goes, which needs a query
    that runs on (under availableNow a clock never lets it end). Needs the RocksDB store.
    """
    out = "path string, line_offset long, ts long, model string, cwd string, own array<bigint>, call_start long, call_end long"
    return logs.codex_rows(_keyed(logs.codex_steps(raw), CodexCalls(ttl_ms), out, "append"))


def kiro_stream(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Ledger rows of Kiro sessions from a stream of the rows that ``tables.kiro_credits`` takes, under the same terms."""
    out = "path string, session_id string, project string, model string, execution_id string, offset long, ts long, credits double, turn_exec string, turn_ts long"
    slim = turns.select("path", "session_id", "project", "model", "execution_id", "offset", "kind", "ts", "credits")
    used = _keyed(slim, KiroTurns(ttl_ms), out, "append")
    return tables.kiro_rows(used.withColumn("turn", F.struct(F.col("turn_exec").alias("exec"), F.col("turn_ts").alias("ts"))))


def velocity_stream(events: DataFrame, watermark: str = "30 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Tokens, requests and cost in sliding windows; rows later than the watermark are not in them."""
    timed = events.where("ts_start IS NOT NULL").withColumn("event_time", F.timestamp_millis("ts_start")).withWatermark("event_time", watermark)
    out = timed.groupBy(F.window("event_time", width, slide)).agg(F.count("*").alias("events"), F.sum(E.headline_tokens()).alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), F.unix_millis("window.end").alias("end_ms"), "events", "tokens", "cost_usd")


def velocities(events: DataFrame, width: int, watermark: str = "30 minutes") -> DataFrame:
    """Tokens, requests and cost of windows of ``width`` minutes that slide by one, a row for each once it is closed.

    Rows are summed by minute first, and windows are sums of minutes, so a row is kept in one state row and not in one for
    each window that holds it. A row counts unless its minute ended before the watermark. Each width is a query of its own:
    in a union of such chains only the first one's watermark advances.
    """
    timed = events.where("ts_start IS NOT NULL").withColumn("event_time", F.timestamp_millis("ts_start")).withWatermark("event_time", watermark)
    minutes = timed.groupBy(F.window("event_time", "1 minute")).agg(F.count("*").alias("events"), F.sum(E.headline_tokens()).alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    sums = minutes.groupBy(F.window(F.window_time("window"), f"{width} minutes", "1 minute")).agg(*(F.sum(k).alias(k) for k in ("events", "tokens", "cost_usd")))
    return sums.select(F.lit(width).alias("minutes"), F.unix_millis("window.start").alias("start_ms"), F.unix_millis("window.end").alias("end_ms"), "events", "tokens", "cost_usd")
