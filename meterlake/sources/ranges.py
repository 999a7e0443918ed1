"""Growing log files by byte ranges: what is new since the last pass, cut into ranges that any task can read.

A pass lists sizes, reads a few hundred bytes of each file to tell whether it is what it was, and then only the new bytes.
A range gives the lines that begin in it, so ranges need not end at lines and a large file is read by many tasks. Lines are
numbered by their place in the file, which the reader knows; nothing is counted up. Files are opened in the tasks by URI
(local, HDFS and the object stores that pyarrow knows); where only Spark can open them, ``lines.log_lines`` reads them whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators.ledger import TAIL_BYTES

#: Bytes of one range, bytes read at a time, and bytes of a batch of lines.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 64_000_000, 1_000_000, 4_000_000
#: Ranges that are summed up by one task when they are dealt to batches.
GROUP_RANGES = 100_000


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _hash_before(file, end: int) -> str:
    start = max(0, end - TAIL_BYTES)
    return hashlib.sha256(file.read_at(end - start, start)).hexdigest()


def _last_line_end(file, start: int, end: int) -> int:
    """The place after the last line feed in [start, end), else ``start``; read from the end."""
    while end > start:
        at = max(start, end - READ_BYTES)
        found = file.read_at(end - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return start


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, length, at, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and at == length:  # nothing is new
                out.append((path, length, at, known, known, known))
                continue
            with _open(path) as file:
                grown = at is not None and length > at
                end = _last_line_end(file, at or 0, length) if at is None or grown else length
                out.append((path, length, end, _hash_before(file, at) if grown else None, _hash_before(file, end), _hash_before(file, length)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["path", "length", "end", "before", "tail", "eof_tail"])


def range_tails(sizes: DataFrame, cursors: DataFrame) -> DataFrame:
    """(path, length, end, before, tail, eof_tail) of (path, length): where complete lines end, and hashes before the
    cursor's place, that end and the file's. Files as long as their cursor aren't opened."""
    known = cursors.select("path", "last_byte_offset", "fingerprint")
    joined = sizes.select("path", "length").join(known, "path", "left")
    return joined.mapInArrow(_look, "path string, length long, end long, before string, tail string, eof_tail string")


def scan_plan(spark: SparkSession, folder: str, cursors: DataFrame) -> DataFrame:
    """(path, action, from_offset, length, tail) as of ``ledger.read_plan``, where length ends with the last complete line of what is read.

    A file without a new complete line is Unchanged; one that was cut or rewritten is Pinned to its end. Cursors advance by
    ``ledger.advance`` once the lines are in the ledger.
    """
    tails = range_tails(file_sizes(spark, folder), cursors)
    known = cursors.select("path", "last_byte_offset", "fingerprint")
    joined = tails.join(known, "path", "left")
    at, length, end = F.coalesce("last_byte_offset", F.lit(0)), F.col("length"), F.col("end")
    fresh = F.col("last_byte_offset").isNull() | ((at == 0) & F.col("fingerprint").isNull())
    same = F.col("before").eqNullSafe(F.col("fingerprint"))
    action = (
        F.when(fresh, F.when(end == 0, "Unchanged").otherwise("Full")).when(length < at, "Pinned").when(length == at, "Unchanged")
        .when(~same, "Pinned").when(end == at, "Unchanged").otherwise("Append")
    )
    pinned = F.col("action") == "Pinned"
    start = F.when(F.col("action") == "Full", 0).when(pinned, length).otherwise(at)
    upto = F.when(pinned, length).when(F.col("action") == "Unchanged", at).otherwise(end)
    return joined.withColumn("action", action).select(
        "path", "action", start.cast("long").alias("from_offset"), upto.cast("long").alias("length"), F.when(pinned, F.col("eof_tail")).otherwise(F.col("tail")).alias("tail")
    )


def cut(plan: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop, upto): ranges of what a plan reads; the lines of a file end at ``upto``."""
    new = plan.where("action IN ('Full', 'Append') AND length > from_offset")
    starts = F.explode(F.sequence(F.col("from_offset"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = new.select("path", starts.alias("start"), F.col("length").alias("upto"))
    return ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("upto")).alias("stop"), "upto")


def batched(ranges: DataFrame, max_bytes: int) -> DataFrame:
    """``ranges`` with ``batch``: of at most ``max_bytes`` each, and of one range at least. A file's batches rise with its ranges."""
    size = F.col("stop") - F.col("start")
    n, most = ranges.agg(F.count(F.lit(1)), F.max(size)).first()
    room = max(1, max_bytes - (most or 0))  # a batch ends with the range that crosses this
    group = F.pmod(F.hash("path"), F.lit(-(-n // GROUP_RANGES) or 1))
    before = F.sum(size).over(Window.partitionBy("_group").orderBy("path", "start")) - size
    dealt = ranges.withColumn("_group", group).withColumn("_turn", F.floor(before / room))
    order = dealt.select("_group", "_turn").distinct()  # of bounded batches, so few
    numbered = order.withColumn("batch", F.row_number().over(Window.orderBy("_turn", "_group")) - 1)
    return dealt.join(numbered, ["_group", "_turn"]).drop("_group", "_turn")


def _lines_of(file, start: int, stop: int, upto: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, stop); memory is one line and READ_BYTES."""
    at, rest = start, b""
    skip = start > 0
    if skip:  # a line begins here only after a line feed
        at -= 1
    while at < upto:
        data = rest + file.read_at(min(READ_BYTES, upto - at - len(rest)), at + len(rest))
        if len(data) == len(rest):
            return
        *lines, rest = data.split(b"\n")
        for line in lines:
            if skip:
                skip = False
            elif at >= stop:
                return
            else:
                yield at, line
            at += len(line) + 1
        if not skip and at >= stop:
            return
        if skip and at + len(rest) >= stop:  # no line begins here
            return


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["path", "line_offset", "line"])

    name, file = None, None  # the file that is open: a task's ranges come by file
    try:
        for batch in batches:
            for path, start, stop, upto in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, _open(path)
                rows, size = [], 0
                for at, raw in _lines_of(file, start, stop, upto):
                    try:
                        line = raw.removesuffix(b"\r").decode()
                    except UnicodeDecodeError:
                        continue
                    if line.strip(" "):
                        rows.append((at, line))
                        size += len(raw)
                    if size > BATCH_BYTES:
                        yield made(path, rows)
                        rows, size = [], 0
                if rows:
                    yield made(path, rows)
    finally:
        if file:
            file.close()


def read_ranges(ranges: DataFrame) -> DataFrame:
    """(path, line_offset, line) of complete lines, without a trailing CR; blank lines and such as aren't UTF-8 are left out.

    Of ranges with a ``batch`` (``batched``) a task reads one batch of a file after the other, all of them in one job.
    """
    n, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    least = 4 * ranges.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, 100_000, max(least, -(-size // RANGE_BYTES))))  # small ranges share a task
    by = ["batch", "path", "start"] if "batch" in ranges.columns else ["path", "start"]
    dealt = ranges.repartition(tasks, *by[:-1] if by[0] == "batch" else by).sortWithinPartitions(*by)
    return dealt.select("path", "start", "stop", "upto").mapInArrow(_read, "path string, line_offset long, line string")


def new_lines(spark: SparkSession, folder: str, cursors: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines, plan) of what files below ``folder`` have got since the cursors."""
    plan = scan_plan(spark, folder, cursors)
    return read_ranges(cut(plan, range_bytes)), plan
