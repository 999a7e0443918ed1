"""Log lines with byte offsets, and the ledger row that every normalizer fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.schema import LEDGER_SCHEMA, TOKEN_COLUMNS


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_offset, line) of whole files that may still grow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return split_lines(files.select("path", "content"))


def split_lines(files: DataFrame) -> DataFrame:
    """(path, line_offset, line) of (path, content): complete lines only, without a trailing CR; blank and invalid ones are left out.

    Bytes are read as ISO-8859-1, one character each, so that offsets count bytes; every line is then read as UTF-8.
    """
    text = F.decode("content", "ISO-8859-1")
    complete = F.substring_index(text, "\n", -1)
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.lit(1), F.length(text) - F.length(complete) - 1))
    parts = files.select("path", F.posexplode(F.split(body, "\n", -1)).alias("number", "raw"))
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("long")
    placed = parts.withColumn("line_offset", offset)
    content = F.encode(F.regexp_replace("raw", "\r$", ""), "ISO-8859-1")
    valid = placed.withColumn("content", content).where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.select("path", "line_offset", F.decode("content", "UTF-8").alias("line")).where("trim(line) <> ''")


def parsed(raw: DataFrame, schema: str, needle: str | None = None) -> DataFrame:
    """``raw`` with ``v``, its line as JSON; lines without ``needle`` are dropped before they are parsed, bad JSON after.

    A one-element array holds the parsed line, since filters and columns that name its fields would each parse it anew if
    the optimizer could move them below.
    """
    if needle:
        raw = raw.where(F.col("line").contains(needle))
    return raw.select("*", F.explode(F.array(F.from_json("line", schema))).alias("v")).where("v IS NOT NULL")


def count(value: str | Column) -> Column:
    return E.unsigned(F.col(value) if isinstance(value, str) else value)


def text(value: str | Column) -> Column:
    return E.text_or_null(F.col(value) if isinstance(value, str) else value)


def any_ms(value: str | Column) -> Column:
    """A timestamp given as a number of any unit or as ISO text."""
    c = F.col(value) if isinstance(value, str) else value
    number = c.try_cast("double").try_cast("bigint")
    return F.when(c.rlike(r"^\s*[0-9.]+(?:[eE]\+?[0-9]+)?\s*$"), E.epoch_ms(number)).otherwise(E.iso_ms(c))


def stem(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")


def raw_ref() -> Column:
    return F.concat("path", F.lit("#"), F.col("line_offset").cast("string"))


def ledger_rows(df: DataFrame, **columns: Column | str | None) -> DataFrame:
    """Rows of LEDGER_SCHEMA from the given columns; counters that are not given are 0, all else null."""
    out = []
    for f in LEDGER_SCHEMA:
        value = columns.pop(f.name, None)
        if isinstance(value, str):
            value = F.lit(value)
        if value is None:
            value = F.lit(0) if f.name in TOKEN_COLUMNS else F.lit(None)
        elif f.name in TOKEN_COLUMNS:
            value = F.coalesce(value, F.lit(0))
        out.append(value.cast(f.dataType).alias(f.name))
    if columns:
        raise TypeError(f"not in the ledger: {sorted(columns)}")
    return df.select(*out)
