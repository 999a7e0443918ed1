"""Column functions over ledger rows. Nothing here reads the clock or the machine's time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.schema import DAY_MS, MAX_DERIVED_DURATION_MS

SPEED_SUMS = ("speed_in", "speed_out", "speed_ms", "speed_est_ms", "timed_events", "prefill_in", "ttft_ms", "ttft_events", "decode_out", "decode_ms")


def model_expr() -> Column:
    """The model a row is shown and filtered under: the first non-empty name, else '?'."""
    names = (F.nullif(F.col(c), F.lit("")) for c in ("model", "request_model", "pricing_model"))
    return F.coalesce(*names, F.lit("?"))


def headline_tokens() -> Column:
    """input + output + cache reads + unclassified; cache writes are not part of it."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("unclassified_tokens")


def cache_write_tokens() -> Column:
    return F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")


def tokens_total() -> Column:
    """The headline tokens and the cache writes."""
    return headline_tokens() + cache_write_tokens()


def _span() -> Column:
    return F.col("ts_end") - F.col("ts_start")


def _span_counts() -> Column:
    return F.coalesce((_span() > 0) & (_span() <= MAX_DERIVED_DURATION_MS), F.lit(False))


def _measured() -> Column:
    return F.coalesce(F.col("duration_ms") > 0, F.lit(False))


def effective_duration_ms() -> Column:
    """The measured duration, else a span between the timestamps of at most 30 minutes, else null."""
    return F.when(_measured(), F.col("duration_ms")).when(_span_counts(), _span())


def output_tps() -> Column:
    """Output tokens a second of one event; null where its tokens are unclassified or it has no duration."""
    return F.when(F.col("unclassified_tokens") <= 0, F.col("output_tokens") * 1000.0 / effective_duration_ms())


def speed_sums() -> list[Column]:
    """Ten additive sums from which all speeds follow.

    speed_est_ms also counts events with unclassified tokens, which speed_ms leaves out, so their ratio can exceed 1.
    """
    classified = F.col("unclassified_tokens") == 0
    timed = classified & (_measured() | _span_counts())
    estimated = ~_measured() & _span_counts()
    spent = F.when(F.col("unclassified_tokens") > 0, 0).otherwise(F.coalesce(effective_duration_ms(), F.lit(0)))
    waited = F.coalesce(F.col("ttft_ms") > 0, F.lit(False))
    first = classified & waited
    decoding = waited & (spent > F.col("ttft_ms"))
    parts = {
        "speed_in": F.when(timed, F.col("input_tokens")),
        "speed_out": F.when(timed, F.col("output_tokens")),
        "speed_ms": spent,
        "speed_est_ms": F.when(estimated, _span()),
        "timed_events": F.when(timed, 1),
        "prefill_in": F.when(first, F.col("input_tokens")),
        "ttft_ms": F.when(first, F.col("ttft_ms")),
        "ttft_events": F.when(first, 1),
        "decode_out": F.when(decoding, F.col("output_tokens")),
        "decode_ms": F.when(decoding, spent - F.col("ttft_ms")),
    }
    return [F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in parts.items()]


def _rate(tokens: Column, ms: str) -> Column:
    return F.when(F.col(ms) > 0, tokens / F.col(ms) * 1000.0)


def speed_rates() -> dict[str, Column]:
    """Weighted rates from the ten sums; null where nothing was timed, the estimated share then being 0."""
    return {
        "output_tps": _rate(F.col("speed_out"), "speed_ms"),
        "total_tps": _rate(F.col("speed_in") + F.col("speed_out"), "speed_ms"),
        "input_tps": _rate(F.col("speed_in"), "speed_ms"),
        "prefill_tps": _rate(F.col("prefill_in"), "ttft_ms"),
        "decode_tps": _rate(F.col("decode_out"), "decode_ms"),
        "avg_ttft_ms": F.when(F.col("ttft_events") > 0, F.col("ttft_ms") / F.col("ttft_events")),
        "est_ratio": F.when(F.col("speed_ms") > 0, F.col("speed_est_ms") / F.col("speed_ms")).otherwise(0.0),
    }


def offset_ms(offset: str) -> int:
    """Milliseconds of '+HH:MM' or '-HH:MM'."""
    if not (m := re.fullmatch(r"([+-])([01]\d|2[0-3]):([0-5]\d)", offset)):
        raise ValueError(f"not an offset: {offset!r}")
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])) * 60_000


def day_index(ms: Column, offset: str = "+00:00") -> Column:
    """Days since 1970-01-01 in the frame of a fixed offset; rounded down, also before 1970."""
    return F.floor((ms + offset_ms(offset)) / F.lit(DAY_MS)).cast("int")


def date_of(day: Column) -> Column:
    """A day index as YYYY-MM-DD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def hour_label(ms: Column, offset: str = "+00:00") -> Column:
    """'HH:00' of the local hour."""
    return F.concat(F.lpad(hour_of(ms, offset).cast("string"), 2, "0"), F.lit(":00"))


def hour_of(ms: Column, offset: str = "+00:00") -> Column:
    return F.pmod(F.floor((ms + offset_ms(offset)) / F.lit(3_600_000)), F.lit(24)).cast("int")


def minus_cache(prompt: Column, read: Column, write: Column | None = None) -> Column:
    """Input tokens without the cached ones, never below zero."""
    left = F.greatest(prompt - F.coalesce(read, F.lit(0)), F.lit(0))
    return left if write is None else F.greatest(left - F.coalesce(write, F.lit(0)), F.lit(0))


def unsigned(value: Column) -> Column:
    """A count read leniently: null or no number is 0, negative numbers are 0."""
    number = F.coalesce(F.expr("try_cast(null as bigint)"), value.try_cast("bigint"), F.floor(value.try_cast("double")).try_cast("bigint"))
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0))


def text_or_null(value: Column) -> Column:
    """Text without surrounding blanks, null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def iso_ms(value: Column) -> Column:
    """Epoch milliseconds of an ISO timestamp; without a zone it is UTC, as the session must be."""
    return F.unix_millis(F.try_to_timestamp(value))


def epoch_ms(value: Column) -> Column:
    """Epoch milliseconds of a number of seconds, milli-, micro- or nanoseconds, told apart by size."""
    n = value.cast("bigint")
    part = lambda size: F.call_function("div", n, F.lit(size))  # noqa: E731  whole numbers: doubles are too coarse here
    return F.when(n > 10**18, part(10**6)).when(n > 10**15, part(10**3)).when(n > 10**12, n).otherwise(n * 1000).cast("bigint")


def derived_duration(start: Column, end: Column) -> Column:
    """end - start where it lies within (0, 30 min]."""
    return F.when((end - start > 0) & (end - start <= MAX_DERIVED_DURATION_MS), end - start)


def model_key(raw: Column) -> Column:
    """A model name as a price key: the last path part up to ':', '@' as '-', lower-cased, without '[1m]'."""
    tail = F.element_at(F.split(raw, "/"), -1)
    key = F.lower(F.replace(F.element_at(F.split(tail, ":"), 1), F.lit("@"), F.lit("-")))
    return F.regexp_replace(key, r"\[1m\]$", "")


def canon_key(key: Column) -> Column:
    """A price key with dots between digits written as '-'."""
    return F.regexp_replace(key, r"(?<=[0-9])\.(?=[0-9])", "-")


def primary_keys(raw: Column) -> Column:
    """The model key, and that of a 'provider:model' tail."""
    after = F.regexp_extract(F.element_at(F.split(raw, "/"), -1), r"^[^:]*:(.*)$", 1)
    second = F.when(after.rlike("^[A-Za-z]") & after.contains("-"), model_key(after))
    return F.filter(F.array_distinct(F.array(model_key(raw), second)), lambda k: k.isNotNull() & ((k != "") | (k == model_key(raw))))


def flatten(value: Column) -> Column:
    """Letters and digits alone, lower-cased, for searching."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))


def pct_decode(value: Column) -> Column:
    """Percent sequences decoded; '+' and stray '%' stay."""
    safe = F.regexp_replace(F.regexp_replace(value, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), value)


def file_path(uri: Column) -> Column:
    """The path of a file: URI, other text as it is."""
    return F.when(uri.startswith("file://"), pct_decode(F.regexp_replace(uri, r"^file://(localhost)?", ""))).otherwise(uri)


def csv_guard(value: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula, quoted where it must be."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    guarded = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike(r'^[=+\-@\t\r]|[",\r\n]'), guarded).otherwise(F.coalesce(value, F.lit("")))


def attr_sig(attributes: Column) -> Column:
    """A signature of (key, value) structs: sorted 'k=v', joined by commas."""
    return F.array_join(F.array_sort(F.transform(attributes, lambda a: F.concat_ws("=", a["key"], a["value"]))), ",")


def fmt_trim(value: Column, digits: int) -> Column:
    """A number with up to ``digits`` decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(value, digits), ",", ""), r"(\.\d*?)0+$|\.0*$", "$1").alias("text")


def fmt_exact(value: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(value, 0)


def fmt_compact(value: Column) -> Column:
    """A count as 950, 1.2K, 3.4M or 5.6B."""
    small = value.cast("string")
    step = lambda size, mark: F.concat(F.regexp_replace(F.format_number(value / size, 1), r"\.0$", ""), F.lit(mark))
    return F.when(value < 1e3, small).when(value < 1e6, step(1e3, "K")).when(value < 1e9, step(1e6, "M")).otherwise(step(1e9, "B"))


def fmt_usd(value: Column) -> Column:
    """Dollars with two decimals, four below a cent's worth of precision."""
    return F.concat(F.lit("$"), F.when((value > 0) & (value < 0.01), F.format_number(value, 4)).otherwise(F.format_number(value, 2)))


def fmt_duration(ms: Column) -> Column:
    """Milliseconds as '1h 02m', '3m 04s' or '5s'."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat(F.floor(s / 3600), F.lit("h "), two(F.floor(s / 60) % 60), F.lit("m"))
    return F.when(s >= 3600, hours).when(s >= 60, F.concat(F.floor(s / 60), F.lit("m "), two(s % 60), F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def completeness() -> Column:
    """How many of nine billing dimensions a row fills; cost_usd counts wherever it is not null."""
    filled = [F.col(c) > 0 for c in ("unclassified_tokens", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens")]
    filled += [cache_write_tokens() > 0, *(F.col(c).isNotNull() for c in ("cost_usd", "credits", "duration_ms"))]
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in filled), F.lit(0))


def billable() -> Column:
    """Whether any counter, the credits or the cost is above zero."""
    amounts = ("unclassified_tokens", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "credits", "cost_usd")
    return F.greatest(*(F.coalesce(F.col(c) > 0, F.lit(False)).cast("int") for c in amounts), (cache_write_tokens() > 0).cast("int")) == 1
