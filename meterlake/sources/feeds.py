"""Price feeds and currency rates from landed documents, a row a document: (doc string)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.schema import PRICE_COLUMNS


def _number(value: Column) -> Column:
    """A price: finite and not negative, else null."""
    n = value.try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), n)


def book_rows(df: DataFrame, source: str, now_ms: int, **prices: Column) -> DataFrame:
    """(source, model_id, prices, fetched_at) from rows with ``id`` and ``at``: blank ids and rows without a price go, the last row of a key stays."""
    values = {c: prices.get(c, F.lit(None).cast("double")) for c in PRICE_COLUMNS}
    rows = df.select(F.lit(source).alias("source"), E.model_key(F.col("id")).alias("model_id"), "at", *(v.alias(c) for c, v in values.items()))
    rows = rows.where("model_id <> '' AND (input IS NOT NULL OR output IS NOT NULL)")
    last = F.row_number().over(Window.partitionBy("source", "model_id").orderBy(F.desc("at")))
    return rows.withColumn("_row", last).where("_row = 1").drop("_row", "at").withColumn("fetched_at", F.lit(now_ms).cast("bigint"))


def _entries(docs: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """A JSON object's entries in order: (at, id, v)."""
    body = F.col("doc") if path is None else F.get_json_object("doc", path)
    entries = docs.select(F.posexplode(F.map_entries(F.from_json(body, f"map<string, {schema}>"))).alias("at", "e"))
    return entries.select("at", F.col("e.key").alias("id"), F.col("e.value").alias("v"))


def _items(docs: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """A JSON array's items in order: (at, v)."""
    body = F.col("doc") if path is None else F.get_json_object("doc", path)
    return docs.select(F.posexplode(F.from_json(body, f"array<{schema}>")).alias("at", "v"))


def _per_million(path: str, factor: float = 1e6) -> Column:
    return _number(F.col(path)) * factor


def parse_models_dev(docs: DataFrame, now_ms: int) -> DataFrame:
    cost = "struct<input: string, output: string, cache_read: string, cache_write: string>"
    providers = _entries(docs, f"struct<models: map<string, struct<cost: {cost}>>>")
    models = providers.select((F.col("at") * 100_000).alias("base"), F.posexplode(F.map_entries("v.models")).alias("n", "e")).select((F.col("base") + F.col("n")).alias("at"), F.col("e.key").alias("id"), F.col("e.value.cost").alias("c")).where("c IS NOT NULL")
    zero = lambda c: F.coalesce(_number(F.col(f"c.{c}")), F.lit(0.0))
    return book_rows(models, "models.dev", now_ms, **{c: zero(c) for c in ("input", "output", "cache_read", "cache_write")})


def parse_litellm(docs: DataFrame, now_ms: int) -> DataFrame:
    names = {
        "input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost",
        "tier_above_200k_input": "input_cost_per_token_above_200k_tokens", "tier_above_200k_output": "output_cost_per_token_above_200k_tokens", "tier_batch": "input_cost_per_token_batches",
        "tier_above_200k_cache_read": "cache_read_input_token_cost_above_200k_tokens", "tier_1h_cache_write": "cache_creation_input_token_cost_above_1hr",
    }
    rows = _entries(docs, f"struct<{', '.join(f'{n}: string' for n in names.values())}>").where(_number(F.col("v.input_cost_per_token")).isNotNull())
    zero = ("output", "cache_read", "cache_write")
    return book_rows(rows, "litellm", now_ms, **{c: F.coalesce(_per_million(f"v.{n}"), F.lit(0.0)) if c in zero else _per_million(f"v.{n}") for c, n in names.items()})


def parse_llmpricing(docs: DataFrame, now_ms: int) -> DataFrame:
    price = "struct<input: string, output: string, cache_read: string>"
    rows = _items(docs, f"struct<id: string, reference: {price}, cheapest: {price}>", "$.models").withColumn("p", F.coalesce("v.reference", "v.cheapest")).withColumn("id", F.col("v.id")).where("p IS NOT NULL")
    return book_rows(rows, "llmpricing", now_ms, **{c: F.coalesce(_number(F.col(f"p.{c}")), F.lit(0.0)) for c in ("input", "output", "cache_read")})


def _priced_items(docs: DataFrame, now_ms: int, source: str, names: dict[str, str]) -> DataFrame:
    rows = _items(docs, f"struct<id: string, pricing: struct<{', '.join(f'{n}: string' for n in names.values())}>>", "$.data").withColumn("id", F.col("v.id"))
    return book_rows(rows, source, now_ms, **{c: _per_million(f"v.pricing.{n}") for c, n in names.items()})


def parse_openrouter(docs: DataFrame, now_ms: int) -> DataFrame:
    """Ids with a ':' are variants and have no price of their own."""
    names = {"input": "prompt", "output": "completion", "cache_read": "input_cache_read", "cache_write": "input_cache_write"}
    rows = _items(docs, f"struct<id: string, pricing: struct<{', '.join(f'{n}: string' for n in names.values())}>>", "$.data").withColumn("id", F.col("v.id")).where(~F.col("id").contains(":"))
    return book_rows(rows, "openrouter", now_ms, **{c: _per_million(f"v.pricing.{n}") for c, n in names.items()})


def parse_vercel(docs: DataFrame, now_ms: int) -> DataFrame:
    return _priced_items(docs, now_ms, "vercel", {"input": "input", "output": "output", "cache_read": "input_cache_read", "cache_write": "input_cache_write"})


def parse_helicone(docs: DataFrame, now_ms: int, first_party: tuple[str, ...] = ("ANTHROPIC", "OPENAI", "GOOGLE", "X", "MISTRAL", "DEEPSEEK")) -> DataFrame:
    """First-party prices; exact names are written after patterns, so they win."""
    fields = "struct<provider: string, model: string, operator: string, input_cost_per_1m: string, output_cost_per_1m: string, prompt_cache_read_per_1m: string, prompt_cache_write_per_1m: string>"
    rows = _items(docs, fields, "$.data").where(F.upper("v.provider").isin(list(first_party)))
    rows = rows.withColumn("at", (F.col("v.operator") == "equals").cast("bigint") * 1_000_000 + F.col("at")).withColumn("id", F.col("v.model"))
    return book_rows(rows, "helicone", now_ms, input=_number(F.col("v.input_cost_per_1m")), output=_number(F.col("v.output_cost_per_1m")), cache_read=_number(F.col("v.prompt_cache_read_per_1m")), cache_write=_number(F.col("v.prompt_cache_write_per_1m")))


def parse_langfuse(docs: DataFrame, now_ms: int) -> DataFrame:
    """The default tier's prices, else the first tier's; rows with one blended price are left out."""
    rows = _items(docs, "struct<modelName: string, pricingTiers: array<struct<isDefault: boolean, prices: map<string, string>>>>").withColumn("id", F.col("v.modelName"))
    tier = F.coalesce(F.get(F.filter("v.pricingTiers", lambda t: t["isDefault"]), 0), F.get("v.pricingTiers", 0))["prices"]
    rows = rows.withColumn("p", tier).where("p IS NOT NULL AND (p['input'] IS NOT NULL OR p['output'] IS NOT NULL)")
    some = lambda *keys: F.coalesce(*(_number(F.col("p")[k]) for k in keys)) * 1e6
    return book_rows(rows, "langfuse", now_ms, input=some("input"), output=some("output"), cache_read=some("input_cache_read", "cache_read_input_tokens", "input_cached_tokens"), cache_write=some("input_cache_creation", "cache_creation_input_tokens", "input_cache_write"))


def parse_llm_prices(docs: DataFrame, now_ms: int) -> DataFrame:
    """Rows whose name has a '>' are surcharges and are left out."""
    rows = _items(docs, "struct<id: string, name: string, input: string, output: string, input_cached: string>", "$.prices").where(~F.coalesce(F.col("v.name").contains(">"), F.lit(False))).withColumn("id", F.col("v.id"))
    return book_rows(rows, "llm-prices", now_ms, input=_number(F.col("v.input")), output=_number(F.col("v.output")), cache_read=_number(F.col("v.input_cached")))


def parse_portkey(docs: DataFrame, now_ms: int, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Cents a token; 'default' is no model, and where prefixes are given ids must begin with one."""
    price = "struct<price: string>"
    fields = f"struct<pricing_config: struct<pay_as_you_go: struct<request_token: {price}, response_token: {price}, cache_read_input_token: {price}, cache_write_input_token: {price}>>>"
    rows = _entries(docs, fields).where("id <> 'default'")
    if prefixes:
        rows = rows.where(F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.col("id").startswith(p)))
    cents = lambda c: _per_million(f"v.pricing_config.pay_as_you_go.{c}.price", 1e4)
    return book_rows(rows, "portkey", now_ms, input=cents("request_token"), output=cents("response_token"), cache_read=cents("cache_read_input_token"), cache_write=cents("cache_write_input_token"))


def parse_seed(docs: DataFrame, now_ms: int, stored: DataFrame | None = None) -> DataFrame:
    """The built-in snapshot {id: [in, out, read, write]}, only while no price is stored."""
    rows = book_rows(_entries(docs, "array<string>"), "seed", now_ms, **{c: _number(F.get("v", i)) for i, c in enumerate(("input", "output", "cache_read", "cache_write"))})
    return rows if stored is None else rows.join(F.broadcast(stored.agg(F.count("*").alias("_n"))), F.col("_n") == 0).drop("_n")  # one row


def _rates(entries: DataFrame, source: str) -> DataFrame:
    return entries.select(F.lit(source).alias("source"), F.upper("id").alias("currency"), _number(F.col("v")).alias("rate")).where("rate > 0")


def parse_fx_json(docs: DataFrame, source: str = "primary") -> DataFrame:
    return _rates(_entries(docs, "string", "$.rates"), source)


def parse_fx_fallback(docs: DataFrame, source: str = "fallback") -> DataFrame:
    """Like the first, of documents that report success."""
    return parse_fx_json(docs.where(F.get_json_object("doc", "$.result") == "success"), source)


def parse_fx_ecb(docs: DataFrame, base: str = "USD", source: str = "ecb") -> DataFrame:
    """The bank's euro rates crossed to ``base``; nothing without a rate for the base."""
    pair = r"currency=['\"]([A-Z]{3})['\"]\s+rate=['\"]([0-9.]+)['\"]"
    found = docs.select(F.explode(F.arrays_zip(F.regexp_extract_all("doc", F.lit(pair), 1).alias("id"), F.regexp_extract_all("doc", F.lit(pair), 2).alias("v"))).alias("p")).select("p.id", F.col("p.v").try_cast("double").alias("v")).where("v > 0")
    euro = found.where(F.col("id") == base).agg(F.max("v").alias("euro_base")).where("euro_base IS NOT NULL")
    every = found.where(F.col("id") != base).unionByName(found.sparkSession.createDataFrame([("EUR", 1.0)], "id string, v double"))
    crossed = every.crossJoin(F.broadcast(euro)).select("id", (F.col("v") / F.col("euro_base")).alias("v"))  # one row
    return _rates(crossed.unionByName(euro.select(F.lit(base).alias("id"), F.lit(1.0).alias("v"))), source)


def pick_rates(rates: DataFrame, code: str, order: tuple[str, ...] = ("primary", "fallback", "ecb")) -> DataFrame:
    """All rates of the first source that has ``code``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = rates.where(F.col("currency") == code).select(F.min_by("source", rank).alias("_source"))
    return rates.join(F.broadcast(best), F.col("source") == F.col("_source")).drop("_source")  # one row
