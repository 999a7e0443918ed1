"""The price book: candidate names, the vote of the feeds, resolution of event names, costs and repricing."""

from __future__ import annotations

import re
import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators.metrics import has_tokens
from meterlake.schema import PRICE_COLUMNS

#: How far each feed is trusted (its place is its rank), and what may be peeled off a model name.
TRUST = {
    "portkey": 1.0, "langfuse": 1.0, "llm-prices": 1.0, "openrouter": 1.0, "vercel": 1.0,
    "models.dev": 1.0, "helicone": 0.9, "litellm": 0.8, "llmpricing": 0.6, "seed": 0.0,
}
STRIP_PREFIXES = ("openai.", "anthropic.", "moonshot.", "bedrock.", "global.")
STRIP_SUFFIXES = ("-minimal", "-low", "-medium", "-high", "-xhigh", "-volc")

STALE_AFTER_MS = 12 * 3_600_000
#: Costs that differ by less are the same.
SAME_COST = 5e-10


@dataclass(frozen=True)
class Rules:
    """How quotes are weighed and names are matched."""

    schema: int = 1
    revision: int = 1
    trust: dict[str, float] = field(default_factory=lambda: dict(TRUST))
    unlisted_weight: float = 0.5
    tolerance: float = 0.06
    strip_prefixes: tuple[str, ...] = STRIP_PREFIXES
    strip_suffixes: tuple[str, ...] = STRIP_SUFFIXES
    anchor_markers: tuple[str, ...] = ("claude-",)
    date_suffix_lengths: tuple[int, ...] = (4, 6, 8)
    routing_models: tuple[str, ...] = ("auto",)
    aliases: dict[str, str] = field(default_factory=lambda: {"gemini-3.8-flash-n": "gemini-3.8-flash"})
    long_context_threshold: int = 200_000
    feed_urls: tuple[str, ...] = ()

    def __post_init__(self):
        checks = {
            "schema": self.schema == 1,
            "feed urls must be https": all(u.startswith("https://") for u in self.feed_urls),
            "tolerance": 0 < self.tolerance <= 0.5,
            "weights": min([self.unlisted_weight, *self.trust.values()]) >= 0,
            "long_context_threshold": self.long_context_threshold > 0,
            "date_suffix_lengths": all(1 <= n <= 8 for n in self.date_suffix_lengths),
        }
        if wrong := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"price rules: {', '.join(wrong)}")

    def rank(self, source: str) -> int:
        return list(self.trust).index(source) if source in self.trust else len(self.trust)

    def weight(self, source: str) -> float:
        return self.trust.get(source, self.unlisted_weight)


def load_rules(document: str, bundled: Rules | None = None) -> Rules:
    """Rules from a JSON document; it wins over the bundled ones if its revision is at least theirs."""
    bundled, given = bundled or Rules(), json.loads(document)
    known = {k: v for k, v in given.items() if k in Rules.__dataclass_fields__ and k != "trust"}
    for k in ("strip_prefixes", "strip_suffixes", "anchor_markers", "date_suffix_lengths", "routing_models"):
        if k in known:
            known[k] = tuple(known[k])
    trust = {"trust": {t["source"]: t["weight"] for t in given["trust"]}} if "trust" in given else {}
    rules = Rules(**known, **trust, feed_urls=tuple(f["url"] for f in given.get("feeds", [])))
    return rules if rules.revision >= bundled.revision else bundled


def expand_candidates(names: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(name, candidate, rank, primary): what each distinct name may be listed under, in the order of a breadth-first search.

    ``names`` has distinct names, so the rounds work on a small table; each peels one part off all candidates at once.
    The place of a candidate is its shortest path of peels, then the first such path.
    """
    start = names.select("name", F.posexplode(E.primary_keys(F.col("name"))).alias("at", "candidate"))
    frontier = start.select("name", "candidate", F.array("at").alias("path"), F.lit(True).alias("primary"))
    every, c = frontier, F.col("candidate")
    peels: list[Column] = [F.when(c.startswith(p), F.substring(c, F.lit(len(p) + 1), F.length(c))) for p in rules.strip_prefixes]
    for mark in rules.anchor_markers:
        at = F.length(c) - F.instr(F.reverse(c), mark[::-1]) - len(mark) + 2
        peels.append(F.when(c.contains(mark) & (at > 1), F.substring(c, at, F.length(c))))
    version = F.regexp_extract(c, r"^(.*)-v\d+$", 1)
    peels.append(F.when(c.rlike(r"-v[0-9]+$"), version))
    dates = "|".join(f"[0-9]{{{n}}}" for n in rules.date_suffix_lengths)
    peels.append(F.when(c.rlike(rf"-({dates})$"), F.regexp_replace(c, r"-[0-9]+$", "")))
    peels += [F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))) for s in rules.strip_suffixes]
    peels.append(F.when(c.rlike(r".-[a-z]$"), F.substring(c, F.lit(1), F.length(c) - 2)))
    while True:  # every peel shortens a name, so this ends
        found = frontier.select("name", "path", F.posexplode(F.array(*peels)).alias("rule", "peeled")).where("peeled IS NOT NULL AND peeled <> ''")
        found = found.select("name", F.col("peeled").alias("candidate"), F.concat("path", F.array("rule")).alias("path"))
        frontier = found.groupBy("name", "candidate").agg(F.min("path").alias("path")).withColumn("primary", F.lit(False))
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    place = F.struct(F.size("path").alias("depth"), "path")
    best = every.groupBy("name", "candidate").agg(F.min(place).alias("place"), F.max("primary").alias("primary"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("place")) - 1
    return best.select("name", "candidate", rank.alias("rank"), "primary")


def quote_groups(quotes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Quotes with the canonical key of their group and the group's display spelling: the most common, then the first."""
    keyed = quotes.withColumn("canon", E.canon_key(F.col("model_id"))).where("canon <> ''")
    spelled = keyed.groupBy("canon", "model_id").count()
    first = F.row_number().over(Window.partitionBy("canon").orderBy(F.desc("count"), "model_id"))
    names = spelled.withColumn("row", first).where("row = 1").select("canon", F.col("model_id").alias("display"))
    return keyed.join(names, "canon")


def _usable(q: dict) -> bool:
    shown = [q["input"], q["output"], q["cache_read"], q["cache_write"]]
    return all(pd.notna(v) and abs(v) != float("inf") and v >= 0 for v in shown) and q["input"] + q["output"] > 0


def _close(a: dict, b: dict, tolerance: float) -> bool:
    return all(a[c] == b[c] or abs(a[c] - b[c]) <= tolerance * max(a[c], b[c]) for c in ("input", "output"))


def _voters(quotes: list[dict], rules: Rules) -> list[dict]:
    """One usable quote of each source that votes: the one that most other sources are close to, the first of equals."""
    chosen: dict[str, tuple[int, dict]] = {}
    for q in quotes:
        friends = {o["source"] for o in quotes if o["source"] != q["source"] and _close(q, o, rules.tolerance)}
        if q["source"] not in chosen or len(friends) > chosen[q["source"]][0]:
            chosen[q["source"]] = (len(friends), q)
    picked = {id(q) for _, q in chosen.values()}
    return [q for q in quotes if id(q) in picked]


def vote(quotes: list[dict], rules: Rules) -> tuple[dict | None, str, list[str]]:
    """(price, source, stance of each quote) from quotes in order of trust; the price is None without a usable quote."""
    live = any(q["source"] != "seed" for q in quotes)
    aside = lambda q: live and q["source"] == "seed"
    voters = _voters([q for q in quotes if not aside(q) and _usable(q)], rules)
    if not voters:
        return None, quotes[0]["source"], ["Ignored" if aside(q) else "NoData" for q in quotes]
    camps: list[list[dict]] = []
    for q in voters:
        camp = next((c for c in camps if _close(c[0], q, rules.tolerance)), None)
        camp.append(q) if camp else camps.append([q])
    strongest = max(range(len(camps)), key=lambda i: (sum(rules.weight(q["source"]) for q in camps[i]), -i))
    if len(camps[strongest]) > 1 or len(voters) == 1:
        winner = camps[strongest]
    elif len(voters) == 2:
        winner = camps[0]
    else:
        middle = sorted(range(len(camps)), key=lambda i: (camps[i][0]["output"], camps[i][0]["input"], i))
        winner = camps[middle[len(middle) // 2]]
    price = {c: winner[0][c] for c in PRICE_COLUMNS}
    for column in PRICE_COLUMNS[2:]:
        missing = pd.isna(price[column]) or column.startswith("cache") and price[column] <= 0
        if missing:
            given = [q[column] for q in winner if pd.notna(q[column]) and q[column] > 0]
            price[column] = given[0] if given else 0.0 if column.startswith("cache") else None
    stand = []
    counted = {id(q) for q in voters}
    for q in quotes:
        if aside(q) or _usable(q) and id(q) not in counted:
            stand.append("Ignored")
        elif not _usable(q):
            stand.append("NoData")
        else:
            stand.append("Agrees" if _close(q, price, rules.tolerance) else "Dissents")
    return price, winner[0]["source"], stand


#: Groups that one task holds as Python objects at a time, however many rows Spark hands it in a batch.
VOTED_AT_ONCE = 256
#: A quote's own prices that the book's page shows.
QUOTED = ("input", "output", "cache_read")


def _voted(quotes: DataFrame, rules: Rules) -> DataFrame:
    """Every quote with its stance, its place in order of trust, and its group's verdict. A group is one model's quotes: a few dozen, as many as sources and spellings."""
    columns = [c for c in PRICE_COLUMNS if c in quotes.columns]
    numbers = quotes.select("source", "model_id", *(F.col(c).cast("double") for c in columns), *(F.lit(None).cast("double").alias(c) for c in PRICE_COLUMNS if c not in columns))
    numbers = numbers.fillna(0.0, ["input", "output", "cache_read", "cache_write"]).withColumn("canon", E.canon_key(F.col("model_id"))).where("canon <> ''")
    quote = ["source", "model_id", *PRICE_COLUMNS]
    grouped = numbers.groupBy("canon").agg(F.collect_list(F.struct(*quote)).alias("quotes"))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (b.slice(i, VOTED_AT_ONCE) for b in batches for i in range(0, b.num_rows, VOTED_AT_ONCE)):
            out = []
            for canon, group in zip(batch.column("canon").to_pylist(), batch.column("quotes").to_pylist(), strict=True):
                spelled = Counter(q["model_id"] for q in group)
                display = min(spelled, key=lambda m: (-spelled[m], m))
                group.sort(key=lambda q: (rules.rank(q["source"]), q["model_id"], q["source"]))
                price, source, stood = vote(group, rules)
                shown = dict.fromkeys(PRICE_COLUMNS) if price is None else price
                out += [{"canon": canon, "display": display, "source": q["source"], "model_id": q["model_id"], "stance": s, "verdict_source": source, "priced": price is not None, **shown, "place": i, **{f"quoted_{c}": q[c] for c in QUOTED}} for i, (q, s) in enumerate(zip(group, stood, strict=True))]
            yield pa.RecordBatch.from_pylist(out, schema)

    text, price = [(c, pa.string()) for c in ("canon", "display", "source", "model_id", "stance", "verdict_source")], [(c, pa.float64()) for c in PRICE_COLUMNS]
    schema = pa.schema([*text, ("priced", pa.bool_()), *price, ("place", pa.int32()), *((f"quoted_{c}", pa.float64()) for c in QUOTED)])
    prices = ", ".join(f"{c} double" for c in PRICE_COLUMNS)
    return grouped.mapInArrow(decide, f"canon string, display string, source string, model_id string, stance string, verdict_source string, priced boolean, {prices}, place int, " + ", ".join(f"quoted_{c} double" for c in QUOTED))


def _verdicts() -> list[Column]:
    """What a group's quotes say together."""
    agree, against = (F.count_if(F.col("stance") == s) for s in ("Agrees", "Dissents"))
    one = lambda c: F.first(c).alias(c)
    return [one("display"), F.first("verdict_source").alias("source"), one("priced"), agree.alias("agree"), (agree + against).alias("total"), *map(one, PRICE_COLUMNS)]


def consensus(quotes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(canon, display, source, agree, total, priced, prices): the book, one row a model."""
    return _voted(quotes, rules).groupBy("canon").agg(*_verdicts())


def stances(quotes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(canon, source, model_id, stance) of every quote."""
    return _voted(quotes, rules).select("canon", "source", "model_id", "stance")


def price_rows(quotes: DataFrame, limit: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """The book, or its first page of ``limit`` models: each one's verdict, whether it is disputed, and its quotes with their stances, the most trusted first."""
    quote = F.struct("place", F.col("source").alias("source"), "model_id", *(F.col(f"quoted_{c}").alias(c) for c in QUOTED), "stance")
    rows = _voted(quotes, rules).groupBy("canon").agg(*_verdicts(), F.array_sort(F.collect_list(quote)).alias("quotes"))
    shown = F.transform("quotes", lambda q: q.dropFields("place"))
    rows = rows.withColumn("quotes", shown).withColumn("disputed", F.col("agree") < F.col("total"))
    return rows if limit is None else rows.orderBy("display").limit(limit)


def search_prices(rows: DataFrame, text: str, disputed_only: bool = False) -> DataFrame:
    """Rows of which some spelling has every word of ``text``, those first whose display spelling begins with the first word."""
    words = [flat for w in re.split(r"[\s,]+", text.lower()) if (flat := "".join(c for c in w if c.isalnum()))]
    spellings = F.array_join(F.transform(F.array_append(F.transform("quotes", lambda q: q["model_id"]), F.col("display")), E.flatten), " ")
    for w in words:
        rows = rows.where(spellings.contains(w))
    if disputed_only:
        rows = rows.where("disputed")
    if not words:
        return rows.orderBy("display")
    return rows.orderBy(E.flatten(F.col("display")).startswith(words[0]).cast("int").desc(), "display")


def match_candidates(candidates: DataFrame, book: DataFrame) -> DataFrame:
    """Each name's first candidate that the book lists: (name, candidate, rank, primary, prices)."""
    listed = candidates.withColumn("canon", E.canon_key(F.col("candidate"))).join(book.where("priced"), "canon")
    best = F.row_number().over(Window.partitionBy("name").orderBy("rank"))
    return listed.withColumn("_best", best).where("_best = 1").drop("_best")


def resolve(names: DataFrame, book: DataFrame, overrides: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(raw, request, pricing_model, via, prices) of distinct (raw, request) names; names without a price are left out.

    First come a user's own prices for the raw and then the requested name, then aliases, then the candidates of the raw
    name unless it is a router's placeholder, then those of the requested name.
    """
    pairs = names.select("raw", "request").distinct()
    normal = lambda c: E.model_key(F.col(c))
    tries = [(F.col("raw"), "override", 0), (normal("raw"), "override", 1), (F.col("request"), "override", 2), (normal("request"), "override", 3)]
    found = []
    prices = list(PRICE_COLUMNS)
    if overrides is not None:
        own = overrides.where("NOT deleted").select(F.col("model_key").alias("key"), *(F.col(c) if c in overrides.columns else F.lit(None).cast("double").alias(c) for c in prices))
        for name, via, rank in tries:
            found.append(pairs.withColumn("key", name).join(own, "key").select("raw", "request", F.lit(rank).alias("order"), "key", F.lit(via).alias("via"), *prices))
    listed = book.where("priced").select("canon", *prices)
    targets = {k: v for k, v in rules.aliases.items()}
    if targets:
        # the aliases of the rules document: a handful of rows
        alias = F.broadcast(pairs.sparkSession.createDataFrame(sorted(targets.items()), "from string, to string").select(E.model_key(F.col("from")).alias("from"), E.model_key(F.col("to")).alias("key")))
        for name, rank in (("raw", 10), ("request", 11)):
            met = pairs.withColumn("from", normal(name)).join(alias, "from").withColumn("canon", E.canon_key(F.col("key"))).join(listed, "canon")
            found.append(met.select("raw", "request", F.lit(rank).alias("order"), "key", F.lit("alias").alias("via"), *prices))
    routing = normal("name").isin([m.lower() for m in rules.routing_models])
    distinct = pairs.select(F.col("raw").alias("name")).unionByName(pairs.select(F.col("request").alias("name"))).where("name IS NOT NULL").where(~routing).distinct()
    matched = match_candidates(expand_candidates(distinct, rules), book)
    exact = F.when(F.col("primary"), "exact").otherwise("prefix")
    first = pairs.join(matched, F.col("raw") == F.col("name")).select("raw", "request", F.lit(20).alias("order"), F.col("candidate").alias("key"), exact.alias("via"), *prices)
    second = pairs.where(~F.col("raw").eqNullSafe(F.col("request"))).join(matched, F.col("request") == F.col("name"))
    found += [first, second.select("raw", "request", F.lit(21).alias("order"), F.col("candidate").alias("key"), F.lit("prefix").alias("via"), *prices)]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = F.row_number().over(Window.partitionBy("raw", "request").orderBy("order", "key"))
    return every.withColumn("_best", best).where("_best = 1").select("raw", "request", F.col("key").alias("pricing_model"), "via", *prices)


def event_cost(threshold: int = 200_000) -> Column:
    """Dollars of a row that carries its prices per million tokens; long contexts pay the prices above the threshold."""
    price = F.col
    long = F.col("input_tokens") + F.col("cache_read_tokens") + E.cache_write_tokens() > threshold
    tier = lambda above, base: F.when(long, F.coalesce(price(above), base)).otherwise(base)
    written = F.when(price("cache_write") > 0, price("cache_write"))
    read = F.coalesce(F.when(price("cache_read") > 0, price("cache_read")), price("input") * 0.1)
    short_write = F.coalesce(written, price("input") * 1.25)
    long_write = F.coalesce(price("tier_1h_cache_write"), written * 2.0 / 1.25, price("input") * 2.0)
    total = (
        F.col("input_tokens") * tier("tier_above_200k_input", price("input"))
        + F.col("output_tokens") * tier("tier_above_200k_output", price("output"))
        + F.col("cache_read_tokens") * tier("tier_above_200k_cache_read", read)
        + F.col("cache_write_5m_tokens") * short_write
        + F.col("cache_write_1h_tokens") * long_write
    )
    return F.round(total / 1_000_000.0, 9)


def apply_prices(df: DataFrame, resolved: DataFrame, threshold: int = 200_000) -> DataFrame:
    """Rows with their pricing_model, cost_usd and cost_source; costs that were reported stay.

    Rows with unclassified tokens have no price. Resolved names are few; Spark broadcasts them while they are small.
    """
    raw = F.coalesce("model", "request_model")
    prices = resolved.select(F.col("raw").alias("_raw"), F.col("request").alias("_request"), F.col("pricing_model").alias("_key"), "via", *PRICE_COLUMNS)
    joined = df.join(prices, raw.eqNullSafe(F.col("_raw")) & F.col("request_model").eqNullSafe(F.col("_request")), "left")
    priced = F.col("_key").isNotNull() & (F.col("unclassified_tokens") <= 0)
    source = F.when(~priced, "unpriced").when(F.col("via") == "prefix", "estimated").otherwise("computed")
    known = F.col("cost_usd").isNotNull()
    return joined.withColumns(
        {
            "pricing_model": F.when(priced, F.col("_key")).otherwise(F.col("pricing_model")),
            "cost_source": F.when(known, F.col("cost_source")).otherwise(source),
            "cost_usd": F.when(known, F.col("cost_usd")).when(priced, event_cost(threshold)).otherwise(0.0),
        }
    ).drop("_raw", "_request", "_key", "via", *PRICE_COLUMNS)


def reprice(df: DataFrame, resolved: DataFrame, only_unpriced: bool, threshold: int = 200_000) -> DataFrame:
    """The rows whose price really changes, with their new one: unpriced rows, or all that the book priced."""
    from_book = F.col("cost_source").isin("computed", "estimated", "unpriced")
    asked = (F.col("cost_source") == "unpriced") if only_unpriced else from_book
    rows = df.where(asked & has_tokens())
    old = rows.withColumns({"_cost": F.col("cost_usd"), "_model": F.col("pricing_model"), "_source": F.col("cost_source"), "cost_usd": F.lit(None).cast("double"), "pricing_model": F.lit(None).cast("string")})
    new = apply_prices(old, resolved, threshold)
    changed = (F.abs(F.col("cost_usd") - F.coalesce("_cost", F.lit(0.0))) > SAME_COST) | ~F.col("pricing_model").eqNullSafe(F.col("_model")) | ~F.col("cost_source").eqNullSafe(F.col("_source"))
    return new.where(changed).drop("_cost", "_model", "_source")


def price_freshness(prices: DataFrame, anchor_ms: int, attempted_ms: int | None = None) -> DataFrame:
    """When a live feed was last read, and whether the last attempt is over 12 hours ago."""
    live = F.max(F.when(F.col("source") != "seed", F.col("fetched_at")))
    tried = F.coalesce(F.lit(attempted_ms).cast("bigint"), live)
    return prices.agg(live.alias("live_at"), F.coalesce(F.lit(anchor_ms) - tried > STALE_AFTER_MS, F.lit(True)).alias("stale"))


def rules_fingerprint(rules: Rules) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(asdict(rules), sort_keys=True).encode()).hexdigest()


def book_fingerprint(prices: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row that changes with any price or rule: skip the vote while it stays."""
    row = F.xxhash64(*(F.col(c) for c in prices.columns))
    return prices.agg(F.count("*").alias("n"), F.bit_xor(row).alias("content"), F.lit(rules_fingerprint(rules)).alias("rules"))


def keep_votes(quotes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The book of ``consensus``, each model with what its verdict rests on: a fingerprint of its quotes, and that of the rules."""
    return consensus(quotes, rules).join(_group_fingerprints(quotes), "canon").withColumn("rules", F.lit(rules_fingerprint(rules)))


def _group_fingerprints(quotes: DataFrame) -> DataFrame:
    """(canon, n_quotes, content): changes with any quote of the model; in any order of quotes the same, but for quotes that cancel out, which the count shows."""
    prices = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in PRICE_COLUMNS if c in quotes.columns]
    row = F.xxhash64("source", "model_id", *prices)
    return quotes.groupBy(E.canon_key(F.col("model_id")).alias("canon")).agg(F.count("*").alias("n_quotes"), F.sum(F.shiftright(row, 20)).alias("content"))


def revote(quotes: DataFrame, kept: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``keep_votes`` of ``quotes``, with ``voted``: models whose quotes and rules are those of ``kept`` keep their verdicts, only the others vote.

    Models that lost all quotes go, new ones vote. With changed rules every model votes.
    """
    now = _group_fingerprints(quotes).where("canon <> ''").withColumn("rules", F.lit(rules_fingerprint(rules)))
    basis = ["canon", "n_quotes", "content", "rules"]
    same = kept.join(now, basis, "left_semi")
    changed = now.join(kept.select(basis), basis, "left_anti").select("canon")
    again = quotes.withColumn("_canon", E.canon_key(F.col("model_id"))).join(changed, F.col("_canon") == F.col("canon"), "left_semi").drop("_canon")
    voted = keep_votes(again, rules)
    return same.withColumn("voted", F.lit(False)).unionByName(voted.withColumn("voted", F.lit(True)))


def names_of(df: DataFrame) -> DataFrame:
    """The distinct (raw, request) names of rows that are priced by name."""
    return df.select(F.coalesce("model", "request_model").alias("raw"), F.col("request_model").alias("request")).where("raw IS NOT NULL").distinct()


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
