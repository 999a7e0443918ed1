"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash. A source's mix is whole rounds of its documents plus those whose hash is at most
the source's threshold. Thresholds come from nested histograms: words by source and the hash's top bits, then by the
next bits inside the one bucket where the budget runs out, then by single hash values inside that bucket's boundary
bucket. Documents are never sorted; they are filtered by their source's threshold. Only where equal rows share the hash
at which the budget runs out, these rows are numbered and as many taken as come nearest to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import SPACED_WORD, Scratch

WEIGHTS = (1, 2, 3)
#: No source, and so no document, is repeated more often.
MOST_ROUNDS = 3
HASH_BITS, LEVEL_BITS = 60, 12


def mix_hash(doc_id: Column, text: Column) -> Column:
    """A 60-bit hash of a row; it only depends on the row, so reruns agree."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(scratch: Scratch, df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``number``, from 0 in the given order: ranges are numbered apart and shifted by the rows before them."""
    ranges = scratch.save(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    before = ranges.groupBy("range").count()
    before = before.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    row = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("number", row).join(before, "range").withColumn("number", (F.col("number") + F.col("before")).cast("long")).drop("range", "before")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target): the shares of all words by weight, none above MOST_ROUNDS times its source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = numbered(scratch, totals, "sources", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = scratch.save(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    cap = MOST_ROUNDS * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = None, -1
    while True:  # each pass caps at least one more source; only sums leave the executors
        capped = F.lit(False) if level is None else level * F.col("weight") > cap
        n, words, rest = table.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped_before:
            break
        left, weights_left, capped_before = total - words, rest, n
        level = F.lit(float(left)) / F.lit(float(weights_left)) if weights_left else F.lit(float("inf"))
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weights_left or 1))
    return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def _boundary(words: DataFrame, cell: str) -> DataFrame:
    """Of each source, the first cell up to which the words reach the budget, with the words before it."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(cell))
    run = words.withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
    first = run.withColumn("row", F.row_number().over(Window.partitionBy("source").orderBy(cell))).where("row = 1")
    return first.select("source", F.col(cell).alias("cell"), (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget"))


def _of(table: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with what belongs to their source; a null source finds its row as well."""
    return table.join(columns.withColumnRenamed("source", "_its"), F.col("source").eqNullSafe(F.col("_its")), "inner").drop("_its")


def _sized(docs: DataFrame) -> tuple[Column, Column]:
    """The size and the hash of each row."""
    text = F.col("text").cast("string")
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long"), mix_hash(F.col("doc_id"), text)


def _plan(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target, rounds, threshold) from (source, size, mix_hash)."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(scratch, sizes, weights).withColumn("rounds", rounds)
    targets = scratch.save(targets.withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "targets")

    step = HASH_BITS - LEVEL_BITS
    top = sizes.groupBy("source", F.shiftright("mix_hash", step).alias("bucket")).agg(F.sum("size").alias("words"))
    edge = scratch.save(_boundary(_of(top, targets.select("source", "budget")), "bucket"), "edge")
    at_edge = _of(sizes, edge).where(F.shiftright("mix_hash", step) == F.col("cell"))
    step -= LEVEL_BITS
    finer = at_edge.groupBy("source", "budget", F.shiftright("mix_hash", step).alias("bucket")).agg(F.sum("size").alias("words"))
    edge = scratch.save(_boundary(finer, "bucket"), "finer_edge")
    single = _of(sizes, edge).where(F.shiftright("mix_hash", step) == F.col("cell"))
    single = single.groupBy("source", "budget", "cell", "mix_hash").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    left = F.col("budget") - F.sum("words").over(Window.partitionBy("source").orderBy("mix_hash")) + F.col("words")
    # of the rows of a hash value, all of one size, those are taken that bring the words nearer to the budget
    fit = F.when(F.col("words") > 0, F.floor(left * F.col("rows") / F.col("words") + 0.5)).otherwise(F.when(left >= 0, F.col("rows")).otherwise(0))
    single = single.withColumn("fit", F.greatest(F.lit(0), F.least(fit, "rows")))
    in_part = (F.col("fit") > 0) & (F.col("fit") < F.col("rows"))
    single = single.groupBy("source").agg(
        F.max(F.when(F.col("fit") == F.col("rows"), F.col("mix_hash"))).alias("last"),
        F.first("cell").alias("cell"),
        F.max(F.when(in_part, F.col("mix_hash"))).alias("part_hash"),
        F.max(F.when(in_part, F.col("fit"))).alias("part_rows"),
    )
    threshold = F.coalesce("last", F.shiftleft("cell", step) - 1)
    thresholds = single.select(F.col("source").alias("_its"), threshold.alias("threshold"), "part_hash", "part_rows")
    plan = targets.join(thresholds, F.col("source").eqNullSafe(F.col("_its")), "left").drop("_its")
    return scratch.save(plan.select("source", "source_size", "target", "rounds", F.coalesce("threshold", F.lit(-1)).alias("threshold"), "part_hash", "part_rows"), "plan")


def _times(scratch: Scratch, rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, mix_hash and more) with their source's plan and ``times``, how often the mix takes each.

    Rows of a hash that is taken in part are numbered by a hash of all they hold, so reruns take equal rows.
    """
    planned = _of(rows, plan)
    whole = planned.withColumn("times", F.col("rounds") + (F.col("mix_hash") <= F.col("threshold")).cast("long"))
    if plan.where("part_hash IS NOT NULL").isEmpty():
        return whole
    parted = F.coalesce(F.col("mix_hash") == F.col("part_hash"), F.lit(False))
    held = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in rows.columns))))
    copies = planned.where(parted).withColumn("_held", held).withColumn("_spread", F.monotonically_increasing_id())
    copies = numbered(scratch, copies, "copies", F.col("source"), F.col("_held"), F.col("_spread"))
    begins = copies.groupBy("source").agg(F.min("number").alias("_begin"))
    copies = _of(copies, begins).withColumn("times", F.col("rounds") + (F.col("number") - F.col("_begin") < F.col("part_rows")).cast("long"))
    return whole.where(~parted).unionByName(copies.drop("number", "_begin", "_held", "_spread"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    Sizes count runs of anything but ASCII white space; a null text has size 0. A null source is a source, the last by
    code point. Rows that agree in doc_id and text share a hash; where the budget runs out among them, some are taken
    once more than the others. Sources without words have target 0, and an empty table gives no rows. Other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size, hashed = _sized(docs)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), hashed.alias("mix_hash"))
    sizes = scratch.save(slim, "sizes")
    mixed = _times(scratch, sizes, _plan(scratch, sizes, weights))
    scratch.keep_only("sizes", "plan", "copies")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and mix_times, how often each is taken.

    Rows, nulls and repeats are treated as by mix_sources; rows without words are never taken. Further columns may have
    any names, but for one called mix_times, which is replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size, hashed = _sized(docs)
    sizes = scratch.save(docs.select(F.col("source").cast("string"), size.alias("size"), hashed.alias("mix_hash")), "sizes")
    plan = _plan(scratch, sizes, weights).select("source", "rounds", "threshold", "part_hash", "part_rows")
    # a struct keeps the columns of documents apart from those of the plan
    own = [c for c in docs.columns if c != "mix_times"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("source").cast("string"), size.alias("size"), hashed.alias("mix_hash"))
    mixed = _times(scratch, rows, plan).where("times > 0 AND size > 0")
    scratch.keep_only("plan", "copies")
    return mixed.select("row.*", F.col("times").alias("mix_times"))
