"""The trie of conversations' shared beginnings.

Conversations are cut into blocks of a fixed number of turns. A block is known by the digest of all turns up to its end, so
conversations are grouped block by block in one aggregation. Turns are looked at only inside blocks that have siblings,
and there once for each distinct block; everywhere else a block's turns belong to the same conversations as the block.
Digests are 128 bits: each turn is hashed with its place, and a beginning's digest is the exclusive or of its turns', so
beginnings are running aggregates, which are split where a conversation is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import Scratch, spread_join

#: Turns of a block.
BLOCK = 4
#: Steps of a running aggregate that one task takes before the next one carries on.
STRIDE = 16_384
#: Turns of another conversation that a rebuilt one begins with, at most.
MAX_HEAD = 8
#: Characters of ids that are put together before they are dealt out by node.
_SEGMENT = 64_000
_NODE = ["a", "b", "depth"]


def _running(df: DataFrame, group: str, part: Column, order: list[Column], sums: dict[str, tuple], before: bool = False) -> DataFrame:
    """``df`` with running aggregates along each group, worked out part by part and carried from part to part.

    ``sums``: by name of the result (aggregate, combiner of two results, column). ``part`` must rise with ``order``.
    ``before`` leaves a row itself out.
    """
    df = df.withColumn("_part", part)
    local = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, "_part").agg(*(agg(column).alias(f"_{k}") for k, (agg, _, column) in sums.items()))
    carry = totals.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *(agg(f"_{k}").over(earlier).alias(f"_{k}") for k, (agg, _, _) in sums.items()))
    carry = carry.where(" or ".join(f"_{k} is not null" for k in sums))  # of groups with several parts only
    out = df.withColumns({k: agg(column).over(local) for k, (agg, _, column) in sums.items()})
    out = out.join(carry, (out[group] == F.col("_g")) & (out["_part"] == F.col("_p")), "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({k: both(F.coalesce(k, zero), F.coalesce(f"_{k}", zero)) for k, (_, both, _) in sums.items()}).drop("_g", "_p", "_part", *(f"_{k}" for k in sums))


def _xor(x: Column, y: Column) -> Column:
    return x.bitwiseXOR(y)


def build_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Turns stand by turn (null first; equal ones in a fixed order of their contents), a null role or text is empty. Conversation
    c is rebuilt from the first crc32(c) % 9 turns of conversation c - c % 5 (with the sign that SQL's % has) and its own
    turns after as many of its first. Rows of null conv_id belong to no conversation and take no part; rows that repeat are
    turns of their own; further columns aren't read; a table without conversations gives no nodes, not even a root.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("ta"),
        F.xxhash64(text, F.lit(2), role).alias("tb"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("ta"), F.col("tb")]
    ranges = turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id())  # a long conversation lies in several
    turns = scratch.save(ranges.withColumn("one", F.lit(1).cast("long")), "ranges")
    own = scratch.save(_running(turns, "conv_id", F.col("range"), order, {"pos": (F.sum, lambda x, y: x + y, F.col("one"))}).drop("one", "range", "turn"), "turns")

    # rebuild
    lengths = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    heads = own.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= MAX_HEAD)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "ta", "tb", "bytes"))).alias("head"))  # of MAX_HEAD turns at most
    plan = lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")}).join(heads, "base", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    plan = plan.select("conv_id", "n_own", "h", "head", (F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))
    plan = scratch.save(plan, "plan")
    tails = spread_join(own, plan.select("conv_id", "n_own", "h", (F.size("head") - F.col("h")).alias("shift")), ["conv_id"], "n_own", F.col("pos"))
    tails = tails.where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "ta", "tb", "bytes")
    rebuilt = plan.select("conv_id", F.inline("head")).unionByName(tails)
    placed = rebuilt.select("conv_id", "pos", F.xxhash64("ta", "pos", "tb").alias("a"), F.xxhash64("tb", "ta", "pos").alias("b"), "bytes")

    # blocks, each with the digest of what comes before it
    blocks = placed.groupBy("conv_id", ((F.col("pos") - 1) / BLOCK).cast("long").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("items"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
    )  # items: BLOCK turns at most
    stride = (F.col("k") / STRIDE).cast("long")
    blocks = _running(blocks, "conv_id", stride, [F.col("k")], {"before_a": (F.bit_xor, _xor, F.col("xa")), "before_b": (F.bit_xor, _xor, F.col("xb"))}, before=True)

    def digest(c: str, turns: Column) -> Column:
        """Of the beginning that ends after so many turns of the block."""
        return F.aggregate(F.slice("items", F.lit(1), turns), F.col(f"before_{c}"), lambda s, x: s.bitwiseXOR(x[c]))

    inside = F.transform(
        "items",
        lambda x, i: F.struct(
            x["pos"].alias("depth"), x["bytes"].alias("bytes"), digest("a", i + 1).alias("a"), digest("b", i + 1).alias("b"), digest("a", i).alias("parent_a"), digest("b", i).alias("parent_b")
        ),
    )
    last = F.element_at("inside", -1)
    blocks = blocks.select("conv_id", "k", "before_a", "before_b", inside.alias("inside"))
    blocks = scratch.save(blocks.select("*", last["a"].alias("a"), last["b"].alias("b"), last["depth"].alias("depth")), "blocks")

    # distinct blocks; turns of those that have siblings are told apart, the others' are as the block
    distinct = blocks.groupBy(*_NODE, "before_a", "before_b", "k").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("inside").alias("inside"))
    distinct = scratch.save(distinct, "distinct")
    after = ["before_a", "before_b", "k"]
    siblings = scratch.save(distinct.groupBy(after).agg(F.count(F.lit(1)).alias("n_blocks")), "siblings")
    known = spread_join(distinct, siblings, after, "n_blocks", F.col("a"))
    turn = known.select("n_convs", "conv_id", "n_blocks", F.inline("inside"))
    columns = [*_NODE, "parent_a", "parent_b", "bytes", "n_convs", "conv_id"]
    apart = turn.where("n_blocks > 1").groupBy(*columns[:6]).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = plan.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_a"), F.lit(None).cast("long").alias("parent_b"), zero.alias("bytes"), "n_convs", "conv_id")
    nodes = turn.where("n_blocks = 1").select(columns).unionByName(apart).unionByName(root)
    nodes = scratch.save(nodes, "nodes")

    # children and parents
    kids = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.save(nodes.join(kids, _NODE, "left").na.fill(0, ["n_children"]), "family")
    parents = nodes.where("n_children > 0").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_kids"))
    related = spread_join(nodes, parents, ["parent_a", "parent_b", "depth"], "n_kids", F.col("a"), "left").drop("n_kids")

    # A node is owned by its smallest member, which then owns all its longer beginnings too: a run of nodes down to its end.
    # What lies below a node is the rest of its run, and whole runs of members that own nothing as short as the node.
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    down = _running(
        related.withColumn("saved", saved).withColumn("leaf", (F.col("n_children") == 0).cast("long")),
        "conv_id", -F.floor(F.col("depth") / STRIDE), [F.desc("depth")],
        {"saved_below": (F.sum, lambda x, y: x + y, F.col("saved")), "leaves_below": (F.sum, lambda x, y: x + y, F.col("leaf"))},
    )
    runs = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.max("depth").alias("to"), F.sum(saved).alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    runs = scratch.save(runs.where("from > 0").withColumn("n_blocks", F.ceil(F.col("to") / BLOCK)), "runs")
    met = spread_join(blocks.select("conv_id", "k", "inside"), runs, ["conv_id"], "n_blocks", F.col("k"))
    shorter = met.where(F.col("k") * BLOCK + 1 < F.col("from")).select("from", "saved", "leaf", F.inline("inside")).where("depth < from").select(*_NODE, "saved", "leaf")
    shorter = shorter.unionByName(runs.select(zero.alias("a"), zero.alias("b"), zero.alias("depth"), "saved", "leaf"))
    shorter = shorter.groupBy(*_NODE).agg(F.sum("saved").alias("saved_runs"), F.sum("leaf").alias("leaf_runs"))

    out = down.join(shorter, _NODE, "left").join(_ends(plan, blocks), _NODE, "left")
    more = lambda c: F.coalesce(F.col(c), zero)
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_below") + more("leaf_runs")).alias("n_leaves"),
        (F.col("saved_below") + more("saved_runs")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that stand together, comma-joined up to some length; rows are sorted by node and id."""
    node, first, ids, size = None, None, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, first)), pa.array([",".join(ids)])], ["a", "b", "depth", "first", "ids"])

    for batch in batches:
        for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
            if key != node or size > _SEGMENT:
                if ids:
                    yield done()
                node, first, ids, size = key, conv_id, [], 0
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
    if ids:
        yield done()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's segments, one after the other; nothing but the digest's state is kept."""
    node, digest = None, None
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*_NODE, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if key != node:
                if digest:
                    rows.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if rows:
            yield out()
            rows = []
    if digest:
        rows = [(*node, digest.hexdigest())]
        yield out()


def _ends(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end. Ids are put together before a node's are brought to one task."""
    end = F.max_by(F.struct(*_NODE), "depth").alias("end")
    last = blocks.groupBy("conv_id").agg(end).select("conv_id", "end.*")
    zero = F.lit(0).cast("long")
    none = plan.where("length = 0").select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("depth"))
    ends = last.unionByName(none)
    node = "a long, b long, depth long"
    segments = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_segments, f"{node}, first long, ids string")
    return segments.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")
