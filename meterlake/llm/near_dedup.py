"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct 5-word shingles. Its sketch has COORDINATES bins. In round i every shingle is hashed
anew: in the first COORDINATES rounds into a random bin, after that all into the round's own bin; a bin keeps the
smallest hash of the first round that reached it, so every bin fills within twice as many rounds and equal coordinates
estimate the Jaccard index with the concentration of independent draws. BANDS bands of ROWS coordinates give each
document's bucket keys: a pair at the threshold shares none with a chance of about one in a million.

Documents of equal sets are one node. In every bucket the node of smallest id is the hub; pairs are compared on their
full sets in three rounds: each node with the hub it shares most buckets with, then with its other hubs, then with the
other members of buckets that still hold several components. Pairs that components already join are never compared, so
a large group costs a comparison or two for each member. Buckets that hold several components even so are compared
block by block: a task gets two blocks of about BLOCK members, or fewer where these are long, takes only the pairs whose
first common band is this bucket's, leaves out those that links of earlier members join, and returns links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import tokens
from meterlake.llm.common import Scratch, spread_join

SHINGLE = 5
BANDS, ROWS = 50, 5
COORDINATES = BANDS * ROWS
#: Least 100 * intersection / union of a link.
PERCENT = 75
#: Members compared with one copy of their hub's text.
GROUP = 64
#: Members of a mixed bucket that one task holds of each of two blocks, and about how many shingles they have together.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000

_ROUND, _VALUE = 10, 45
_SEEDS = tokens.stream(77, 2 * COORDINATES)
_BAND_WEIGHTS = tokens.stream(78, ROWS) | np.uint64(1)
_BAND_SEEDS = tokens.stream(79, BANDS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of a set of 64-bit shingles, which must not be empty."""
    full = np.zeros(COORDINATES, np.uint64)
    empty = np.ones(COORDINATES, bool)
    low = np.uint64((1 << _VALUE) - 1)
    step, first = max(1, 4096 // len(shingles)), 0
    while first < 2 * COORDINATES:
        rounds = np.arange(first, min(first + step, 2 * COORDINATES), dtype=np.uint64)
        hashed = tokens.mix(shingles[None, :] ^ _SEEDS[first : first + len(rounds), None])
        bins = ((hashed >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)
        late = rounds >= COORDINATES
        if late.any():
            bins[late] = (rounds[late] - np.uint64(COORDINATES))[:, None]
        keys = ((bins << np.uint64(_ROUND + _VALUE)) | (rounds[:, None] << np.uint64(_VALUE)) | (hashed & low)).ravel()
        keys.sort()
        at = (keys >> np.uint64(_ROUND + _VALUE)).astype(np.int64)
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1]
        at, keys = at[lead], keys[lead]
        new = empty[at]
        full[at[new]], empty[at[new]] = keys[new], False
        if not empty.any():
            break
        first += len(rounds)
    return full


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    rows = coordinates.reshape(BANDS, ROWS) * _BAND_WEIGHTS
    return tokens.mix(rows.sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS).view(np.int64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    for chunk in tokens.words(column, tokens.SPACED):
        hashes = chunk.hashes(lower=True)
        every = tokens.windows(hashes, SHINGLE)
        bounds = chunk.bounds.tolist()
        for begin, end in zip(bounds, bounds[1:], strict=False):
            if end - begin >= SHINGLE:
                yield np.unique(every[begin : end - SHINGLE + 1])
            elif end > begin:
                yield tokens.windows(hashes[begin:end], end - begin)
            else:
                yield np.zeros(0, np.uint64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for shingles in shingle_sets(batch.column("text")):
            if len(shingles):
                a, b = (int(tokens.mix(shingles * s).sum(dtype=np.uint64).view(np.int64)) for s in (np.uint64(3), np.uint64(5)))
                rows.append((len(shingles), a, b, band_keys(sketch(shingles))))
            else:
                rows.append((0, None, None, None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch([batch.column("doc_id"), batch.column("own"), *map(pa.array, cols, kinds)], names=["doc_id", "own", "n_shingles", "set_a", "set_b", "bands"])


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Members of ``group`` linked with its hub, on full sets."""
    sets = list(shingle_sets(pa.array(group["text"], pa.large_string())))
    ids, hub = group["doc_id"].to_numpy(), int(group["hub"].iloc[0])
    hubs = [s for i, s in zip(ids, sets, strict=True) if i == hub and len(s)]
    found = set()
    for i, own in zip(ids, sets, strict=True):
        for other in hubs:
            if i != hub and 100 * min(len(own), len(other)) >= PERCENT * max(len(own), len(other)):
                shared = int(np.isin(own, other, assume_unique=True).sum())
                if 100 * shared >= PERCENT * (len(own) + len(other) - shared):
                    found.add(int(i))
    return pd.DataFrame({"a": hub, "b": sorted(found)}, columns=["a", "b"])


def _verified(scratch: Scratch, texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (hub, member) that are links. A hub of many members meets them in groups, each with its own copy of the hub's text."""
    pairs = scratch.save(pairs.select("hub", "member"), f"{name}_pairs")
    busy = scratch.save(pairs.groupBy("hub").count().where(F.col("count") > GROUP).select(F.col("hub").alias("busy"), F.ceil(F.col("count") / GROUP).alias("groups")), f"{name}_busy")
    part = F.pmod(F.xxhash64("member"), F.coalesce("groups", F.lit(1)))
    dealt = pairs.join(busy, pairs.hub == busy.busy, "left").select("hub", "member", part.alias("part"))
    needs = dealt.select("hub", "part", F.col("member").alias("needed")).unionByName(dealt.select("hub", "part", F.col("hub").alias("needed")).distinct())
    needs = scratch.save(needs, f"{name}_needs")
    met = texts.join(needs, texts.doc_id == needs.needed).select("hub", "part", "doc_id", "text")
    links = scratch.save(met.groupBy("hub", "part").applyInPandas(_linked, "a long, b long"), f"{name}_links")
    scratch.drop(f"{name}_needs")
    return links


def _crossed(group: pd.DataFrame) -> pd.DataFrame:
    """Links between members of different components in two blocks of a bucket, or in one with itself."""
    group = group.drop_duplicates(["node", "text"]).reset_index(drop=True)
    key, low, high = (int(group[c].iloc[0]) for c in ("key", "low", "high"))
    sets = list(shingle_sets(pa.array(group["text"], pa.large_string())))
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    known, places = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), bool)
    nodes, bands = group["node"].to_numpy(), np.stack(group["bands"].to_numpy())
    side, own = group["block"].to_numpy(), np.unique(group["c"].to_numpy(), return_inverse=True)[1]
    band = int(np.flatnonzero(bands[0] == key)[0])
    found = []
    order = np.arange(len(group)) if low == high else np.flatnonzero(side == low)
    for i in order.tolist():
        others = np.arange(i + 1, len(group)) if low == high else np.flatnonzero(side == high)
        alike = PERCENT * np.maximum(sizes[i], sizes[others]) <= 100 * np.minimum(sizes[i], sizes[others])
        others = others[alike & (own[others] != own[i])]
        others = others[(bands[others] == bands[i]).argmax(axis=1) == band]
        if not len(others):
            continue
        marked[places[first[i] : first[i] + sizes[i]]] = True
        upto = np.cumsum(sizes[others])
        at = np.arange(int(upto[-1])) + np.repeat(first[others] - (upto - sizes[others]), sizes[others])
        shared = np.add.reduceat(marked[places[at]].astype(np.int64), upto - sizes[others])
        marked[places[first[i] : first[i] + sizes[i]]] = False
        for j in others[100 * shared >= PERCENT * (sizes[i] + sizes[others] - shared)].tolist():
            if own[j] != own[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                own[own == own[j]] = own[i]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _blockwise(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the members (key, node, n, c) of mixed buckets."""
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "c")
    known = texts.join(nodes.select("node", "bands"), texts.doc_id == nodes.node).select(F.col("node").alias("_node"), "bands", "text")
    # an id that stands for several texts has several lists of bands
    full = dealt.join(known, F.col("node") == F.col("_node")).where(F.array_contains("bands", F.col("key"))).drop("_node")
    return full.groupBy("key", "low", "high").applyInPandas(_crossed, "a long, b long")


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it can reach.

    Every node points to its smallest neighbour or itself, pointers are followed to their ends, and the graph is drawn
    together to those ends until no edge is left. Only counts reach the driver.
    """
    edges = scratch.save(edges.select("a", "b").distinct(), f"{name}_edges")
    labels, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("end")).select(F.col("a").alias("node"), "end")
        ends = scratch.save(ends, f"{name}_ends{step}")
        moved = True
        while moved:
            step += 1
            far = ends.select(F.col("node").alias("at"), F.col("end").alias("far"))
            ends = scratch.save(ends.join(far, F.col("end") == F.col("at")).select("node", F.col("far").alias("end"), (F.col("end") != F.col("far")).alias("moved")), f"{name}_ends{step}")
            moved = bool(ends.where("moved").limit(1).count())
        ends = ends.select(F.col("node").alias("at"), "end")
        if labels is None:
            labels = ends.select(F.col("at").alias("node"), F.col("end").alias("component"))
        else:
            labels = labels.join(ends, F.col("component") == F.col("at"), "left").select("node", F.coalesce("end", "component").alias("component"))
            labels = scratch.save(labels, f"{name}_labels{step}")
        drawn = edges.join(ends, F.col("a") == F.col("at")).select(F.col("end").alias("a"), "b")
        drawn = drawn.join(ends, F.col("b") == F.col("at")).select("a", F.col("end").alias("b")).where("a <> b").distinct()
        edges = scratch.save(drawn, f"{name}_edges{step}")
        if not edges.limit(1).count():
            return labels


def _alike(a: str, b: str):
    """Whether two set sizes leave room for a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _own(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _found(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_shingles, set_a, set_b, component_id) of every row of ``docs``, own being a hash of its text."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("own", _own(F.col("text")))
    rows = scratch.save(slim.mapInArrow(_sketched, "doc_id long, own long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketches")

    nodes = rows.where("set_a IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_a", "set_b")
    nodes = scratch.save(nodes.agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    bands = scratch.save(nodes.select(F.explode("bands").alias("key"), "node", "n"), "bands")
    hubs = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    hubs = scratch.save(hubs.select("key", F.col("first.node").alias("hub"), F.col("first.n").alias("hub_n"), "size"), "hubs")
    met = scratch.save(bands.join(hubs, "key").select("key", "size", "node", "n", "hub", "hub_n"), "met")
    scratch.drop("bands")
    near = met.where(F.col("node") != F.col("hub")).where(_alike("n", "hub_n")).groupBy("hub", F.col("node").alias("member")).agg(F.count("*").alias("shared"))
    near = scratch.save(near, "near")

    wanted = met.select(F.col("node").alias("wanted")).distinct()
    texts = scratch.save(slim.join(wanted, slim.doc_id == wanted.wanted, "left_semi"), "texts")

    best = near.groupBy("member").agg(F.max(F.struct("shared", (-F.col("hub")).alias("minus"))).alias("best"))
    best = scratch.save(best.select((-F.col("best.minus")).alias("hub"), "member"), "best")
    links = _verified(scratch, texts, best, "first")
    joined = components(scratch, links, "first")

    def component(df: DataFrame, node: str, name: str) -> DataFrame:
        """``df`` with the component of a node; a node without links is its own."""
        its = joined.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return df.join(its, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", node)).drop("_node", "_component")

    others = near.join(best, ["hub", "member"], "left_anti")
    others = component(component(others, "hub", "hub_c"), "member", "member_c").where("hub_c <> member_c")
    links = links.unionByName(_verified(scratch, texts, others, "second"))
    joined = components(scratch, links, "second")

    split = component(met.where("size > 2").select("key", "node", "n", "hub"), "node", "c")
    split = scratch.save(split, "split")
    mixed = split.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select(F.col("key").alias("mixed"))
    mixed = scratch.save(mixed, "mixed")
    open_ = scratch.save(split.join(mixed, split.key == mixed.mixed, "left_semi").where("node <> hub"), "open")
    links = links.unionByName(scratch.save(_blockwise(open_, nodes, texts), "third_links"))
    joined = components(scratch, links, "third")

    ends = scratch.save(component(nodes.select("set_a", "set_b", "node", "rows"), "node", "component_id").select("set_a", "set_b", "component_id", "rows"), "ends")
    scratch.keep_only("sketches", "ends")
    out = spread_join(rows.drop("bands"), ends, ["set_a", "set_b"], "rows", F.xxhash64("doc_id", "own"), "left").drop("rows")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than a shingle is one
    shingle; without words, or null, its set is empty and it is linked with nothing. Links have at least PERCENT % of
    their union in common. component_id is the smallest doc_id that links reach; kept says that it is the row's own.
    Repeated rows get equal results. A null doc_id can't name a component: such a row takes the component of its text's
    other copies, or null, and is kept if that is null. An empty table gives no rows. Other columns are not read.
    """
    out = _found(Scratch(docs.sparkSession, "near"), docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns, whatever their names.

    The row of smallest doc_id stays; of several texts with that id the one of smallest hash, and of rows that agree in
    both any one. Rows without words are near to nothing, so of them only repeats of doc_id and text go. A row without a
    doc_id goes if a row with one has its set of shingles; of rows without doc_ids that have equal sets one stays. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    out = _found(scratch, docs).groupBy("doc_id", "own").agg(
        F.first("component_id").alias("component_id"), F.first("set_a").alias("set_a"), F.first("set_b").alias("set_b"), F.count("*").alias("times")
    )
    out = scratch.save(out, "found")
    # those that may stay, by what only one of them may stay for
    open_ = out.where("set_a IS NOT NULL AND component_id <=> doc_id")
    best = open_.groupBy("component_id", F.when(F.col("component_id").isNull(), F.struct("set_a", "set_b")).alias("set")).agg(F.min(F.struct("own", "doc_id")).alias("best")).select("best.*")
    stays = out.where("set_a IS NULL").select("own", "doc_id").unionByName(best)
    where = lambda df: df.select(F.col("own").alias("_own"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"))
    same = ["_own", "_id", "_none"]
    gone = where(out).join(where(stays), same, "left_anti").withColumn("_gone", F.lit(True))
    twice = where(out.where("times > 1")).withColumn("_twice", F.lit(True))
    marked = scratch.save(gone.join(twice, same, "full"), "marked")
    scratch.keep_only("marked")
    # a struct keeps the columns of documents apart from those of this join
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _own(F.col("text")).alias("_own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")
    )
    left = rows.join(marked.where("_gone"), same, "left_anti")
    repeated = marked.where("_twice AND _gone IS NULL").select(*same)
    if repeated.limit(1).count():
        one = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
        once = left.join(repeated, same).withColumn("_nth", one).where("_nth = 1")
        left = left.join(repeated, same, "left_anti").select("row").unionByName(once.select("row"))
    return left.select("row.*")
