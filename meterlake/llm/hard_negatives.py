"""Hard negatives of anchors, found exactly through a tree of hyperplane cells.

A GNAT: each node has a few split points, every vector belongs to the cell of the nearest one, and of each pair of a split
point and a cell the tree keeps the smallest and largest distance between the point and what lies in the cell. An anchor
wants vectors whose score lies in a window; that is an annulus around it, and a cell is left out if its range about any
split point shows that it can't meet the annulus. What is left is compared exactly, cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import Scratch

#: Split points of a node, levels at most, and rows for which a leaf is wanted; deeper trees have no more than WAYS ** LEVELS leaves.
WAYS, LEVELS, LEAF_ROWS = 16, 3, 512
#: Rows that reach the driver, to choose split points from and to bound windows early. Every row is indexed whatever is drawn.
SAMPLE = 4096
#: Rows and anchors of a leaf that one task compares; larger leaves are split by both.
CELL_ROWS, CELL_ANCHORS = 32_768, 32_768
#: Scores that are compared at a time.
_BLOCK = 2_000_000
#: Doubles hold all whole numbers below this.
_EXACT = 2**52
_NO_ID = 2**63 - 1


@dataclass
class Node:
    points: np.ndarray  #: split points, with their last coordinate (see lift)
    children: list[Node | int]  #: or the numbers of leaves
    number: int = 0
    low: np.ndarray | None = None  #: by split point and cell
    high: np.ndarray | None = None


def whole_vectors(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of each component; vectors that are shorter than the longest are filled up with zeros."""
    out = np.zeros((len(column), dim))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def lift(vectors: np.ndarray, square: float) -> np.ndarray:
    """One more coordinate, which makes all rows equally long (``square`` is the largest squared length); an anchor's is 0.

    Then the distance of anchor and row says their inner product, and a window of scores is an annulus.
    """
    return np.column_stack([vectors, np.sqrt(np.maximum(square - (vectors * vectors).sum(1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def build(sample: np.ndarray, levels: int) -> tuple[Node, int]:
    """A tree over some lifted vectors, and its number of leaves; split points are chosen far from each other."""
    leaves = nodes = 0

    def grow(rows: np.ndarray, level: int) -> Node | int:
        nonlocal leaves, nodes
        chosen = [0] if len(rows) else []
        if level and len(rows):
            near = _distances(rows, rows[:1])[:, 0]
            while len(chosen) < WAYS and near.max() > 1e-3:
                chosen.append(int(near.argmax()))
                near = np.minimum(near, _distances(rows, rows[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            leaves += 1
            return leaves - 1
        node = Node(rows[chosen], [], nodes)
        nodes += 1
        cell = _distances(rows, node.points).argmin(1)
        node.children = [grow(rows[cell == j], level - 1) for j in range(len(chosen))]
        return node

    root = grow(sample, levels)
    if isinstance(root, int):  # all alike, or none: one cell
        root = Node(sample[:1] if len(sample) else np.zeros((1, sample.shape[1])), [root])
    return root, leaves


def _descend(node: Node, rows: np.ndarray, at: np.ndarray, leaf: np.ndarray, seen: Callable[[Node, np.ndarray, np.ndarray], None] | None) -> None:
    far = _distances(rows[at], node.points)
    cell = far.argmin(1)
    if seen:
        seen(node, far, cell)
    for j, child in enumerate(node.children):
        mine = at[cell == j]
        if isinstance(child, int):
            leaf[mine] = child
        elif len(mine):
            _descend(child, rows, mine, leaf, seen)


def _leaf_of(root: Node, rows: np.ndarray, seen=None) -> np.ndarray:
    leaf = np.zeros(len(rows), np.int32)
    _descend(root, rows, np.arange(len(rows)), leaf, seen)
    return leaf


def _batches(it: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _router(root: Node, dim: int, square: float):
    """The leaf of each row."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            leaf = _leaf_of(root, lift(whole_vectors(batch.column("vec"), dim), square))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return route


def _ranger(root: Node, dim: int, square: float):
    """Of each node, split point and cell, the smallest and largest distance within a task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def seen(node: Node, far: np.ndarray, cell: np.ndarray) -> None:
            k = len(node.points)
            low, high = found.setdefault(node.number, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
            for j in np.unique(cell):
                low[:, j] = np.minimum(low[:, j], far[cell == j].min(0))
                high[:, j] = np.maximum(high[:, j], far[cell == j].max(0))

        for batch in _batches(batches):
            _leaf_of(root, lift(whole_vectors(batch.column("vec"), dim), square), seen)
        rows = [(n, i, j, low[i, j], high[i, j]) for n, (low, high) in found.items() for i in range(len(low)) for j in range(len(low)) if low[i, j] < np.inf]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["node", "point", "cell", "low", "high"])

    return measure


def _set_ranges(node: Node, ranges: dict[tuple[int, int, int], tuple[float, float]]) -> None:
    k = len(node.points)
    node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for i in range(k):
        for j in range(k):
            node.low[i, j], node.high[i, j] = ranges.get((node.number, i, j), (np.inf, -np.inf))
    for child in node.children:
        if isinstance(child, Node):
            _set_ranges(child, ranges)


def surviving(root: Node, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, leaf) of all leaves that may hold something inside an annulus of the anchor; a column of ``inner`` and ``outer`` is a window."""
    who, where = [], []

    def visit(node: Node, at: np.ndarray) -> None:
        far = _distances(anchors[at], node.points)[:, :, None]
        nearest = np.maximum(far - node.high, node.low - far).max(1)  # by anchor and cell; empty cells are infinitely far
        farthest = (far + node.high).min(1)
        met = ((nearest[:, :, None] <= outer[at][:, None] + slack) & (farthest[:, :, None] >= inner[at][:, None] - slack)).any(2)
        for j, child in enumerate(node.children):
            mine = at[met[:, j]]
            if isinstance(child, int):
                who.append(mine)
                where.append(np.full(len(mine), child, np.int32))
            elif len(mine):
                visit(child, mine)

    visit(root, np.arange(len(anchors)))
    return np.concatenate(who), np.concatenate(where)


def _scores(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Inner products: by doubles where they hold every sum, else by 64-bit numbers."""
    if square < _EXACT:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row, the leftmost first where they tie."""
    n = scores.shape[1]
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    if max(abs(scores.max(initial=0)), abs(scores.min(initial=0))) * n < _EXACT:
        rank = np.where(allowed, scores * n - np.arange(n), -np.inf)
        best = np.argpartition(-rank, min(k, n) - 1, axis=1)[:, :k]
        rows, place = np.nonzero(np.take_along_axis(rank, best, 1) > -np.inf)
        return rows, best[rows, place]
    found = [(i, j) for i in range(len(scores)) for j in sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j, s=scores[i]: (-int(s[j]), j))[:k]]
    return np.array([x[0] for x in found], int), np.array([x[1] for x in found], int)


@dataclass
class Search:
    """What tasks need of the index; its size is bounded by WAYS, LEVELS and SAMPLE."""

    root: Node
    dim: int
    square: float
    sample: np.ndarray  #: whole vectors
    labels: np.ndarray
    uids: np.ndarray
    k: int

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + self.square**0.5)

    def radius(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance at which rows have these scores."""
        return np.sqrt(np.maximum((anchors * anchors).sum(1)[:, None] + self.square - 2 * scores, 0))


def _visits(search: Search, windows: bool):
    """A row for each anchor and leaf that may hold what it wants: rows of its label, or others inside the windows of its positives.

    The sample bounds what is wanted: a row that comes after k rows of the sample isn't among the first k.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 512):
            vectors = whole_vectors(batch.column("vec"), search.dim)
            labels, uids = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("label", "uid"))
            known = _scores(vectors, search.sample, search.square).astype(float)
            same = labels[:, None] == search.labels

            def kth(allowed: np.ndarray, else_: np.ndarray, known: np.ndarray = known) -> np.ndarray:
                if known.shape[1] < search.k:
                    return else_
                found = -np.partition(-np.where(allowed, known, -np.inf), search.k - 1, axis=1)[:, search.k - 1]
                return np.maximum(found, else_)

            n = len(vectors)
            if windows:
                wanted = batch.column("positives").to_pylist()
                high = np.full((n, max(map(len, wanted))), np.nan)
                for i, scores in enumerate(wanted):
                    high[i, : len(scores)] = [x["score"] for x in scores]
                low = np.column_stack([kth(~same & (known <= high[:, [w]]) & (100 * known >= 80 * high[:, [w]]), 0.8 * high[:, w]) for w in range(high.shape[1])])
                inner, outer = search.radius(vectors, high), search.radius(vectors, low)
                none = ~(high >= 0)  # a window of a negative score is empty
                inner[none], outer[none] = np.inf, -np.inf
            else:
                low = kth(same & (uids[:, None] != search.uids), np.full(n, -np.inf))
                inner, outer = np.zeros((n, 1)), search.radius(vectors, low[:, None])
            who, where = surviving(search.root, np.column_stack([vectors, np.zeros(n)]), inner, outer, search.slack)
            out = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where)], [*out.schema.names, "leaf"])

    return visit


def _comparer(search: Search, windows: bool):
    """Exactly compare the anchors that visit a cell with its rows; of each anchor (and window) the first k of the cell."""

    def compare(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            ids = rows.column("vec_id").fill_null(_NO_ID).to_numpy()
            uids = rows.column("uid").to_numpy()
            order = np.lexsort([uids, ids])  # ties go by vec_id
            ids, uids, labels = ids[order], uids[order], rows.column("label").to_numpy()[order]
            vectors = whole_vectors(rows.column("vec"), search.dim)[order]
            asked, mine, my_labels = whole_vectors(anchors.column("vec"), search.dim), anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
            wanted = anchors.column("positives").to_pylist() if windows else None
            step = max(1, _BLOCK // len(ids))
            for at in range(0, len(mine), step):
                part = slice(at, at + step)
                scores = _scores(asked[part], vectors, search.square)
                same = my_labels[part, None] == labels
                if not windows:
                    i, j = _first(scores, same & (mine[part, None] != uids), search.k)
                    found.append((mine[part][i], np.full(len(i), -1), scores[i, j].astype(np.int64), ids[j], uids[j]))
                    continue
                for w in range(max(map(len, wanted[part]))):
                    has = np.array([len(x) > w for x in wanted[part]])
                    high = np.array([x[w]["score"] if len(x) > w else -1 for x in wanted[part]])[:, None]
                    of = np.array([x[w]["uid"] if len(x) > w else -1 for x in wanted[part]])
                    i, j = _first(scores, ~same & has[:, None] & (scores <= high) & (100 * scores >= 80 * high), search.k)
                    found.append((mine[part][i], of[i], scores[i, j].astype(np.int64), ids[j], uids[j]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        vec_id = pa.array(cols[3].astype(np.int64), mask=cols[3] == _NO_ID)
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64)), vec_id, pa.array(cols[4].astype(np.int64))], ["anchor", "positive", "score", "vec_id", "uid"])

    return compare


def _search(search: Search, anchors: DataFrame, rows: DataFrame, cells: DataFrame, blocks: int, windows: bool) -> DataFrame:
    """(anchor, positive, score, vec_id, uid, rank) of the first k of each anchor, and window."""
    cells = F.broadcast(cells)  # of at most WAYS ** LEVELS leaves
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    asked = anchors.mapInArrow(_visits(search, windows), f"{fields}, leaf int").join(cells, "leaf")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.hash("uid"), F.lit(blocks))).drop("parts")
    dealt = rows.join(cells, "leaf").withColumn("part", F.pmod(F.hash("uid"), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("parts")
    key = ["leaf", "part", "block"]
    found = asked.groupBy(key).cogroup(dealt.groupBy(key)).applyInArrow(_comparer(search, windows), "anchor long, positive long, score long, vec_id long, uid long")
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= search.k)


def mine(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """For each anchor (vec_id divisible by 100) and each of its ``k`` best rows of its label, the ``k`` best rows of other
    labels that score between 80 % and 100 % of that one.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows that repeat are rows of their
    own, so an anchor's copy may be its positive; a null vec_id comes last among ties and is no anchor; vectors of fewer
    components than the longest are filled up with zeros, an empty one is all zeros; scores must fit 63 bits. Further
    columns aren't read, and an empty table gives no rows. To the driver go SAMPLE rows, and the distance ranges of the tree.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    label = F.col("label").cast("long")
    rows = embeddings.where(
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").alias("vec"),
    )
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x)
    is_anchor = F.col("vec_id") % 100 == 0
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.max(square).alias("square"), F.count_if(is_anchor).alias("anchors")).first()
    dim, square = max(stats["dim"] or 0, 1), stats["square"] or 0.0
    drawn = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).toArrow()
    sample = whole_vectors(drawn.column("vec"), dim)
    levels = 1
    while levels < LEVELS and WAYS**levels * LEAF_ROWS < stats["n"]:
        levels += 1
    root, _ = build(lift(sample, square), levels)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    indexed = scratch.save(rows.mapInArrow(_router(root, dim, square), f"{fields}, leaf int"), "rows")
    ranges = indexed.mapInArrow(_ranger(root, dim, square), "node int, point int, cell int, low double, high double")
    ranges = ranges.groupBy("node", "point", "cell").agg(F.min("low"), F.max("high")).collect()  # bounded by the tree
    _set_ranges(root, {tuple(r[:3]): tuple(r[3:]) for r in ranges})
    search = Search(root, dim, square, sample, drawn.column("label").to_numpy(), drawn.column("uid").to_numpy(), k)
    cells = scratch.save(indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")), "cells")
    blocks = max(1, -(-stats["anchors"] // CELL_ANCHORS))

    anchors = indexed.where(is_anchor).drop("leaf")
    positives = scratch.save(_search(search, anchors, indexed, cells, blocks, False), "positives")
    wanted = positives.groupBy("anchor").agg(F.collect_list(F.struct("score", "uid")).alias("positives"))  # k of each
    asking = anchors.join(wanted, F.col("uid") == F.col("anchor")).drop("anchor")
    negatives = _search(search, asking, indexed, cells, blocks, True)
    of = positives.select("anchor", F.col("uid").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(of, ["anchor", "positive"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
