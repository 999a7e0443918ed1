"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark's items. For each pattern length a shift table says, by the hash of the
last two words (a block) in view, how far the view can jump without missing a pattern; where the jump is 0, the block's
bucket names the patterns that end so, and the words themselves are compared. Documents are read once and nothing is
shuffled; what is broadcast is at most ``max_windows`` windows at a time, and a larger benchmark is searched in blocks
whose results are put together by document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import tokens
from meterlake.llm.common import PLAIN_WORD, lower_ascii

WINDOW = 10
#: Most windows of one broadcast block of the benchmark (about 100 bytes each).
MAX_WINDOWS = 200_000
#: Windows of one part of an item.
PART_WINDOWS = 10_000
TABLE_BITS = 20

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class WuManber:
    """Windows of one length in words, of items (item, words)."""

    def __init__(self, items: list[tuple[str, list[str]]], length: int):
        self.length, self.width = length, min(2, length)
        last = length - self.width
        self.owners: dict[tuple[bytes, ...], list[str]] = {}
        self.shift = np.full(1 << TABLE_BITS, last + 1, np.int64)
        self.buckets: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        column = pa.array([" ".join(own) for _, own in items], pa.large_string())
        for chunk in tokens.words(column, tokens.PLAIN):
            blocks = self.blocks(chunk.hashes(lower=True))
            for row, (begin, end) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)):
                item, own = items[chunk.first + row]
                # a block stands the further back in some window the more words come before it
                place = np.arange(end - begin - self.width + 1)
                np.minimum.at(self.shift, blocks[begin : begin + len(place)], last - np.minimum(place, last))
                plain = [w.encode() for w in own]
                for i, block in enumerate(blocks[begin + last : begin + len(place)].tolist()):
                    pattern = tuple(plain[i : i + length])
                    if pattern not in self.owners:
                        self.owners[pattern] = []
                        self.buckets[block].append(pattern)
                    self.owners[pattern].append(item)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return (tokens.windows(hashes, self.width, seed=9) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, blocks: np.ndarray, begin: int, end: int, word) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Where patterns stand among the words begin up to end."""
        jump = self.shift[blocks[begin : end - self.width + 1]].tolist()
        at, last = self.length - self.width, len(jump)
        while at < last:
            if ahead := jump[at]:
                at += ahead
                continue
            start = begin + at + self.width - self.length
            for pattern in self.buckets.get(int(blocks[begin + at]), ()):
                if all(word(start + j) == pattern[j] for j in range(self.length)):
                    yield start, pattern
            at += 1


def _automata(items: list[tuple[str, list[str]]]) -> list[WuManber]:
    by_length: dict[int, list[tuple[str, list[str]]]] = defaultdict(list)
    for item, item_words in items:
        by_length[min(WINDOW, len(item_words))].append((item, item_words))
    return [WuManber(own, length) for length, own in sorted(by_length.items())]


_BUILT: dict[str, list[WuManber]] = {}


class _Block:
    """A block of the benchmark, broadcast; its tables are built once in each Python worker, where those of the block before are let go."""

    def __init__(self, items: DataFrame):
        self.name = uuid.uuid4().hex
        self.shared = items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.select("item", "words").collect()])

    def tables(self) -> list[WuManber]:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = _automata(self.shared.value)
        return _BUILT[self.name]


def _found(column: pa.Array, automata: list[WuManber]) -> Iterator[tuple[int, int, np.ndarray, set[str]]]:
    """For each text: its row, its words, the words hit and the items met."""
    for chunk in tokens.words(column, tokens.PLAIN):
        hashes = chunk.hashes(lower=True)
        blocks = [a.blocks(hashes) for a in automata]
        bounds = chunk.bounds.tolist()
        word = lambda i: chunk.word(i).lower()  # noqa: E731  bytes.lower() changes A-Z alone
        for row, (begin, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
            hit, met = np.zeros(end - begin, bool), set()
            for automaton, its in zip(automata, blocks, strict=True):
                if end - begin >= automaton.length:
                    for start, pattern in automaton.search(its, begin, end, word):
                        hit[start - begin : start - begin + automaton.length] = True
                        met.update(automaton.owners[pattern])
            yield chunk.first + row, end - begin, hit, met


def _digest(met: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def _items(benchmark: DataFrame, max_windows: int) -> tuple[DataFrame, int]:
    """(item, words, block) of the items that have words, dealt to so many blocks; long items come in parts that share no window."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(f"({PLAIN_WORD})")).alias("words"),
    ).where(F.size("words") > 0)
    windows = F.greatest(F.size("words") - (WINDOW - 1), F.lit(1))
    total = items.agg(F.sum(windows)).first()[0] or 0
    blocks = max(1, -(-int(total) // max_windows))
    part = max(1, min(PART_WINDOWS, max_windows))
    parts = F.transform(F.sequence(F.lit(1), windows, F.lit(part)), lambda at: F.slice("words", at, part + WINDOW - 1))
    return items.select("item", F.explode(parts).alias("words")).withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))), blocks


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a word in a window of ``benchmark``, with all their columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are treated as by find_contamination.
    """
    items, blocks = _items(benchmark, max_windows)
    for block in range(blocks):  # what one block of the benchmark leaves goes to the next
        docs = _filtered(docs, items.where(F.col("block") == block))
    return docs


def _filtered(docs: DataFrame, items: DataFrame) -> DataFrame:
    block = _Block(items)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = block.tables()
        for batch in batches:
            yield batch.filter(pa.array([not hit.any() for _, _, hit, _ in _found(batch.column("text"), automata)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Words of ``docs`` (doc_id, text) that lie in a window of ``benchmark`` (item_id, text).

    A window is 10 consecutive words of an item; an item of fewer words, but not none, is one window. One row comes out
    for each row in, repeated rows included. A null or empty text has no words and is not contaminated; without items
    nothing is. Null item ids count as the item ''. Columns besides those named are not read.
    """
    items, blocks = _items(benchmark, max_windows)
    if blocks > 1:
        return _in_blocks(docs, items, blocks)
    block = _Block(items)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = block.tables()
        for batch in batches:
            rows = [(n, int(hit.sum()), len(met), _digest(met), bool(hit.any())) for _, n, hit, met in _found(batch.column("text"), automata)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, SCHEMA)


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """The same for a benchmark that is too large to broadcast at once: each block's hits, put together by row."""
    key = [F.col("doc_id").cast("long"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")]
    rows = docs.select(*key, "text").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "a", "b").orderBy(F.lit(0))))
    parts = []
    for number in range(blocks):
        block = _Block(items.where(F.col("block") == number))

        def hits(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automata = block.tables()
            for batch in batches:
                found = list(_found(batch.column("text"), automata))
                yield pa.record_batch(
                    [
                        *(batch.column(c) for c in ("doc_id", "a", "b", "copy")),
                        pa.array([n for _, n, _, _ in found], pa.int64()),
                        pa.array([np.flatnonzero(hit) for _, _, hit, _ in found], pa.list_(pa.int32())),
                        pa.array([sorted(met) for *_, met in found], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "a", "b", "copy", "n_words", "hit", "met"],
                )

        parts.append(rows.mapInArrow(hits, "doc_id long, a long, b long, copy int, n_words long, hit array<int>, met array<string>"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = F.array_sort(F.array_distinct(F.flatten(F.collect_list("met"))))
    together = every.groupBy("doc_id", "a", "b", "copy").agg(
        F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        met.alias("met"),
    )
    return together.select(
        "doc_id", "n_words", "n_hit", F.size("met").cast("long").alias("n_items"),
        F.sha2(F.array_join("met", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
