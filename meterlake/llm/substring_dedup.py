"""Removal of repeated passages, with a count-min prefilter over word windows.

A window is 20 consecutive words. Every window is counted through its anchor, the run of 8 words in it with the smallest
hash, so neighbouring windows share a count and a window that occurs n times has an anchor that occurs n times at least.

First pass: a count-min sketch of ROWS rows, each with CELLS_PER_ANCHOR to twice as many counters as there are anchors.
Each chunk of documents makes its own sketch, kept sparse: the cells that it touches, by row and block of BLOCK_BITS
cells. Spark brings the pieces of a block together, their counters are added, and every piece is told which of its cells
count two or more. An anchor's estimate is the least of its counters, so it never falls below the true count.

Second pass: the windows whose anchor is estimated to repeat are grouped exactly, by 128 bits of hash, to find where each
began first. Of each chunk only a window's first occurrence is shuffled; its others are known to be repeats, so a
window of very many documents sends one row for each chunk. No repeated window is lost.

Equal texts are one text to both passes: every window of a copy starts earlier in the first copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import tokens
from meterlake.llm.common import Scratch, spread_join

WINDOW, ANCHOR = 20, 8
#: Rows of the sketch, least counters of a row for each anchor, and the bits of a cell's place in its block.
ROWS, CELLS_PER_ANCHOR, BLOCK_BITS = 3, 4, 22
#: Anchors of a chunk that is sketched at a time, and windows of a chunk whose first occurrences are found at a time.
CHUNK_ANCHORS, CHUNK_WINDOWS = 500_000, 500_000
#: Text of one bucket of the documents that the second pass reads.
BUCKET_BYTES = 48_000_000
_SPAN = WINDOW - ANCHOR + 1
_SEEDS = tokens.stream(91, ROWS)


def _anchors(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows, the anchor of each, marks of the words where anchors start, hashes of the runs)."""
    starts = tokens.whole(bounds, WINDOW)
    grams = tokens.windows(hashes, ANCHOR, seed=3)
    picked = np.zeros(len(hashes), bool)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), picked, grams
    span = len(grams) - _SPAN + 1
    least = grams[:span].copy()
    for j in range(1, _SPAN):
        np.minimum(least, grams[j : j + span], out=least)
    inside = np.zeros(span, np.uint64)
    inside[starts] = least[starts]
    most = np.zeros(len(grams), np.uint64)
    for j in range(_SPAN):
        np.maximum(most[j : j + span], inside, out=most[j : j + span])
    picked[: len(grams)] = (most == grams) & (most > 0)
    return starts, least[starts], picked, grams


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its words, the digest of all its words, and its anchors, one that stands more than once in it twice."""
    names = ["doc_id", "place", "text_a", "text_b"]
    for batch in batches:
        counts, digests, anchors = [], [], []
        for chunk in tokens.words(batch.column("text"), tokens.SPACED):
            _, _, picked, grams = _anchors(chunk.hashes(), chunk.bounds)
            at = np.flatnonzero(picked)
            cuts = np.searchsorted(at, chunk.bounds).tolist()
            own = grams[at].view(np.int64)
            counts += chunk.counts.tolist()
            for row, (begin, end) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)):
                digests.append(hashlib.sha256(chunk.joined(np.arange(begin, end))).digest())
                once, times = np.unique(own[cuts[row] : cuts[row + 1]], return_counts=True)
                anchors.append(np.concatenate([once, once[times > 1]]))
        new = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))]
        yield pa.record_batch([*(batch.column(c) for c in names), *new], names=[*names, "n_words", "whole", "anchors"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each list begins."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the number of the chunk that they are sketched in."""
    from pyspark import TaskContext

    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for n in np.diff(np.asarray(batch.column("anchors").offsets)).tolist():
            if held and held + n > CHUNK_ANCHORS:
                chunk, held = chunk + 1, 0
            held += n
            numbers.append(chunk)
        yield pa.record_batch([pa.array(numbers, pa.int64()), *batch.columns], names=["chunk", *batch.schema.names])


def cells_of(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each anchor in a row of 2**bits."""
    return (tokens.mix(anchors.view(np.uint64) ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_pieces(anchors: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, block, cells touched within the block in order, their counters) of a chunk's own sketch."""
    for row in range(ROWS):
        cells, times = np.unique(cells_of(anchors, row, bits), return_counts=True)
        blocks = cells >> BLOCK_BITS
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(cells) else np.zeros(0, int)
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)], strict=True):
            yield row, int(blocks[begin]), (cells[begin:end] & ((1 << BLOCK_BITS) - 1)).astype(np.int32), times[begin:end].astype(np.int32)


def merged(pieces: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """The counters of one block of the merged sketch: the sums of its pieces' counters."""
    total = np.zeros(size, np.int64)
    for cells, times in pieces:
        total[cells] += times  # a piece lists a cell once
    return total


def _pieces(bits: int):
    names = ["row", "block", "chunk", "cells", "times"]

    def made(chunk: int, anchors: list[np.ndarray]) -> pa.RecordBatch:
        found = list(sketch_pieces(np.concatenate(anchors), bits))
        cols = list(zip(*found, strict=True)) or [[]] * 4
        lists = pa.list_(pa.int32())
        return pa.record_batch(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array([chunk] * len(found), pa.int64()), pa.array(cols[2], lists), pa.array(cols[3], lists)], names=names
        )

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            values, offsets = _lists(batch.column("anchors"))
            chunks = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])) if len(chunks) else np.zeros(0, int)
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chunks)], strict=True):
                if held and chunks[begin] != now:
                    yield made(now, held)
                    held = []
                now = int(chunks[begin])
                held.append(values[offsets[begin] : offsets[end]])
        if held:
            yield made(now, held)

    return sketched


def _answered(pieces: pa.Table) -> pa.Table:
    """For each piece of one block, a bit for each of its cells: whether the merged counter is two or more."""
    cells, offsets = _lists(pieces.column("cells").combine_chunks())
    times, _ = _lists(pieces.column("times").combine_chunks())
    own = [(cells[a:b], times[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    often = merged(own, int(cells.max()) + 1) > 1
    bits = [np.packbits(often[at]).tobytes() for at, _ in own]
    return pa.table([pieces.column("chunk"), pieces.column("row"), pieces.column("block"), pa.array(bits, pa.binary())], names=["chunk", "row", "block", "often"])


def _estimated(bits: int):
    kinds = pa.schema([("place", pa.int64()), ("text_a", pa.int64()), ("wanted", pa.list_(pa.int64()))])

    def looked_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The texts of one chunk that hold anchors whose least counter is two or more, with those anchors."""
        values, offsets = _lists(texts.column("anchors").combine_chunks())
        told = {(r, b): bits_ for r, b, bits_ in zip(*(answers.column(c).to_pylist() for c in ("row", "block", "often")), strict=True)}
        keep = np.ones(len(values), bool)
        for row in range(ROWS):
            cells, back = np.unique(cells_of(values, row, bits), return_inverse=True)
            blocks = cells >> BLOCK_BITS
            often = np.zeros(len(cells), bool)
            for block in np.unique(blocks).tolist():
                begin, end = np.searchsorted(blocks, [block, block + 1])
                often[begin:end] = np.unpackbits(np.frombuffer(told[row, block], np.uint8), count=end - begin).astype(bool)
            keep &= often[back]
        upto = np.append(0, np.cumsum(keep))[offsets]
        some = np.flatnonzero(np.diff(upto))
        wanted = pa.array([np.unique(values[offsets[i] : offsets[i + 1]][keep[offsets[i] : offsets[i + 1]]]) for i in some.tolist()], kinds.field("wanted").type)
        return pa.table([*(texts.column(c).combine_chunks().take(pa.array(some)) for c in ("place", "text_a")), wanted], schema=kinds)

    return looked_up


def _firsts(a: np.ndarray, b: np.ndarray, place: np.ndarray, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which occurrences are their window's first of a chunk, and which come later than one in it."""
    order = np.lexsort((start, text, place, b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (place[order] != place[head]) | (text[order] != text[head]) | (start[order] != start[head])
    return order[new], order[later]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor is wanted: of each chunk the first occurrences with their hashes, the later ones as lists by text."""
    lists = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), lists]
    names = ["window_a", "window_b", "place", "text_a", "start", "sure"]
    held: list[list[np.ndarray]] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        a, b, place, text, start = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = _firsts(a, b, place, text, start)
        yield pa.record_batch([*(pa.array(x[first], k) for x, k in zip((a, b, place, text, start), kinds, strict=False)), pa.nulls(len(first), lists)], names=names)
        later = later[np.lexsort((text[later], place[later]))]
        if len(later):
            cuts = np.flatnonzero(np.append(True, (place[later][1:] != place[later][:-1]) | (text[later][1:] != text[later][:-1])))
            sure = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(later)), pa.int32()), pa.array(start[later], pa.int32()))
            none = [pa.nulls(len(cuts), k) for k in kinds]
            yield pa.record_batch([none[0], none[1], pa.array(place[later][cuts]), pa.array(text[later][cuts]), none[4], sure], names=names)

    for batch in batches:
        values, offsets = _lists(batch.column("wanted"))
        places, texts = batch.column("place").to_numpy(), batch.column("text_a").to_numpy()
        for chunk in tokens.words(batch.column("text"), tokens.SPACED):
            one = chunk.hashes()
            starts, anchors, _, _ = _anchors(one, chunk.bounds)
            if not len(starts):
                continue
            owner = np.searchsorted(chunk.bounds, starts, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(chunk.bounds)))
            keep = np.zeros(len(starts), bool)
            for row in range(len(chunk.bounds) - 1):
                own = values[offsets[chunk.first + row] : offsets[chunk.first + row + 1]]
                keep[cuts[row] : cuts[row + 1]] = np.isin(anchors[cuts[row] : cuts[row + 1]].view(np.int64), own)
            at, row = starts[keep], chunk.first + owner[keep]
            two = tokens.windows(chunk.hashes(seed=2), WINDOW, seed=2)
            held.append([tokens.windows(one, WINDOW)[at].view(np.int64), two[at].view(np.int64), places[row], texts[row], (at - chunk.bounds[owner[keep]]).astype(np.int32)])
            if sum(len(x[0]) for x in held) >= CHUNK_WINDOWS:
                yield from flushed()
                held = []
    if held:
        yield from flushed()


def _stays(column: pa.Array, marks: list[list[int] | None], copies: list[bool | None]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text its words, which of them stay, and those joined by one space."""
    for chunk in tokens.words(column, tokens.SPACED):
        for row, (begin, end) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)):
            n = end - begin
            gone = np.zeros(n + 1, np.int32)
            if copies[chunk.first + row] and n >= WINDOW:
                gone[0] = 1
            elif (own := marks[chunk.first + row]) is not None:
                at = np.array(own, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
            stays = np.flatnonzero(np.cumsum(gone[:n]) <= 0)
            yield n, stays, chunk.joined(begin + stays)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, n - len(stays), hashlib.sha256(text).hexdigest()) for n, stays, text in _stays(batch.column("text"), batch.column("marks").to_pylist(), batch.column("copy").to_pylist())]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.record_batch(
            [batch.column("doc_id"), *map(pa.array, cols, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        rows = [(n - len(stays), hashlib.sha256(text).digest()) for n, stays, text in _stays(batch.column("text"), marks, [False] * len(marks))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
        yield pa.record_batch([batch.column("place"), batch.column("text_a"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["place", "text_a", "n_removed", "kept"])


_LAST = 2**63 - 1


def _keys() -> dict:
    """What names a text: its place in the order of ids, a null id being last, and two hashes."""
    text = F.col("text").cast("string")
    return {"place": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "text_a": F.xxhash64(F.lit(1), text), "text_b": F.xxhash64(F.lit(2), text)}


class _Repeats:
    """The passes over ``docs`` (doc_id, text), each written to scratch tables."""

    def __init__(self, docs: DataFrame):
        self.scratch = scratch = Scratch(docs.sparkSession, "repeats")
        self.slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(_keys())
        key = ["text_a", "text_b"]
        schema = "doc_id long, place long, text_a long, text_b long, n_words long, whole binary, anchors array<long>"
        read = scratch.save(self.slim.mapInArrow(_read, schema), "read")
        # equal texts are counted once, as the first of them
        once = read.where(F.size("anchors") > 0).groupBy(*key)
        once = once.agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
        texts = scratch.save(once.mapInArrow(_chunked, "chunk long, text_a long, text_b long, place long, copies long, anchors array<long>"), "texts")
        #: every row: its keys, its words and the digest of all its words
        self.rows = scratch.save(read.drop("anchors"), "rows")
        #: the texts that hold a window, their first place and how many rows have them
        self.texts = scratch.save(texts.select(*key, "place", "copies"), "heads")
        scratch.drop("read")
        wanted = self._wanted(texts)
        scratch.drop("texts")
        self.candidates, self.marks = self._found(wanted)

    def _wanted(self, texts: DataFrame) -> DataFrame:
        """(place, text_a, wanted): the anchors that the merged sketch takes for repeated."""
        total = texts.agg(F.sum(F.size("anchors"))).first()[0] or 1
        bits = max(8, (int(total) * CELLS_PER_ANCHOR - 1).bit_length())
        pieces = texts.select("chunk", "anchors").mapInArrow(_pieces(bits), "row int, block long, chunk long, cells array<int>, times array<int>")
        answers = self.scratch.save(pieces.groupBy("row", "block").applyInArrow(_answered, "chunk long, row int, block long, often binary"), "answers")
        own = texts.select("chunk", "place", "text_a", "anchors").groupBy("chunk")
        wanted = own.cogroup(answers.groupBy("chunk")).applyInArrow(_estimated(bits), "place long, text_a long, wanted array<long>")
        wanted = self.scratch.save(wanted, "wanted")
        self.scratch.drop("answers")
        return wanted

    def _found(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The texts that hold wanted anchors, and (place, text_a, marks): the starts of repeated windows.

        Texts are dealt by their keys once, into buckets that both joins read as they are.
        """
        key, scratch = ["place", "text_a"], self.scratch
        size = self.slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-int(size) // BUCKET_BYTES))
        texts = self.slim.select(*key, "text").repartition(buckets, *key).join(wanted.hint("shuffle_hash"), key)
        texts = scratch.bucketed(texts.select(*key, "text", "wanted"), "candidates", buckets, key)
        found = texts.mapInArrow(_candidates, "window_a long, window_b long, place long, text_a long, start int, sure array<int>")
        found = scratch.save(found, "windows")
        # a window's rows are as many as chunks that hold it at most; rows that agree in all their keys are no repeats
        order = F.rank().over(Window.partitionBy("window_a", "window_b").orderBy(*key, "start"))
        later = found.where("window_a IS NOT NULL").withColumn("order", order).where("order > 1").select(*key, F.array("start").alias("starts"))
        later = later.unionByName(found.where("window_a IS NULL").select(*key, F.col("sure").alias("starts")))
        marks = scratch.save(later.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("marks")), "marks")
        scratch.drop("windows")
        return texts, marks

    def per_row(self, its: DataFrame) -> DataFrame:
        """Every row with ``its`` columns by text (text_a, text_b, copies); a text of a third of all rows is spread."""
        return spread_join(self.rows, its, ["text_a", "text_b"], "copies", F.xxhash64("place"), "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id or before in the same document.
    Windows are judged on the input. kept_sha256 hashes the words that stay, joined by one space. Null and empty texts
    have no words. A null doc_id comes after all others. Rows that agree in doc_id and text are one document and get the
    same result; rows that share a doc_id alone go by their text's hash. An empty table gives no rows. Other columns are
    not read.
    """
    found = _Repeats(docs)
    key = ["place", "text_a"]
    judged = found.candidates.select(*key, "text").join(found.marks.hint("shuffle_hash"), key)
    judged = judged.select(*key, "text", "marks").mapInArrow(_judged, "place long, text_a long, n_removed long, kept binary").distinct()
    its = found.texts.select("text_a", "text_b", F.col("place").alias("head"), "copies").join(judged.withColumnRenamed("place", "head"), ["head", "text_a"], "left")
    its = found.scratch.save(its.where("copies > 1 OR n_removed > 0"), "judged")
    copy = F.coalesce(F.col("place") > F.col("head"), F.lit(False))
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "whole"))
    return found.per_row(its).select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its rows and columns, the texts that lose words being the words that stay, joined by one space.

    Rows, nulls, empty texts, repeated rows and empty tables are treated as by remove_repeats; a text that loses nothing
    stays as it is, a null stays null, and further columns may have any names. A column n_chars, if there is one, is
    made to agree with the new text.
    """
    own = docs.columns
    found = _Repeats(docs)
    heads = found.texts.where("copies > 1").select("text_a", "text_b", F.col("place").alias("head"), "copies")
    copies = found.per_row(heads).where("place > head").select("place", "text_a").distinct()
    marked = found.marks.select("place", "text_a", "marks", F.lit(False).alias("copy"))
    marked = found.scratch.save(marked.unionByName(copies.select("place", "text_a", F.lit(None).cast("array<int>").alias("marks"), F.lit(True).alias("copy"))), "marked")
    keys = _keys()
    # a struct keeps the columns of documents apart from those of this join
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), keys["place"].alias("place"), keys["text_a"].alias("text_a"))
    joined = rows.join(marked, ["place", "text_a"], "left").select("row", "marks", "copy")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(own, batch.column("row").flatten(), strict=True))
            text = columns["text"]
            old = text.to_pylist()
            found = _stays(text, batch.column("marks").to_pylist(), batch.column("copy").to_pylist())
            new = [words.decode() if len(stays) < n else before for before, (n, stays, words) in zip(old, found, strict=True)]
            columns["text"] = pa.array(new, text.type)
            if "n_chars" in own:
                kind = columns["n_chars"].type
                counts = [a if b is c else len(c) for a, b, c in zip(columns["n_chars"].to_pylist(), old, new, strict=True)]
                columns["n_chars"] = pa.array(counts, kind)
            yield pa.record_batch(list(columns.values()), names=own)

    return joined.mapInArrow(rewrite, docs.schema)
