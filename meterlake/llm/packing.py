"""Documents packed into sequences of a fixed number of tokens, best fit over the histogram of lengths.

How many pieces there are of each length decides where pieces go, so the plan is made from at most ``size`` counts: runs
of equal pieces fill runs of equal sequences. Pieces are ranked within their length, and a rank is a slot of the plan.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import Scratch

#: Bytes of text that are cut into words at a time; longer texts are read in sections that end at white space.
SECTION_BYTES = 6_000_000
#: Words whose ids a Python worker keeps, and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 1_000_000, 64
#: Ranks of a length, below which runs are told apart by one number.
_RANKS = 1 << 48

_PIECES = "piece int, start long, length int, ids_crc32 long, chunk int, place long"


#: Signs that end words, and are one piece wherever only they follow a word.
_ENDS = ".,;:!?"
#: Letters below U+0250 whose lower case is one letter; no composition of marks touches them.
_LETTERS = "[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"
_PLAIN = re.compile(f"{_LETTERS}+").fullmatch
#: Byte-level models show each byte as a printable sign: those that are printable as they are, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - _PRINTABLE))}


class WordIds:
    """Ids of texts under a tokenizer that drops white space and never joins what stands on its two sides.

    Texts are cut at ASCII white space, each distinct word of a batch is looked up once, and only unknown words reach
    the tokenizer. Memory: KNOWN_WORDS words of up to KNOWN_CHARS characters, and one batch.
    """

    #: A digit is a token of its own wherever it stands, so it tells apart the words that are encoded together.
    MARK = "0"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)  # for words that are one piece to the model
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        [self.mark] = self.whole.encode(self.MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def _ask(self, tokenizer, words: list[str], texts: list[str]) -> None:
        """Learn ``words``, which the tokenizer is shown as ``texts``, many at a time with marks between them."""
        for i in range(0, len(words), 128):
            ids = tokenizer.encode_batch_fast([f" {self.MARK} ".join(texts[i : i + 128])], add_special_tokens=False)[0].ids
            raw = np.array(ids, "<u4").tobytes()
            cuts = [j for j, x in enumerate(ids) if x == self.mark]
            for word, a, b in zip(words[i : i + 128], [-1, *cuts], [*cuts, len(ids)], strict=True):
                self.known[word] = raw[4 * a + 4 : 4 * b]

    def _learn(self, words: list[str]) -> None:
        plain, signs, others = [], [], []
        for word in words:
            if word.isascii():
                if word.isalpha() and word.islower() or not word.strip(_ENDS):
                    plain.append(word)
                    signs.append(word)
                    continue
            elif word.islower() and _PLAIN(word):
                plain.append(word)
                signs.append(word.encode().decode("latin-1").translate(_BYTE_SIGNS))
                continue
            if self.MARK in word or len(word) > 1000:
                self.known[word] = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                others.append(word)
        self._ask(self.plain, plain, signs)
        self._ask(self.whole, others, others)

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
        self._learn([words[i] for i in new])
        for i in new:
            found[i] = self.known[words[i]] if len(words[i]) <= KNOWN_CHARS else self.known.pop(words[i])
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian numbers of four bytes."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        # a word of letters is looked up in lower case and without the signs that end it, and these for themselves
        body = pc.ascii_rtrim(words.dictionary, characters=_ENDS)
        plain = pc.match_substring_regex(body, f"^{_LETTERS}+$")
        body = pc.if_else(plain, pc.utf8_lower(body), words.dictionary)
        tail = pc.if_else(plain, pc.replace_substring_regex(words.dictionary, f"^{_LETTERS}+", ""), "")
        parts = pa.concat_arrays([body, tail]).dictionary_encode()
        ids = pa.array(self.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        n = len(body)
        each = pc.binary_join_element_wise(ids.take(parts.indices.slice(0, n)), ids.take(parts.indices.slice(n)), pa.scalar(b"", pa.binary()))
        all_ids = each.take(words.indices)
        ends = np.frombuffer(all_ids.buffers()[1], np.int32)[: len(all_ids) + 1]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends[split.offsets.to_numpy() - split.offsets[0].as_py()]), all_ids.buffers()[2]])


def _sections(text: str) -> Iterator[str]:
    """Parts of a text that end at ASCII white space and have about SECTION_BYTES."""
    at = 0
    while len(text) - at > SECTION_BYTES:
        cut = max(text.rfind(x, at, at + SECTION_BYTES) for x in " \n\t\r\v\f")
        if cut <= at:
            cuts = [i for x in " \n\t\r\v\f" if (i := text.find(x, at + SECTION_BYTES)) >= 0]
            cut = min(cuts, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _texts_ids(words: WordIds, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text, as little-endian numbers of four bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        if sizes[at] > SECTION_BYTES:
            yield b"".join(words.encode(pa.array([x]))[0].as_py() for x in _sections(texts[at].as_py()))
            at += 1
            continue
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SECTION_BYTES, "right")))
        for ids in words.encode(pc.fill_null(texts.slice(at, to - at), "")):
            yield ids.as_py()
        at = to


_TOKENIZERS: dict[str, WordIds] = {}


def _cutter(vocabulary: Callable[[], str], size: int):
    """Cut documents into pieces; ``place`` numbers the pieces of a length within a task, ``chunk`` is the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        path = vocabulary()
        words = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordIds(path))
        seen = [0] * (size + 1)
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            owners, rows = [], []
            for i, ids in enumerate(_texts_ids(words, batch.column(1))):
                ids += bytes(4)
                for start in range(0, len(ids) // 4, size):
                    part = ids[4 * start : 4 * (start + size)]
                    n = len(part) // 4
                    owners.append(i)
                    rows.append((start // size, start, n, zlib.crc32(part), chunk, seen[n]))
                    seen[n] += 1
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "place"],
            )

    return cut


def plan_runs(counts: dict[int, int], size: int) -> np.ndarray:
    """Best fit, longest first: rows (length, first rank, first sequence, pieces a sequence, offset), in order of length and rank.

    Pieces of a run fill one sequence after the other, with so many pieces in each. Sequences that are filled alike are
    dealt with together, so the work and the number of runs depend on ``size`` and not on how many pieces there are.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, how many)
    free: list[int] = []  # keys of rooms, sorted
    runs, made = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                bisect.insort(free, room)
            rooms.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
            else:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, size - room))
                add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # the last of them, in one sequence
                runs.append((length, rank, first + full, each, size - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            add(room, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _placer(runs: np.ndarray):
    """Give each piece the slot of its rank."""
    keys = runs[:, 0] * _RANKS + runs[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            i = rank - run[:, 1]
            cols = [*(batch.column(k) for k in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(run[:, 2] + i // run[:, 3]), pa.array(run[:, 4] + i % run[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return put


def pack(docs: DataFrame, vocabulary: Callable[[], str], size: int = 2048) -> DataFrame:
    """Every document as token pieces, each with its place in a sequence of at most ``size`` tokens.

    ``vocabulary`` gives the tokenizer's file where it is called, in the tasks. A document is its ids and id 0 after them;
    only longer ones are cut. A null or empty text is id 0 alone; rows that repeat and rows of null doc_id are documents
    of their own; further columns aren't read; an empty table gives no pieces. To the driver go at most ``size`` counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(_cutter(vocabulary, size), f"{doc_id}, {_PIECES}"), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # of at most `size` lengths
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "chunk", before.alias("before"))
    ranked = pieces.join(starts, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("place"))
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.select(*columns).mapInArrow(_placer(plan_runs(totals, size)), f"{doc_id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
