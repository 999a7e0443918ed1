"""Language identification by rank-order profiles.

A profile is the ranking of the most frequent character 1- to 3-grams, words being padded with a blank. A document gets
the language whose profile is at the least out-of-place distance: the sum, over the document's own ranking, of how far
each n-gram stands from its place in the profile. An n-gram is a number that spells its code points, so none share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of a profile and of a document.
TOP = 400
#: Labelled documents for each language, about, that profiles are learned from.
MAX_DOCS = 2_000
#: Languages beyond which labels can't be languages: there are some 8,000 on earth. Bounds what is collected and broadcast.
MOST_LANGS = 10_000
UNDETERMINED = "und"
#: Bits of a code point; what pads words is the control character of number 1.
_BITS, _BLANK = np.uint64(21), np.uint64(1)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows of remainder 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def grams(text: str | None) -> np.ndarray | None:
    """The n-grams of a text, as often as they stand in it; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    line = np.full(len(codes) + 2, _BLANK)
    line[1:-1] = np.where(letter, codes, _BLANK)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != _BLANK) | (line[:-1] != _BLANK)
    line = line[keep]
    two = (line[:-1] << _BITS) | line[1:]
    three = (two[:-1] << _BITS) | line[2:]
    return np.concatenate([line[line != _BLANK], two, three[line[1:-1] != _BLANK]]).view(np.int64)


def ranking(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent of distinct n-grams, which come in rising order; ties by number."""
    return found[np.argsort(-counts, kind="stable")[:TOP]]


def learn_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """The ranking of each language's n-grams over a sample of its labelled rows that are not held out.

    Rows are drawn by id and text, and each language's row of smallest hash is, so that none is lost however its rows
    repeat. TOP numbers a language reach the driver; more than MOST_LANGS languages are refused.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = known.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 2)
    known = known.withColumn("draw", F.xxhash64("doc_id", "text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("count"), F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("draw"))).alias("least"))
    if sizes.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rate = F.greatest(F.ceil(F.col("count") / MAX_DOCS), F.lit(1))
    sample = known.join(F.broadcast(sizes), "lang").where((F.pmod("draw", rate) == 0) | (F.col("draw") == F.col("least"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (every := grams(text)) is not None:
                    found, counts = np.unique(every, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], names=["lang", "gram", "n"])

    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("place", place).where(F.col("place") <= TOP).select("lang", "place", "gram").toPandas().sort_values(["lang", "place"])
    return {lang: part["gram"].to_numpy() for lang, part in top.groupby("lang")}


class _Judge:
    """The profiles as one list of n-grams in order, each with its language and its place there."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = list(profiles)
        known = np.concatenate([*profiles.values(), np.zeros(0, np.int64)])
        order = np.argsort(known, kind="stable")
        self.grams = known[order]
        self.langs = np.repeat(np.arange(len(profiles)), [len(x) for x in profiles.values()])[order]
        self.places = np.concatenate([*(np.arange(len(x)) for x in profiles.values()), np.zeros(0, np.int64)])[order]

    def __call__(self, text: str | None) -> tuple[str, float]:
        every = grams(text)
        if every is None or not self.names:
            return UNDETERMINED, 0.0
        own = ranking(*np.unique(every, return_counts=True))
        begin, end = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        met = end - begin
        at = np.arange(int(met.sum())) + np.repeat(begin - (np.cumsum(met) - met), met)
        nearer = TOP - np.abs(self.places[at] - np.repeat(np.arange(len(own)), met))
        far = TOP * len(own) - np.bincount(self.langs[at], nearer, len(self.names))
        best = int(far.argmin())
        if len(self.names) == 1:
            return self.names[0], 1.0
        second = np.partition(far, 1)[1]
        return self.names[best], float(second / (second + far[best])) if second else 0.5


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text).

    Null texts, texts without letters, and all texts where no language was learned, give 'und' and score 0. The score is
    the second distance's share of the two smallest (1 with a single profile): 0.5 is a tie, which the first language by
    name wins. A null doc_id is neither learned from nor held out. Repeated rows agree; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_Judge(profiles))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(fold(F.col("doc_id").cast("long")) == 2, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return slim.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")
