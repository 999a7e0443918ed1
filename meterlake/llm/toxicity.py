"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear model over words. With prior p, the risk of a model is
p * loss of the positives as toxic + max(0, loss of the unlabelled as clean - p * loss of the positives as clean); where
the second part turns negative, which only overfitting does, the step goes back up it. Training happens once, in numpy,
on samples of bounded size; scoring is one pass over all documents without a shuffle.

A document's features are its distinct words, and for each beginning of 4 to 7 bytes that one, two, three or four and
more of its distinct words share, so that unseen forms of a known stem count as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import tokens
from meterlake.llm.common import Scratch

#: Most confirmed toxic, unlabelled and labelled clean documents that the model is fitted on, taken by the hash of their id.
MAX_POSITIVES, MAX_UNLABELLED, MAX_CLEAN = 3_000, 9_000, 3_000
#: Features that the model weighs at most, those most over-represented among the positives.
MAX_FEATURES = 512
THRESHOLD = 0.7
_EPOCHS, _RATE, _DECAY = 300, 0.1, 1e-4
_PREFIXES, _LEVELS = (4, 5, 6, 7), (1, 2, 3, 4)
_MARK_BITS = 20
#: A feature's low bits are its level, 0 for a word; the rest is a hash.
_HASH = np.uint64(2**64 - 8)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MARK_BITS)).astype(np.int64)


def features(chunk: tokens.Words, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of some texts, each once; with ``mark``, at least those whose hash falls on a marked place."""
    words, owners, lens = chunk.hashes(lower=True), chunk.owners(), chunk.ends - chunk.starts
    at = np.arange(len(words)) if mark is None else np.flatnonzero(mark[_place(words)])
    order = np.lexsort((words[at], owners[at]))
    texts, found = [owners[at][order]], [words[at][order] & _HASH]
    for k in _PREFIXES:
        short = tokens.Words(chunk.data, chunk.starts, np.minimum(chunk.ends, chunk.starts + k), chunk.bounds, chunk.first)
        stems = short.hashes(lower=True, seed=10 + k) & _HASH
        at = np.flatnonzero(lens > k if mark is None else (lens > k) & mark[_place(stems)])
        if not len(at):
            continue
        at = at[np.lexsort((words[at], stems[at], owners[at]))]
        owner, stem, word = owners[at], stems[at], words[at]
        new_stem = np.append(True, (owner[1:] != owner[:-1]) | (stem[1:] != stem[:-1]))
        new_word = new_stem | np.append(True, word[1:] != word[:-1])
        first = np.flatnonzero(new_stem)
        forms = np.add.reduceat(new_word.astype(np.int64), first)
        for level in _LEVELS:
            texts.append(owner[first][forms >= level])
            found.append(stem[first][forms >= level] | np.uint64(level))
    owner, feature = np.concatenate(texts), np.concatenate(found).view(np.int64)
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1]))[: len(owner)]
    return owner[new], feature[new]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for chunk in tokens.words(batch.column("text"), tokens.PLAIN):
            owner, feature = features(chunk)
            sets += np.split(feature, np.searchsorted(owner, np.arange(1, len(chunk.bounds) - 1)))
        yield pa.record_batch([*(batch.column(c) for c in ("kind", "doc_id", "nth")), pa.array(sets, pa.list_(pa.int64()))], names=["kind", "doc_id", "nth", "words"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    words: np.ndarray  #: sorted features
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(sets), self.bias)
        for i, own in enumerate(sets):
            if len(self.words) and len(own):
                at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
                out[i] += self.weights[at[self.words[at] == own]].sum()
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * raw + self.shift)


def fit(words: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The model of least non-negative risk over the sorted features ``words``, by full-batch Adam."""
    if not positives:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    sets = [*positives, *unlabelled]
    rows, cols = [], []
    for i, own in enumerate(sets):
        at = np.searchsorted(words, own)
        at = at[(at < len(words)) & (words[np.minimum(at, max(len(words) - 1, 0))] == own)] if len(words) else at[:0]
        rows.append(np.full(len(at), i))
        cols.append(at)
    rows, cols, n = np.concatenate(rows), np.concatenate(cols), len(positives)
    theta, bias = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, _EPOCHS + 1):
        g = bias + np.bincount(rows, theta[cols], len(sets))
        s = _sigmoid(g)
        as_clean = np.logaddexp(0, g)
        slope = np.zeros(len(sets))
        negative = as_clean[n:].mean() - prior * as_clean[:n].mean() if len(unlabelled) else 0.0
        slope[:n] -= prior * (1 - s[:n]) / n
        if negative >= 0:
            slope[n:] += s[n:] / max(1, len(unlabelled))
            slope[:n] -= prior * s[:n] / n
        else:
            slope[:n] = prior * s[:n] / n
            slope[n:] = -s[n:] / max(1, len(unlabelled))
        grad = np.append(np.bincount(cols, slope[rows], len(words)) + _DECAY * theta, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model(words, theta, float(bias))


def _calibrated(model: Model, positives: np.ndarray, clean: np.ndarray, prior: float) -> Model:
    """``model`` with scores that read as probabilities for labelled rows in their natural proportion."""
    if not len(positives) or not len(clean):
        return model
    x = np.concatenate([positives, clean])
    center, spread = x.mean(), x.std() + 1e-9
    x = (x - center) / spread
    # each side's target leaves room for one more error, so separable samples stay finite
    y = np.concatenate([np.full(len(positives), (len(positives) + 1) / (len(positives) + 2)), np.full(len(clean), 1 / (len(clean) + 2))])
    w = np.concatenate([np.full(len(positives), prior / len(positives)), np.full(len(clean), (1 - prior) / len(clean))])
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method
        s = _sigmoid(a * x + b)
        r, h = w * (s - y), w * s * (1 - s) + 1e-12
        grad = np.array([(r * x).sum() + 1e-6 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - step[0], b - step[1]
    if a <= 0:
        return model
    return Model(model.words, model.weights, model.bias, a / spread, b - a * center / spread)


def _chosen(found: DataFrame) -> list[int]:
    """The MAX_FEATURES features whose share of the positives exceeds their share of the unlabelled most surely, sorted."""
    sizes = dict(found.where("kind < 2").groupBy("kind").count().collect())
    n_p, n_u = sizes.get(0, 0), max(1, sizes.get(1, 0))
    counts = found.where("kind < 2").select("kind", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count_if(F.col("kind") == 0).alias("in_p"), F.count_if(F.col("kind") == 1).alias("in_u")).where("in_p > 1")
    both = (F.col("in_p") + F.col("in_u")) / (n_p + n_u)
    sure = (F.col("in_p") / n_p - F.col("in_u") / n_u) / F.sqrt(both * (1 - both) * (1 / max(1, n_p) + 1 / n_u) + 1e-12)
    best = counts.select("word", sure.alias("sure")).where("sure >= 3").orderBy(F.desc("sure"), "word").limit(MAX_FEATURES)
    return sorted(r["word"] for r in best.collect())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows that are not held out; a document is toxic if any of its labels says so."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic:
        return fit(np.zeros(0, np.int64), [], [], 0.5)
    prior = min(max(toxic / n, 1e-3), 0.9)
    by_hash = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 1).distinct()
    taken = [
        known.where("toxic = 1").select("doc_id", F.lit(0).alias("kind")).orderBy(by_hash).limit(MAX_POSITIVES),
        ids.select("doc_id", F.lit(1).alias("kind")).orderBy(by_hash).limit(MAX_UNLABELLED),
        known.where("toxic = 0").select("doc_id", F.lit(2).alias("kind")).orderBy(by_hash).limit(MAX_CLEAN),
    ]
    # at most the sum of the three bounds above: small enough to broadcast whatever the corpus
    sample = taken[0].unionByName(taken[1]).unionByName(taken[2]).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("kind", "doc_id", "text")
    # equal rows are one example; of ids with several texts, all first texts come before any second one
    most = (MAX_POSITIVES, MAX_UNLABELLED, MAX_CLEAN)
    texts = texts.withColumn("key", F.xxhash64("text")).dropDuplicates(["kind", "doc_id", "key"])
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "doc_id").orderBy("key"))).where(F.col("nth") <= max(most))
    scratch = Scratch(docs.sparkSession, "toxicity")
    found = scratch.save(texts.select("kind", "doc_id", "nth", "text").mapInArrow(_distinct, "kind int, doc_id long, nth int, words array<long>"), "features")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("nth", by_hash))).where(F.col("place") <= max(most))
    found = found.where(F.col("place") <= F.element_at(F.array(*map(F.lit, most)), F.col("kind") + 1))
    found = scratch.save(found.select("kind", "doc_id", "words"), "sample")
    words = _chosen(found)
    listed = F.array(*map(F.lit, words)).cast("array<bigint>")
    got = found.select("kind", "doc_id", F.array_intersect("words", listed).alias("words")).toPandas().sort_values(["kind", "doc_id"])
    sets = {k: [np.sort(np.asarray(w, np.int64)) for w in got.loc[got["kind"] == k, "words"]] for k in (0, 1, 2)}
    model = fit(np.array(words, np.int64), sets[0], sets[1], prior)
    return _calibrated(model, model.raw(sets[0]), model.raw(sets[2]), prior)


class _Scorer:
    """Scores of a column of texts by one model."""

    def __init__(self, model: Model):
        self.model = model
        self.mark = np.zeros(1 << _MARK_BITS, bool)
        self.mark[_place(model.words.view(np.uint64))] = True

    def __call__(self, column: pa.Array) -> np.ndarray:
        model, raw = self.model, np.full(len(column), self.model.bias)
        for chunk in tokens.words(column, tokens.PLAIN):
            owner, feature = features(chunk, self.mark)
            if len(model.words) and len(owner):
                at = np.minimum(np.searchsorted(model.words, feature), len(model.words) - 1)
                hit = model.words[at] == feature
                raw[chunk.first : chunk.first + len(chunk.bounds) - 1] += np.bincount(owner[hit], model.weights[at[hit]], len(chunk.bounds) - 1)
        return model.score(raw)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    A null or empty text scores like one without any of the model's words. Without confirmed toxic rows all scores are
    near 0. A null doc_id is neither learned from nor held out. Repeated rows score alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            scores = scorer(batch.column("text"))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold(F.col("doc_id").cast("long")) == 1, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return slim.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
