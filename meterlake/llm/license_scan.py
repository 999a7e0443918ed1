"""License scans by diagonal voting, in DataFrame operations only.

All rolling 3-word runs of the documents meet the runs of the templates, whole licence texts and short phrases, in a join
on their hashes. A run at word p that stands at place t of a template votes for the diagonal p - t: where the template
would begin. Votes are summed by document, template and diagonal. Diagonals that lie close together form a band; those of
a band that follow each other closely are merged to a span, so words put in or left out inside a license text don't split
it; and a span counts if its distinct votes cover enough of the template. The join verifies hashes word by word, so a
fully covered diagonal is the template itself.

Votes are kept as bits of the template's places, 64 to a word, so templates may have any length. Documents are read once:
each also sends a row of its own through the join, which brings its words and its count of equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm.common import PLAIN_WORD, lower_ascii
from meterlake.llm.license_texts import TEXTS

RUN = 3
#: Phrases whose places are counted.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Share of a template's runs that a span must cover; short templates must be there whole.
COVER, SHORT = 0.6, 8
#: Words that may be put in or left out between two diagonals of a band, and from one's last vote to the next one's first.
DRIFT, REACH = 4, 12
#: Template runs that are broadcast at most, some 100 bytes each; more are joined as Spark sees fit.
MAX_BROADCAST_RUNS = 200_000
_PLACES = 64


def template_words(text: str) -> list[str]:
    """The words of a template, read like those of documents."""
    return re.findall(PLAIN_WORD, "".join(c.lower() if c.isascii() else c for c in text))


def _templates(spark: SparkSession, base: tuple, more: tuple) -> DataFrame:
    rows = []
    for i, (text, label) in enumerate((*base, *more)):
        words = template_words(text)
        runs = len(words) - RUN + 1
        rows += [(i, label, i < len(base), runs, j, " ".join(words[j : j + RUN])) for j in range(runs)]
    made = spark.createDataFrame(rows, "template int, label string, base boolean, runs int, place int, template_run string")
    made = made.withColumn("template_hash", F.xxhash64("template_run"))
    return F.broadcast(made) if len(rows) <= MAX_BROADCAST_RUNS else made


def _runs(words: Column) -> Column:
    """Every run of words, joined by blanks, and a null after them."""
    last = F.size(words) - RUN
    run = lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(RUN)))
    own = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(F.array().cast("array<string>"))
    return F.array_append(own, F.lit(None).cast("string"))


def scan_licenses(docs: DataFrame, base: tuple = BASE, templates: tuple = TEXTS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs`` (doc_id, text).

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start, or null.
    Labels are distinct, sorted and joined by commas, '' if there are none. The score is the largest share of a template
    that a document covers, 0 without a common run. Null and empty texts have no words. Repeated rows get equal results,
    null doc_ids as well. Other columns are not read; an empty table gives no rows. Templates of fewer words than a run
    are never met.
    """
    row = ["doc_id", "text_a", "text_b"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text).alias("text_a"), F.xxhash64(F.lit(2), text).alias("text_b"), words.alias("words"))
    slim = slim.select(*row, F.size("words").alias("n_words"), F.posexplode(_runs(F.col("words"))).alias("at", "run"))
    known = _templates(docs.sparkSession, base, templates)
    met = slim.withColumn("run_hash", F.xxhash64("run")).join(known, (F.col("run_hash") == F.col("template_hash")) & (F.col("run") == F.col("template_run")), "left")
    met = met.where("template IS NOT NULL OR run IS NULL")

    own = [*row, "template"]
    of = ["label", "base", "runs"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % _PLACES)
    votes = met.withColumns({"diagonal": F.col("at") - F.col("place"), "part": F.floor(F.col("place") / _PLACES).cast("int")}).groupBy(*own, *of, "diagonal", "part")
    votes = votes.agg(
        F.bit_or(bit).alias("bits"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("n_words").alias("n_words"), F.count_if(F.col("run").isNull()).alias("times")
    )
    diagonals = votes.groupBy(*own, *of, "diagonal").agg(
        F.sum(F.bit_count("bits")).alias("found"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_list(F.struct("part", "bits")).alias("parts"), F.max("n_words").alias("n_words"), F.sum("times").alias("times"),
    )
    sideways = Window.partitionBy(*own).orderBy("diagonal")
    band = F.sum(F.coalesce((F.col("diagonal") - F.lag("diagonal").over(sideways) > DRIFT).cast("int"), F.lit(0))).over(sideways)
    along = Window.partitionBy(*own, "band").orderBy("first", "diagonal")
    new = F.col("first") > F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) + REACH
    spans = diagonals.withColumn("band", band).withColumn("new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("span", F.sum("new").over(along))
    at = F.when((F.col("found") == F.col("runs")) & F.col("base"), F.col("diagonal"))
    spans = spans.withColumns({"at": at, "whole": F.col("found") == F.col("runs")}).select(*own, *of, "band", "span", "at", "whole", "n_words", "times", F.explode_outer("parts").alias("piece"))
    # a diagonal comes once for each of its parts; its first part speaks for it
    spans = spans.groupBy(*own, *of, "band", "span", F.col("piece.part").alias("part")).agg(
        F.bit_or("piece.bits").alias("bits"), F.collect_set("at").alias("starts"), F.max("whole").alias("whole"), F.max("n_words").alias("n_words"), F.max("times").alias("times")
    )
    spans = spans.groupBy(*own, *of, "band", "span").agg(
        F.sum(F.bit_count("bits")).alias("found"), F.max_by("starts", F.size("starts")).alias("starts"), F.max("whole").alias("whole"),
        F.max("n_words").alias("n_words"), F.max("times").alias("times"),
    )
    cover = F.coalesce(F.col("found") / F.col("runs"), F.lit(0.0))
    counts = F.when((F.col("runs") <= SHORT) | F.col("base"), F.col("whole")).otherwise(cover >= COVER)
    joined = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    found = spans.groupBy(*row).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.size("starts")).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).cast("long").alias("first_word"),
        F.max(F.array_max("starts")).cast("long").alias("last_word"),
        joined(F.size("starts") > 0).alias("base_labels"),
        joined(counts).alias("labels"),
        F.max(F.when((F.col("runs") > SHORT) | F.col("whole"), cover).otherwise(cover / 2)).alias("score"),
        F.max("times").alias("times"),
    )
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("col")
