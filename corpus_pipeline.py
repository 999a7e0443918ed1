"""The corpus pipeline: documents to a clean, deduplicated and mixed training set.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the
next one reads it. Stages keep every column of documents, whatever further columns are called; the last adds mix_times,
how often the mix takes a row. Empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import decontamination, mixing, near_dedup, substring_dedup, toxicity
from meterlake.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay, repeated rows share their fate."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id; null and empty texts are near to nothing."""
    return near_dedup.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that began earlier; texts without such words stay as they are, nulls as well."""
    return substring_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with mix_times; texts without words are never taken, a null source is a source."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The toxicity model is trained, which SQL can't express; tests/llm compares the other stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            scratch.keep_only(name)
    return docs
