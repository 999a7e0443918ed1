"""What the corpus operators share: word patterns, reading tables, and scratch tables."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    ascii_only = F.octet_length(text) == F.length(text)  # lower() is several times faster, but knows other letters
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only where a local session sets none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return named.rstrip("/")


#: Keys that spread_join splits at most, and rows of a key below which it never does.
MAX_HOT_KEYS, HOT_ROWS = 10_000, 200_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose rows are unique by ``keys`` and say in ``count`` how many of left's rows they meet.

    Keys of many rows are split by the hash ``by`` into parts that go to different tasks. A key is split that holds more
    than HOT_ROWS rows and more than one in MAX_HOT_KEYS of all, so the keys that are broadcast have that bound. Rows of
    null keys meet nothing and are spread as well.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_ROWS, total // MAX_HOT_KEYS)
    parts = F.ceil(F.col(count) / limit).cast("long")
    hot = right.where(F.col(count) > limit).select(*keys, parts.alias("_parts"))
    none = F.when(F.concat_ws("", *(F.when(F.col(k).isNull(), "x") for k in keys)) != "", F.lit(1024))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(by, F.coalesce(none, "_parts", F.lit(1)))).drop("_parts")
    return dealt.join(right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), [*keys, "_part"], how).drop("_part")


class Scratch:
    """Written tables that cut lineage. They live in the shared checkpoint folder, so any executor can read or remake them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, with the sizes that Spark needs to choose joins."""
        path = self.paths[name] = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # the shuffle files of a written table are of no more use
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """Write ``df``, which is dealt by ``keys`` to so many partitions, in such buckets and read it back; joins on these keys needn't deal it again."""
        path = self.paths[name] = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        known = f"scratch_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *keys).option("path", path).saveAsTable(known)
        out = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")  # only its entry in the catalog: the files are this folder's
        return out

    def keep_only(self, *names: str) -> None:
        """Remove all tables but those that a result still reads."""
        for name in set(self.paths) - set(names):
            self.drop(name)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
