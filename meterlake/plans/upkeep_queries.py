"""Queries of what is written, deleted and kept: the rollup table, the CSV file, key deletion, and votes that are taken again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.operators import ledger as L
from meterlake.operators import pricing as P
from meterlake.plans.fixtures import DUCK_LEDGER, OFFSET, ledger, quotes
from meterlake.plans.oracles import _ROLL, DAY
from meterlake.plans.price_oracles import ORACLES as PRICE_ORACLES
from meterlake.plans.queries import rounded
from meterlake.plans.stream_queries import new_folder


def rollups_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup table after all days were written from half the events, and then every third day from all of them."""
    path = f"{new_folder(spark, 'rollups')}/table"
    rows = ledger(spark, sf_dir)
    L.write_rollups(L.rollups(rows.where("event_id % 2 = 0"), OFFSET), path)
    L.write_rollups(L.rollups(rows.where(E.day_index(F.col("ts_start"), OFFSET) % 3 == 0), OFFSET), path)
    return rounded(spark.read.parquet(path).withColumn("date", F.col("date").cast("string")))


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the exported file: its header, and cells that are guarded and quoted just once."""
    path = f"{new_folder(spark, 'export')}/ledger"
    rows = ledger(spark, sf_dir).withColumns({"raw_ref": F.concat(F.lit('=a,"b"'), "dedup_key"), "project": F.lit("p"), "cost_usd": F.lit(None).cast("double"), "cost_source": F.lit(None).cast("string")})
    L.export_csv(rows, path, OFFSET)
    return spark.read.text(path).select(F.col("value").alias("line"))


def keys_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger without some keys, which may repeat or be unknown, and without an app."""
    rows = ledger(spark, sf_dir)
    gone = rows.where("event_id % 3 = 0").select("dedup_key")
    left = L.delete_keys(rows, gone.unionByName(gone).unionByName(rows.select(F.concat("dedup_key", F.lit("?")).alias("dedup_key"))))
    return L.delete_app(left, "cursor").groupBy("app").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


_CHANGED = "source = 'openrouter' AND model_id IN ('m-7-1', 'm-7.1')"


def revote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book after quotes of one model have changed: only that model has voted again."""
    rows = quotes(spark, sf_dir)
    path = f"{new_folder(spark, 'votes')}/kept"
    P.keep_votes(rows).write.parquet(path)
    changed = rows.withColumn("input", F.when(F.expr(_CHANGED), F.col("input") + 1).otherwise(F.col("input")))
    return rounded(P.revote(changed, spark.read.parquet(path))).drop("n_quotes", "content", "rules")


_CELL = "CASE WHEN {0} IS NULL THEN '' ELSE {0}::VARCHAR END"
_TPS = "CASE WHEN unclassified_tokens <= 0 THEN output_tokens * 1000.0 / (CASE WHEN duration_ms > 0 THEN duration_ms WHEN ts_end - ts_start > 0 AND ts_end - ts_start <= 1800000 THEN ts_end - ts_start END) END"
QUERIES = {"rollups_written": rollups_written, "csv_file": csv_file, "keys_deleted": keys_deleted, "revote": revote}
ORACLES = {
    "rollups_written": f"WITH {DUCK_LEDGER} {_ROLL} AND (event_id % 2 = 0 OR {DAY} % 3 = 0) GROUP BY 1, 2, 3, 4, 5",
    "csv_file": f"""WITH {DUCK_LEDGER} SELECT '{",".join(L.CSV_COLUMNS)}' AS line UNION ALL
 SELECT array_to_string([strftime(make_timestamp((COALESCE(ts_start, 0) + 28800000) * 1000), '%Y-%m-%dT%H:%M:%S') || '+08:00', app, COALESCE(model, ''), '', 'p', session_id, input_tokens::VARCHAR, output_tokens::VARCHAR,
 reasoning_tokens::VARCHAR, cache_read_tokens::VARCHAR, (cache_write_5m_tokens + cache_write_1h_tokens)::VARCHAR, COALESCE(printf('%.4f', credits), ''), '', '', {_CELL.format('duration_ms')},
 '"''=a,""b""' || dedup_key || '"', unclassified_tokens::VARCHAR, COALESCE(printf('%.3f', {_TPS}), '')], ',') FROM ledger""",
    "keys_deleted": f"WITH {DUCK_LEDGER} SELECT app, COUNT(*) AS events, SUM(event_id)::BIGINT AS ids FROM ledger WHERE event_id % 3 <> 0 AND app <> 'cursor' GROUP BY 1",
    "revote": PRICE_ORACLES["price_consensus"].replace("FROM quotes JOIN t", f"FROM (SELECT * REPLACE (CASE WHEN {_CHANGED} THEN input + 1 ELSE input END AS input) FROM quotes) quotes JOIN t").replace(
        "SELECT canon, display, COALESCE(p.source", "SELECT canon = 'm-7-1' AS voted, canon, display, COALESCE(p.source"
    ),
}
