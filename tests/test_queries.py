"""Registered queries against their oracles, and streams against batches."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from meterlake.plans import oracles, price_oracles, queries, scan_queries, source_queries, stream_queries, upkeep_queries, vendor_queries

SF = "/root/testdata/sf0.001"
QUERIES = queries.QUERIES | source_queries.QUERIES | vendor_queries.QUERIES | stream_queries.QUERIES | scan_queries.QUERIES | upkeep_queries.QUERIES
ORACLES = oracles.ORACLES | price_oracles.ORACLES | source_queries.ORACLES | vendor_queries.ORACLES | stream_queries.ORACLES | scan_queries.ORACLES | upkeep_queries.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else v
    order = [names.index(c) for c in sorted(names)]
    expected = sorted(repr([plain(r[i]) for i in order]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_an_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("gone", [("meterlake/llm",), ("meterlake/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone):
    root = Path(__spark_entry__.__file__).parent
    left = shutil.ignore_patterns("__pycache__", ".git", *(Path(x).name for x in gone))
    shutil.copytree(root, tmp_path / "copy", ignore=left)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-2:] == [str(len(QUERIES)), "0"]


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
