"""Queries that SQL can express equal their DuckDB form; every numbered operator is registered once."""

import re

import pytest

import __spark_entry__ as entry
from commitlens.llm.oracle import SQL
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert res["ok"], res


def test_one_query_per_operator():
    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_workers_need_no_installed_package(tmp_path):
    """A plain session started in another folder: functions travel with the tasks."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', *[e.queries()[n](s, '/root/testdata/sf0.001').count() for n in ('op4_ngram_jaccard', 'op5_suffix_dedup', 'op8_language_id', 'op11_embedding_dedup', 'op13_importance_resampling', 'op12_ranked_search')])\n") % root
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 200 200 200 500 200" in out.stdout, out.stderr[-2000:]
