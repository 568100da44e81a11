"""Plan checks: native operators stay JVM-side, never cross-join, and prune columns."""

import pytest

import __spark_entry__ as entry
from commitlens.plans.queries import REGISTRY

SF = "/root/testdata/sf0.01"
PYTHON_BACKED = {"udf_score", "classify_scorer", "score_fallback"}  # mapInPandas by design (M1, M3)
SIDE_EFFECTS = {"csv_roundtrip", "line_counts", "ext_counts", "stream_ingest_dedup", "stream_score_resume",
                "stream_counts"}
NATIVE = sorted(set(REGISTRY) - PYTHON_BACKED - SIDE_EFFECTS)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plan_has_no_python_and_no_cross_join(spark, name):
    p = plan_text(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "MapInPandas", "PythonUDF"):
        assert bad not in p, f"{name}: {bad}"


@pytest.mark.parametrize("name", sorted(PYTHON_BACKED))
def test_python_scoring_is_arrow_batched(spark, name):
    p = plan_text(entry.queries()[name](spark, SF))
    assert "MapInPandas" in p and "BatchEvalPython" not in p


def test_heuristic_filter_prunes_scan_columns(spark):
    p = plan_text(entry.queries()["heuristic_filter"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in p
    assert "o_totalprice" not in p and "l_extendedprice" not in p


def test_asof_is_equi_join_plus_window(spark):
    p = plan_text(entry.queries()["asof_release"](spark, SF))
    assert "Window" in p and "RangeJoin" not in p and "NestedLoop" not in p


def test_scoring_stays_above_the_dedup(spark):
    """The lexicon regex must run on unique messages, not inside the scans."""
    p = plan_text(entry.queries()["propagate_message"](spark, SF))
    lines = p.split("\n")
    hits = [i for i, line in enumerate(lines) if "application not responding" in line]
    dedup = [i for i, line in enumerate(lines) if "partial_min_by" in line]
    assert hits and dedup and max(hits) < min(dedup)  # above the aggregate that makes the messages unique
    hits = [lines[i] for i in hits]
    assert not any("o_orderkey" in line or "FileScan" in line for line in hits)


def test_python_scorer_runs_without_the_package_on_workers(spark, tmp_path):
    """Workers started outside the repo cannot import the package; the scorer is
    shipped by value, so the query still runs (driver cwd independent)."""
    import os
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled','false').getOrCreate()\n"
            "import __spark_entry__ as e\n"
            "print('ROWS', e.queries()['udf_score'](s, %r).count())\n") % (
        os.path.dirname(os.path.dirname(os.path.abspath(__file__))), SF)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "ROWS 598" in out.stdout, out.stderr[-2000:]


def test_classification_stays_above_the_dedup(spark):
    p = plan_text(entry.queries()["classify_commits"](spark, SF))
    hits = [line for line in p.split("\n") if "gradle" in line]  # a class-lexicon term
    assert hits and not any("FileScan" in line or "o_orderkey" in line for line in hits)


def test_file_inventory_never_reads_file_contents(spark):
    p = plan_text(entry.queries()["file_inventory"](spark, SF))
    scan = [line for line in p.split("\n") if "FileScan binaryFile" in line]
    assert scan and all("content" not in line.split("ReadSchema:")[-1] for line in scan)
