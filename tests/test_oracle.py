"""Every registered query equals its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from commitlens.plans.queries import REGISTRY
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert res["ok"], res


def test_every_query_has_an_oracle():
    assert not set(REGISTRY) - set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["git_link", "commit_link", "commit_release_time", "apk_release_time", "apk_version",
                          "apk_download_link", "source_code_download_link", "source"]
    assert df.count() > 0
