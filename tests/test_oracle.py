"""Every registered query against its DuckDB twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__  # noqa: E402
from gristmill.plans.registry import REGISTRY  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    ok, _, message = check.compare(spark, duck, REGISTRY[name], FOLDER)
    assert ok or message == "rows-only 0", message


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
