"""Every named query against its checking SQL on whole tables."""

from __future__ import annotations

import os

import pytest

from oracle import differences, engine
from suitegauge.plans.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data tables")


@pytest.fixture(scope="module")
def checker():
    return engine(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, checker, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert differences(found, checker.execute(ORACLES[name]).df()) is None


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_boards_come_out_in_order(spark):
    rows = QUERIES["leaderboard_overall"](spark, FOLDER).collect()
    assert rows == sorted(rows, key=lambda r: (-r.score, -r.mutation_pct, r.id))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == [
        "id", "Track", "Score", "Mutation %", "Fault Detection %", "Pass Rate", "# Tasks"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
