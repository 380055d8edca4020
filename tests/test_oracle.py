"""Every registered query against its plain SQL, on the smallest data folder."""

import re

import pytest

import __spark_entry__ as entry
from cohortspark.plans.oracles import oracle_sql
from cohortspark.plans.queries import QUERIES
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    result = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert "problem" not in result, result
    assert "types" not in result, result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["person_frame", "confusion_matrix", "matched_ages", "code_totals"])
def test_plans_have_no_pairing_joins(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
