"""Every core query against its SQL, and the contract of the entry point."""

import ast
import os

import pytest

import __spark_entry__ as entry
from docjobs.jobs import queries as registry
from docjobs.jobs.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_merging_shuffles_pages_once(spark):
    plan = QUERIES["d6_merge_results"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_no_helper_takes_anothers_name():
    """Queries call their helpers by name when they run, so a later helper of the same name would break earlier queries."""
    with open(registry.__file__) as f:
        names = [n.name for n in ast.parse(f.read()).body if isinstance(n, ast.FunctionDef)]
    assert sorted(names) == sorted(set(names))
