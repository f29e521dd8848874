"""The registered queries of the subpackage that SQL can express, against it; and what no other module may do."""

import ast
import os
import pathlib

import pytest

from docjobs.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, same


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(__file__).parents[2]
    for f in (root / "docjobs").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), f
