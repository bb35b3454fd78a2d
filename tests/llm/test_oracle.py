"""Queries of this subpackage against their SQL, and the contract of the registry."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle

from quillon.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name], registry.SQL[name], spark, "/root/testdata/sf0.001") == ""


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 14))
