"""Queries that SQL can express, against DuckDB on whole tables."""

import pytest

import oracle
from chronoreel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    d = sf_dir.replace("0.001", "0.01")
    assert oracle.compare(oracle.connect(d), queries.queries()[name](spark, d), queries.oracle_sql()[name]) == ""
