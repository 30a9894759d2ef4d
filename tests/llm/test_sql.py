"""Queries that SQL can express, against it."""

import pytest

from posmv.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    oracle.check(oracle.connect(sf), queries.ORACLE_SQL[name], queries.QUERIES[name](spark, sf))
