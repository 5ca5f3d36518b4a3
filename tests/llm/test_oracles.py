"""Queries that SQL can express against DuckDB, on the smallest fixture."""

import pytest

from quillscope.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF001
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    ok, msg = compare(spark, duck(SF001), SF001, name, QUERIES[name], ORACLE_SQL[name])
    assert ok, msg
