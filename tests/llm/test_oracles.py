"""Queries of the subpackage that SQL can express equal DuckDB's rows on the same tables."""

from __future__ import annotations

import pytest

from quirelake.llm import registry
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    mine, theirs, rows, expected = compare(spark, "/root/testdata/sf0.001", registry.queries()[name], registry.oracle_sql()[name])
    assert mine == theirs
    assert rows == expected
