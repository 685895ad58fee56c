"""Every registered query of the archive's jobs against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare

SF = "/root/testdata/sf0.001"
ALL, SQL = {}, {}
for module in entry.MODULES:
    ALL |= module.queries()
    SQL |= module.oracle_sql()


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    mine, theirs, rows, expected = compare(spark, SF, ALL[name], SQL[name])
    assert mine == theirs
    assert rows == expected
    assert rows
