"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest

from brooklet import registry
from tests.compare import DATA, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    columns, rows = rows_of(QUERIES[name](spark, DATA))
    assert columns
    if name in SQL:
        assert (columns, rows) == rows_of_sql(SQL[name])
