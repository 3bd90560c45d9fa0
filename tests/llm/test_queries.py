"""The queries on the smallest tables, against their SQL where there is one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_entry import DATA, compare  # noqa: E402

from pagewright.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    query, sql = queries.queries()[name], queries.oracle_sql().get(name)
    if sql:
        compare(spark, name, query, sql)
    else:
        assert query(spark, DATA).count() > 0
