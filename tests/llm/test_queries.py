"""The training-data queries against their SQL, on the smallest tables."""

import pytest

from tests.test_catalogue import check, pytestmark, sql  # noqa: F401
from webloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):  # noqa: F811
    check(spark, sql, QUERIES[name], SQL.get(name))
