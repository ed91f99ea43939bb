"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from tests.conftest import SF, same

from brightfield.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    ours, theirs = same(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])
    assert ours == theirs


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
