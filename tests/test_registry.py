"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import compare


def test_entry(spark):
    assert entry.entry(spark).count() == 27


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, sf, name).startswith(("ok", "rows only"))
