import os

import compare
import pytest

import __spark_entry__ as entry

from docloom.plans import catalog

NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def tables(small):
    return compare.connect(small)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, tables, name):
    df = entry.queries()[name](spark, small)
    assert compare.differences(df, tables, entry.oracle_sql()[name]) is None


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables not present")
    assert entry.entry(spark).count() > 0
