"""Every query with a SQL twin must give the same rows; the others must give rows."""

import pytest

from hearthline.plans.catalog import load_all
from oracle import compare, connect

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["governorate", "market_segment", "n_listings", "avg_price", "avg_price_per_sqm"] and df.count() > 0
