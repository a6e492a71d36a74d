"""Every query of the library against its oracle SQL on the smallest tables."""

import os

import pytest

from oracle import connect, difference
from tidemark import catalog

DATA = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLES:
        assert difference(df, con, catalog.ORACLES[name]) is None
    else:
        assert df.columns and df.count() >= 0
