"""Every registered catalogue query against its SQL over the smallest test tables."""

import os
from collections import Counter
from decimal import Decimal

import pytest

from agendum import plans

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float | Decimal) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    want = duck.sql(plans.SQL[name])
    columns = sorted(want.columns)
    got = plans.QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(plain(tuple(r)) for r in got.select(columns).collect()) == Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())
