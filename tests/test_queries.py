"""Every registered query against its SQL equivalent on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemill.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
