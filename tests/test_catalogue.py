"""Every query of the catalogue against its SQL on the smallest tables, whatever the partitioning."""

import collections
import math

import duckdb
import pytest

from leafmill.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    assert got
    if name not in catalogue.oracle_sql():
        return
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(r[c]) for c in columns) for r in rows)
    assert got == want
