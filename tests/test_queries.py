"""Every query of the core over the smallest tables, against its SQL."""

import glob
import os

import duckdb
import pytest

from beliefloom.plans import registry


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        cur = con.execute(registry.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert norm(got, df.columns) == norm(cur.fetchall(), cols)


def test_entry(spark, sf):
    assert registry.entry(spark, sf).count() > 0
