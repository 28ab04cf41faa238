"""Every query of the subpackage over the smallest tables, against its SQL where there is one."""

import duckdb
import pytest

from beliefloom.llm import queries
from tests.test_queries import con, norm  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLES:
        cur: duckdb.DuckDBPyConnection = con.execute(queries.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert norm(got, df.columns) == norm(cur.fetchall(), cols)


def test_packing_uses_hardly_more_than_the_least(spark, sf):
    r = queries.p7_report(spark, sf).first()
    assert r.n_sequences <= 1.02 * r.least_sequences + 1 and r.fullest <= 1024
