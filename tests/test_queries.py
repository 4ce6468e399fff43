"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import duckdb
import pytest

from gridlore.plans import queries as Q

DIR = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "lineitem orders supplier embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in Q.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    a = Q.queries()[name](spark, DIR).toPandas()
    b = duck.execute(Q.oracle_sql()[name]).df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    order = [c for c in ("roi", "z", "y", "x", "cz", "cy", "cx", "id", "case_id", "draw", "tier", "family", "feature", "status") if c in names]
    a, b = (d[names].sort_values(order).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) > 0
    for c in names:
        x, y = a[c], b[c]
        if x.dtype.kind in "fi":
            assert ((x.astype(float) == y.astype(float)) | (x.isna() & y.isna())).all(), c
        else:
            assert (x.astype(str) == y.astype(str)).all(), c
