"""The operators' queries against their SQL, on the smallest tables and on odd rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridlore.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def _same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x
    rows = lambda d: sorted((tuple(map(plain, r)) for r in d[names].astype(object).itertuples(index=False)), key=str)
    assert rows(a) == rows(b) and len(a) == len(b) > 0


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    _same(Q.queries()[name](spark, DIR).toPandas(), c.execute(Q.oracle_sql()[name]).df())


def test_odd_rows(spark, tmp_path):
    docs = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", None), (2, None, "s"), (3, " \t", "t"), (4, "word " * 5000, "t"), (5, "q", None), (6, "one two", "u\u00e9"), (7, "a b", "U")]
    pages = [(1, "u", "x" * 120), (1, "v", "x" * 120), (2, "u", "x" * 120), (None, "u", "x" * 120), (3, None, None), (4, "u", "")]
    vectors = [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [0.5, -1.0]), (200, None), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (300, [1.0]), (7, [1.0, 2.0])]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op1_mix_sources", "op5_top_k", "op7_warc"):
        _same(Q.queries()[name](spark, str(tmp_path)).toPandas(), c.execute(Q.oracle_sql()[name]).df())
