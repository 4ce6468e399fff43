"""near_dedup's slim tables are written to few files, however many partitions shuffles have, and its two ways to drop rows agree."""

from collections import Counter

import corpus_pipeline as P
import pytest
from gridlore.llm import common, simhash

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sum(x.getPath().getName().startswith("part-") for x in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def test_few_files(spark, many_partitions, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    with common.noting(staged := []):
        P.near_dedup(spark, docs, DIR).write.parquet(str(tmp_path / "out"))
    few = {"simhash-nodes", "simhash-links", "edges"}
    files = [(tag, _files(spark, p)) for p in staged if (tag := p.rsplit("/", 1)[1].rsplit("-", 1)[0]) in few]
    assert few == {tag for tag, _ in files} and all(n == 1 for _, n in files), files
    assert len(list((tmp_path / "out").glob("part-*"))) <= docs.rdd.getNumPartitions()  # texts are not shuffled


def test_both_ways_to_drop(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = lambda: Counter(map(tuple, P.near_dedup(spark, docs, DIR).collect()))
    few = rows()
    monkeypatch.setattr(simhash, "FEW_ROWS", -1)
    assert 0 < sum(few.values()) < docs.count() and rows() == few


def test_slim_tables_grow_files(spark, monkeypatch):
    """Beyond ROWS_A_FILE there are more files; the rows stay the same."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = lambda: Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    one = rows()
    monkeypatch.setattr(simhash, "ROWS_A_FILE", 30)
    assert simhash._files(61) == 3 and simhash._files(0) == 1 and rows() == one
