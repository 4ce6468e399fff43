"""The pipeline's first stage on rows with labels, and without any."""

import corpus_pipeline as P
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_without_labels_lettered_documents_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "42 !?", None), (3, None, None), (4, "\u00e9", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in P.language_id(spark, docs, DIR).collect()) == [1, 4]


def test_labelled_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clean = {r["doc_id"] for r in docs.filter(F.col("lang").isNotNull() & (F.length("text") > 200) & (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) > 0.5 * F.length("text"))).collect()}
    lost = clean - {r["doc_id"] for r in P.language_id(spark, docs, DIR).collect()}
    assert len(clean) > 100 and len(lost) <= 0.01 * len(clean), sorted(lost)
