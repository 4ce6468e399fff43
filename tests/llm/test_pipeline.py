"""The pipeline on the smallest tables: what its stages promise together; test_pipeline_stages.py holds each by brute force."""

from collections import Counter

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {}
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, docs, DIR)
        if name != "shard":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left[name] = Counter(r["doc_id"] for r in docs.collect())
    assert len(left["language_id"]) > 0.97 * len(texts)
    assert set(left["near_dedup"]) < set(left["language_id"]) and max(left["near_dedup"].values()) == 1
    kept = [texts[i] for i in left["near_dedup"]]
    assert len(set(kept)) == len(kept)
    assert set(left["decontaminate"]) < set(left["near_dedup"])
    assert set(left["mix_sources"]) <= set(left["decontaminate"]) and max(left["mix_sources"].values()) <= 3
    assert left["shard"] == left["mix_sources"]
    again = P.run(spark, DIR)
    assert Counter(r["doc_id"] for r in again.collect()) == left["shard"]
