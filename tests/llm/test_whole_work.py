"""Operators on tables where an earlier version left out a part of the work."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import hmm, langid, tokens, topk


# 2
def test_every_round_reads_all_documents(spark, monkeypatch):
    ids = [r["id"] for r in spark.range(200).filter(F.pmod(F.xxhash64(F.lit("rounds"), "id"), F.lit(16)) > 0).collect()]  # none in the first 1/16
    topics = ["".join(f"{c}{d} " for d in "abcdefgh") * 5 for c in ("xx", "yy", "zz")]
    docs = spark.createDataFrame([(i, topics[i % 3]) for i in ids], "doc_id long, text string").repartition(3)
    seen, summed = [], hmm._summed
    monkeypatch.setattr(hmm, "_summed", lambda d, m: (seen.append(d.count()), summed(d, m))[1])
    _, _, emit = hmm.train(docs)
    assert len(seen) == 1 + hmm.ROUNDS and set(seen) == {len(ids)}
    assert np.ptp(emit, axis=1).max() > 0.01  # the states differ


# 5
@pytest.mark.parametrize("copies", [1, 11, 40])
def test_top_k_with_repeated_query_ids(spark, copies):
    rng = np.random.default_rng(1)
    centres = np.array([[6.0, 1, 0, 0], [5.0, 0, 1, 0], [0, 5.0, 0, 1], [0, 0, 5.0, 0]])
    data = [(2 * i + 1, (centres[i % 4] + rng.normal(size=4) * 0.01).tolist()) for i in range(3000)]
    own = spark.range(0, 6000, 2).orderBy(F.xxhash64("id")).first()["id"]  # drawn as a pivot, so its rows have a cell of their own
    data += [(own, [8.0, 0.0, 0.0, 0.0])] * copies + [(own, [0.0, 3.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    rows = [(n, i, np.floor(1024 * np.array(v)).astype(int)) for n, (i, v) in enumerate(data)]
    want = Counter()
    for n, _, q in rows[3000:]:  # every row of the id asks; its other rows are candidates
        best = sorted((-int(q @ v), i) for m, i, v in rows if m != n)[:10]
        want += Counter((own, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(map(tuple, topk.top_k(df, F.col("key") == own).collect())) == want


def test_only_crowded_groups_are_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(size=4) * 0.01 + np.eye(4)[i % 4]).tolist()) for i in range(800)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in data]
    got = {tuple(r) for r in topk.top_k(df, F.col("key") % 2 == 0, group_queries=16, slice_rows=64).collect()}
    want = set()
    for i, q in rows[::2]:
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(sorted((-int(q @ v), j) for j, v in rows if j != i)[:10])}
    assert got == want


# 6
def test_every_limit_is_answered(spark):
    n = np.array([0, 3, 3, 10_500, 20_000])
    h = tokens.histogram(spark.createDataFrame([(int(x),) for x in n], "length long"))
    got = {r["id"]: tuple(r)[1:] for r in tokens.at_limits(h, spark.range(10_600), "id").collect()}
    assert got == {k: ((n <= k).sum(), (n > k).sum(), np.minimum(n, k).sum()) for k in range(10_600)}
    none = tokens.at_limits(h.limit(0), spark.range(2), "id").collect()
    assert sorted(map(tuple, none)) == [(0, 0, 0, 0), (1, 0, 0, 0)]


# 8
def test_every_label_is_drawn(spark):
    docs = spark.range(10_050).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    assert langid.sample(docs, "doc_id", "text", "lang", 20_000)["lang"].nunique() == 10_050
