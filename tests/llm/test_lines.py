"""Line dedup where many lines share a segment, and its defined cases, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from gridlore.llm import lines
from tests.llm.test_operators import _distance


def _near(a, b, threshold=2):
    """By the definition, after a test of lengths and letters that no near pair fails."""
    if abs(len(a) - len(b)) > threshold or sum(abs(a.count(c) - b.count(c)) for c in set(a + b)) > 2 * threshold:
        return False
    return _distance(a, b) <= threshold


@pytest.mark.parametrize("limit", [lines.GROUP_LIMIT, 4])
def test_many_lines_share_one_segment(spark, limit):
    rng = random.Random(4)
    n = 5000 if limit > 4 else 300
    common = "All rights reserved, posted on "
    every = [common + "".join(rng.choice("abcdefghijklmnop") for _ in range(60)) for _ in range(n)]
    near = []
    for b in every[:40]:
        t = list(b)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        near.append("".join(t))
    texts = every + near
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    ids = {bytes(r["m"]): r["text"] for r in docs.select("text", F.unhex(F.md5("text")).alias("m")).collect()}
    got = {frozenset((ids[bytes(r["a"])], ids[bytes(r["b"])])) for r in lines.edges(docs, group_limit=limit).collect()}
    want = {frozenset((a, b)) for b in near for a in texts if a != b and _near(a, b)}
    assert got == want and len(want) > 25


def test_signatures_of_every_level_meet_for_all_near_pairs(spark):
    rng, pairs = random.Random(0), []
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(24, 34)))
        t = list(a)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "a", "b"])
        b = "".join(t)
        if len(b) >= 24 and _distance(a, b) <= 2:
            pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame([(2 * k, *p) for k, p in enumerate(pairs)], "h long, a string, b string")
    for parts, intact in ((3, 1), (4, 2), (6, 4)):
        x, y = (lines.signatures(df.select("h", F.col(c).alias("line"), F.length(c).alias("n")), 2, 24, parts, intact) for c in "ab")
        met = x.filter("tag % 2 <> 0").select((F.col("tag") - 1).alias("tag"), "key").intersect(y.select(F.col("tag").bitwiseAND(F.lit(-2)).alias("tag"), "key"))
        assert met.select("tag").distinct().count() == len(pairs)


def test_defined_cases(spark):
    long = "word " * 60_000
    rows = [(2, "same line\nsame line"), (2, "same line\nsame line"), (None, "same line\n\n \t"), (1, None), (3, ""), (4, long + "\n" + long), (5, long[:-1] + "!"), (6, "an edit apart, of more than 24 characters\nan edit apart, of more than 24 charactxrs")]
    docs = spark.createDataFrame([(*r, "a", b"b", 7) for r in rows], "doc_id long, text string, uid string, id binary, place int")
    want = sorted([(2, 2, 0, 2, 0, []), (2, 2, 0, 2, 0, []), (None, 1, 1, 0, 0, [0]), (1, 0, 0, 0, 0, []), (3, 0, 0, 0, 0, []), (4, 2, 1, 1, 0, [0]), (5, 1, 0, 0, 1, []), (6, 2, 1, 0, 1, [0])], key=str)
    for n in (1, 3, 7):
        got = [(*tuple(r)[:5], list(r["kept_places"])) for r in lines.documents(docs.repartition(n)).collect()]
        assert sorted(got, key=str) == want
    d = lines.deduplicated(docs)
    assert d.columns == docs.columns and d.count() == len(rows) and {(r["uid"], bytes(r["id"]), r["place"]) for r in d.collect()} == {("a", b"b", 7)}


def test_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARES", 4)
    rows = [(i, "common line\n" + f"line of its own number {i}") for i in range(30)] + [(i, "common lines\nrare") for i in (40, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_kept"], r["n_copies"]) for r in lines.documents(docs, least=100).collect()}
    assert got == {0: (2, 0), **{i: (1, 1) for i in range(1, 30)}, 40: (2, 0), 41: (0, 2)}
