"""The language model's parts put together by brute force, and long texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlore.llm import hmm
from tests.llm.test_operators import words

SIZE = (hmm.CLASSES + 1) * hmm.STATES + hmm.STATES**2 + hmm.STATES


def _classes(text):
    return [zlib.crc32(w.encode()[-3:]) % hmm.CLASSES for w in words(text)] + [hmm.CLASSES]


TEXTS = [None, "", " \t\n", "a", "A bb CCC dddd", "x" * 9, "tail", "é\u2028ü ß\x0bq", "  lead", "two\nlines\r\n", "zz" * 4000 + " end", None, "last"]


def test_words_and_classes_off_the_buffer():
    low_and_ends = list(hmm.pieces(pa.array(TEXTS)))
    got, said = [], []
    for i, j, low, ends in low_and_ends:
        w = hmm.Words(low, ends)
        x, cuts = w.sequences()
        got += [x[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
        all_words = w.array().to_pylist()
        said += [all_words[a:b] for a, b in zip(w.upto, w.upto[1:])]
    assert got == [_classes(t) for t in TEXTS]
    assert said == [[x.encode() for x in words(t)] for t in TEXTS]
    assert list(hmm.pieces(pa.array([], pa.string()))) == []


def test_score_is_the_sum_over_all_paths_and_words(spark, monkeypatch):
    """P(text) by the definition: the sum over all state paths of start, moves and class emissions, times each word's share of its class."""
    r = random.Random(3)
    vocab = "the of and to in that is was der die und das zu".split()
    texts = [" ".join(r.choice(vocab[(i % 2) * 6 : (i % 2) * 6 + 7]) for _ in range(r.randrange(1, 5))) for i in range(40)] + [None, "", "new words only", "THE Of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    kept, train = {}, hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    got = {x["doc_id"]: x["score"] for x in hmm.score(docs, held_out=held, head_words=4).collect()}
    start, move, emit = kept["model"]
    c = Counter(w for i, t in enumerate(texts) if i % 5 for w in words(t))
    ends = sum(1 for i in range(len(texts)) if i % 5)
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[zlib.crc32(w.encode()[-3:]) % hmm.CLASSES] += k
        v[zlib.crc32(w.encode()[-3:]) % hmm.CLASSES] += 1
    for i, t in enumerate(texts):
        seq = _classes(t)
        p = start * emit[seq[0]]
        for k in seq[1:]:
            p = (p[:, None] * move).sum(0) * emit[k]
        want = math.log10(p.sum()) + sum(math.log10((c[w] + 1) / (n[k] + v[k] + 1)) for w, k in zip(words(t), seq)) + math.log10((ends + 1) / (ends + 1))
        assert got[i] == pytest.approx(want, rel=1e-9), t
    assert np.allclose([start.sum(), *move.sum(1), *emit.sum(0)], 1)


def test_long_sequences_are_learned_from_whole():
    rng = np.random.default_rng(0)
    seqs = [np.append(rng.integers(0, 30, n), hmm.CLASSES).astype(np.int16) for n in (0, 1, 7, 250, 251, 1000)]
    first = np.zeros(SIZE)
    hmm.first_counts(seqs, first)
    assert first.sum() == pytest.approx(sum(map(len, seqs)))
    model = hmm.estimated(first, True)
    whole, blocks = np.zeros(SIZE), np.zeros(SIZE)
    hmm.expected(model, seqs, whole)
    hmm.expected(model, seqs, blocks, block=50)
    assert np.allclose(whole, blocks, rtol=1e-4, atol=1e-3)
    n = (hmm.CLASSES + 1) * hmm.STATES
    assert whole[n : n + hmm.STATES**2].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-4) and whole[n + hmm.STATES**2 :].sum() == pytest.approx(len(seqs), rel=1e-4)


def test_very_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 64)
    long = "some words again and " * 30_000
    docs = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, None, 0), (None, "a b", 0)], "doc_id long, text string, n long")
    got = hmm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 120_001), ("1", 120_001), ("2", 1), ("None", 3)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and all(math.isfinite(r["score"]) for r in got)
