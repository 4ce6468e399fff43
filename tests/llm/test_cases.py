"""Defined cases that hold for every operator: clashing names, repeated and null keys, long texts; and the network by brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.llm import common, decontamination, hmm, langid, lines, mixing, sharding, simhash, tokens

CLASH = "mix_time string, __mix_size string, fp string, node string, root string, uid string, h string, key string, text_crc32 string, shard string, slot string, size string, line string, place string, class string, id string, words string"
LONG = "a long text of many words, with letters " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four", "en", "s"), (1, "one two three four", "en", "s"), (None, "no key", None, None), (2, None, "en", "s"), (3, "", "de", "s"), (4, LONG, "en", "t"), (5, "ein deutscher Satz", "de", None), (None, None, None, None)]
    extra = len(CLASH.split(","))
    return spark.createDataFrame([(*r, *["c"] * extra) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(2)


def test_no_operator_minds_other_columns_or_odd_rows(spark, docs):
    n = docs.count()
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    results = {
        "mix": mixing.mixed_documents(docs), "score": hmm.score(docs), "simhash": simhash.near_duplicates(docs), "scan": decontamination.scan(docs, benchmark), "lengths": tokens.lengths(docs),
        "lang": langid.identify(docs, steps=2), "lines": lines.documents(docs), "bytes": sharding.assign(docs, 3), "rows": sharding.assign(docs, 3, "rows"), "keys": sharding.assign(docs, 3, "key"),
    }
    for name, df in results.items():
        assert df.count() == n, name
    assert results["scan"].filter("contaminated").count() == 2
    assert results["simhash"].filter("doc_id = 1").select("component_id").distinct().count() == 1
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 1
    assert lines.deduplicated(docs).columns == docs.columns


def test_mix_with_a_column_named_like_the_time(docs):
    m = mixing.mix(docs, partitions=2)
    assert m.columns == [*docs.columns, "__mix_time"] and {r["mix_time"] for r in m.collect()} == {"c"}


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", Conf, staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def _plain(p, text: bytes, chunk: int):
    """Pooled probabilities of one text, position by position."""
    total = np.zeros(len(p["b"]))
    sig = lambda x: 1 / (1 + np.exp(-x))
    for a in range(0, len(text), chunk):
        part, states = text[a : a + chunk], {}
        for side, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            k = len(p[f"u{side}"])
            h, states[side] = np.zeros(k), [None] * len(part)
            for t in order:
                x, hu = p[f"x{side}"][part[t]], h @ p[f"u{side}"]
                z, r = sig(x[:k] + hu[:k]), sig(x[k : 2 * k] + hu[k : 2 * k])
                h = (1 - z) * np.tanh(x[2 * k :] + r * (hu[2 * k :] + p[f"c{side}"])) + z * h
                states[side][t] = h
        for t in range(len(part)):
            s = np.concatenate([states["f"][t], states["b"][t]]) @ p["w"] + p["b"]
            e = np.exp(s - s.max())
            total += e / e.sum()
    return total / max(1, len(text))


def test_probabilities_are_those_of_a_plain_forward_pass():
    p = langid._start(np.random.default_rng(1), 3, langid.HIDDEN)
    texts = [b"", b"a", b"x" * 128, b"some words of a text " * 15, "Stra\u00dfe \u00e9".encode() * 40]
    got = langid.probabilities(p, texts)
    for t, g in zip(texts, got):
        assert np.allclose(g, _plain(p, t, langid.CHUNK), atol=1e-5)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = langid.identify(docs, held_out=held).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    rows = out.select("doc_id", "lang", "lang_pred", F.length("text").alias("n")).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 150 and right >= 0.97 * len(rows), (right, len(rows))
