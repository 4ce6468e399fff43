"""Each stage of the pipeline, on a table with odd rows, against a brute-force version of it."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from gridlore.llm import langid, mixing, sharding
from tests.llm.test_cases import _plain
from tests.llm.test_operators import FOLD, WORD, _components, _fingerprint, _least_capacity, _texts, lower

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string, fp long"


@pytest.fixture(scope="module")
def rows(spark):
    items = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    r, texts = random.Random(8), _texts()
    pad = lambda n: " ".join(r.choice("plain words that fill a text between other things".split()) + str(r.randrange(90)) for _ in range(n))
    texts += [f"{pad(5)} {items[0]} {pad(5)}", f"{pad(3000)} {items[1]}", f"{pad(40)} {items[2].upper()}", "some long text with letters " * 4000, "12 34 !?"]
    out = [(i, t, None if t is None or i % 9 == 0 else ("en", "de")[i % 2], f"s{i % 4}" if i % 6 else None, 1, "note", i) for i, t in enumerate(texts)]
    return [*out, out[20], (None, "a text without a key", "en", "s1", 1, "note", 0), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def _rows(df):
    return Counter(map(tuple, df.collect()))


def test_language_id(spark, docs, rows):
    model = langid.Identifier(docs)
    p = {k: v.astype(float) for k, v in model.weights.items()}
    want = Counter()
    for r in rows:
        if r[1] and any(map(str.isalpha, r[1])):
            best = _plain(p, r[1].encode()[:20_000] if len(set(r[1].split())) < 6 else r[1].encode(), langid.CHUNK).max()  # the long texts repeat
            if best >= P.least_sure(len(model.languages)):
                want[r] += 1
    got = P.language_id(spark, docs, DIR)
    assert got.columns == docs.columns and _rows(got) == want and 0 < sum(want.values()) < len(rows)


def test_near_dedup(spark, docs, rows):
    component = _components([r[0] for r in rows], [_fingerprint(r[1]) for r in rows])
    got = P.near_dedup(spark, docs, DIR)
    kept = _rows(got)
    assert got.columns == docs.columns and sum(kept.values()) == len(set(component))
    assert Counter(r[0] for r in kept if r[0] is not None) == Counter({c: 1 for c in component if c is not None})


def test_decontaminate(spark, docs, rows):
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = FOLD.findall(lower(r["text"] or ""))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes, want, dropped = {len(w) for w in windows}, Counter(), 0
    for r in rows:
        w, hit = FOLD.findall(lower(r[1] or "")), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            dropped += 1
        else:
            want[r] += 1
    assert _rows(P.decontaminate(spark, docs, DIR)) == want and dropped >= 2


def test_mix_sources(spark, docs, rows):
    sized = [(r, len(WORD.findall(r[1] or ""))) for r in rows]
    h = [int(hashlib.md5(f"17|{'' if r[0] is None else r[0]}|{n}".encode()).hexdigest()[:15], 16) for r, n in sized]
    total = Counter()
    for r, n in sized:
        total[r[3]] += n
    names = sorted(x for x in total if x is not None) + [None]
    weight, fixed, budget = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, sum(total.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * total[s]]
        if not over:
            break
        fixed |= {s: 3 * total[s] for s in over}
    copies = []
    for rank, s in enumerate(names):
        own, end = [(k, r, n) for k, (r, n) in enumerate(sized) if r[3] == s], 0
        target = fixed.get(s, level * weight[s])
        for k, r, n in sorted(own, key=lambda x: (h[x[0]] % mixing.BUCKETS, h[x[0]], x[1][0] is not None, x[1][0] or 0, x[2])):
            end += n
            if n:
                copies += [((e * total[s] + end) / target, rank, h[k], "" if r[0] is None else str(r[0]), r, n) for e in range(3)]
    want, words = Counter(), 0
    for *_, r, n in sorted(copies, key=lambda c: c[:4]):
        if words + n > budget:
            break
        words += n
        want[r] += 1
    assert _rows(P.mix_sources(spark, docs, DIR)) == want and max(want.values()) > 1


def test_shard(spark, docs, rows):
    group = Counter()
    for r in rows:
        group[sharding.NULL_GROUP if r[1] is None else hashlib.sha256(r[1].encode()).hexdigest()] += len((r[1] or "").encode()) + 8
    out = P.shard(spark, docs, DIR).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows) and max(load.values()) == _least_capacity([group[g] for g in sorted(group)], P.SHARDS)


def test_stages_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, none, DIR).write.parquet(str(tmp_path / str(k)))
        assert spark.read.parquet(str(tmp_path / str(k))).count() == 0


def test_runs_do_not_disturb_each_other(spark):
    first = P.run(spark, DIR)
    second = P.run(spark, DIR)  # built before the first is read
    assert np.array_equal(*(np.sort([(r["doc_id"], r["shard"], r["slot"]) for r in df.collect()], axis=0) for df in (first, second)))
