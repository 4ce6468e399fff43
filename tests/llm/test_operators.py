"""Every operator on small tables that hold nulls, blanks, copies, ties, long texts and columns with clashing names, against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlore.llm import common, decontamination, hmm, langid, lines, mixing, sharding, simhash, tokens, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, uid int, bin int"
WORD = re.compile("[^\x20\x09-\x0d]+")
lower = lambda t: t.translate({i: i + 32 for i in range(65, 91)})


def _texts():
    r = random.Random(5)
    vocab = {"en": "the of and to in that is was for on with as by at it from his but not are".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    out = [None, "", " \t\n", "42 !!", "the", "THE the tHe", "a" * 5000 + " end", "the of and\n" * 2000]
    for n in range(60):
        lang = ("en", "de")[n % 2]
        words = [r.choice(vocab[lang]) + ("" if r.random() < 0.6 else str(r.randrange(500))) for _ in range(r.randrange(5, 120))]
        out.append(" ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :]))
    out += out[10:14] * 3  # copies
    out += [out[9][:-1] + "x", out[9] + " extra", out[12] + "!"]  # near copies
    return out


@pytest.fixture(scope="module")
def rows():
    t = _texts()
    r = [(i, x, (None, "en", "de")[0 if x is None else 1 + (i % 2)], (f"src{i % 5}" if i % 7 else None), 0, "s", 1, 2) for i, x in enumerate(t)]
    return [*r, r[20], (None, "the of and without a key", "en", "src1", 0, "s", 1, 2)]  # a repeated row and one without a key


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall(lower(t or ""))


def test_word_counts(spark, docs, rows):
    got = Counter((r["doc_id"], r["n"]) for r in common.with_word_count(docs, "text", ["doc_id"], "n").collect())
    assert got == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)


# 1
def test_mix(docs, rows, empty):
    out = mixing.mixed_documents(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(x for x in size if x is not None) + [None]
    weight, total, fixed = {n: i % 3 + 1 for i, n in enumerate(names)}, sum(size.values()), {}
    while True:
        rest = [n for n in names if n not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[n] for n in rest)
        over = [n for n in rest if level * weight[n] > 3 * size[n]]
        if not over:
            break
        fixed |= {n: 3 * size[n] for n in over}
    target = {n: fixed.get(n, level * weight[n]) for n in names}
    by_id = {r[0]: r for r in rows}
    taken, longest = Counter(), Counter()
    assert len(out) == len(rows)
    for r in out:
        source = by_id[r["doc_id"]][3]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(target[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    # What a source misses for a document too long for its rest goes to the others by weight.
    assert total - max(longest.values()) <= sum(taken.values()) <= total and all(target[s] - taken[s] <= longest[s] for s in names)
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(out) == key(mixing.mixed_documents(docs.repartition(5)).collect())
    assert mixing.mixed_documents(empty).count() == 0


def test_mix_rows_come_in_the_order_of_virtual_time(docs):
    m = mixing.mix(docs, partitions=3)
    assert m.columns == [*docs.columns, "mix_time"]
    times = [r["mix_time"] for r in m.collect()]
    assert times == sorted(times) and sum(r["taken"] for r in mixing.mixed_documents(docs).collect()) == sum(len(WORD.findall(r["text"])) for r in m.collect())


def test_targets_of_capped_sources(spark):
    t = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 1000), ("b", 10), ("c", 90)], "source string, source_size long")).collect()}
    assert t == {"a": 1100 - 30 - 270, "b": 30.0, "c": 270.0}


# 2
def test_scores(docs, rows, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for head in (1, 150_000):  # all words but a few by the join, or none
        out = hmm.score(docs, held_out=held, head_words=head).collect()
        out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for r in rows if not out_of(r[0]) for w in [*words(r[1]), None])
        n, v = sum(c.values()), len(c)
        by_id = {r[0]: [*words(r[1]), None] for r in rows}
        assert len(out) == len(rows)
        for r in out:
            t = by_id[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out_of(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hmm.score(empty, rounds=1).count() == 0


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    k = hmm.STATES
    model = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.CLASSES + 1), k).T
    seqs = [np.array(s, np.int32) for s in ([3, 9, hmm.CLASSES], [hmm.CLASSES], [1, 2])]
    got = hmm.forward(model, seqs)
    for s, g in zip(seqs, got):
        paths = np.array(np.meshgrid(*[range(k)] * len(s), indexing="ij")).reshape(len(s), -1)
        p = model[0][paths[0]] * model[2][s[0], paths[0]]
        for t in range(1, len(s)):
            p = p * model[1][paths[t - 1], paths[t]] * model[2][s[t], paths[t]]
        assert g == pytest.approx(np.log10(p.sum()))


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(0)
    seqs = [np.append(rng.integers(0, 40, 30) + 40 * (i % 2), hmm.CLASSES).astype(np.int32) for i in range(40)]
    size = (hmm.CLASSES + 1) * hmm.STATES + hmm.STATES**2 + hmm.STATES
    c = np.zeros(size)
    hmm.first_counts(seqs, c)
    model, last = hmm.estimated(c, True), None
    for _ in range(4):
        now = hmm.forward(model, seqs).sum()
        assert last is None or now > last - 1e-6
        c, last = np.zeros(size), now
        hmm.expected(model, seqs, c)
        assert c[: (hmm.CLASSES + 1) * hmm.STATES].sum() == pytest.approx(sum(map(len, seqs)))
        model = hmm.estimated(c, False)


# 3
def _fingerprint(t):
    w = words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(keys, fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    best = {}
    for i, k in enumerate(keys):
        r = find(i)
        if k is not None:
            best[r] = min(best.get(r, k), k)
    return [best.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, rows, empty):
    out = simhash.near_duplicates(docs).collect()
    fps = [_fingerprint(r[1]) for r in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], _components([r[0] for r in rows], fps)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_join_all_within_three_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({*base, *(b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(12))})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for limit in (4096, 3):  # the second sends most groups on to longer keys
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, group_limit=limit)).collect()}
        got = {}
        for s in signed:
            got.setdefault(roots.get(s, s), set()).add(s)
        want = {}
        for s, c in zip(signed, _components(signed, fps)):
            want.setdefault(c, set()).add(s)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_representatives(docs, rows):
    kept = sorted(r["doc_id"] for r in simhash.representatives(docs).collect() if r["doc_id"] is not None)
    comp = _components([r[0] for r in rows], [_fingerprint(r[1]) for r in rows])
    assert kept == sorted({c for c in comp if c is not None})


# 4
ITEMS = [(1, "the of and to in that is was for on with as by at it from"), (2, None), (3, "?!"), (4, "zz yy"), (5, "the of and to in that is was for on with as by at it from"), (6, "ä ö ü 3")]
FOLD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_decontamination(spark, rows, empty):
    extra = [(900, "so zz, YY! zz yy " + "pad " * 10, "en", "s", 0, "", 1, 2), (901, "x " * 30 + ITEMS[0][1].upper() + " y", "en", "s", 0, "", 1, 2), (902, "ä-ö_ü 3", "en", "s", 0, "", 1, 2), (903, "zz " * 50 + "zz yy" + " pad" * 100, "en", "s", 0, "", 1, 2)]
    everything = [*rows, *extra]
    docs = spark.createDataFrame(everything, DOCS).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    windows = {}
    for i, t in ITEMS:
        w = FOLD.findall(lower(t or ""))
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = Counter()
    for r in everything:
        w, hit, found = FOLD.findall(lower(r[1] or "")), set(), set()
        for x, owners in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= owners
        want[r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    for how in ({}, {"block_words": 5}):
        got = decontamination.scan(docs, items, **how).collect()
        assert Counter(tuple(r) for r in got) == want
    assert decontamination.scan(empty, items).count() == 0
    none = decontamination.scan(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(everything)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "red " + "x " * 30 + "blue green"), (3, "red blue")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "blue green red")], "item_id long, text string")
    got = {int(r["doc_key"]): list(r["items"]) for r in decontamination.search(docs, items, slop=5).collect()}
    assert got == {1: ["1"], 2: [], 3: []}


# 5
def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(400)]
    x += [x[7]] * 60  # ties
    data = [(i, v, 0) for i, v in enumerate(x)]
    data += [(500, None, 0), (600, [1.0, None] + [0.0] * 6, 0), (700, [float("nan")] * 8, 0), (None, x[0], 0), (800, [1.0, 2.0], 0), (801, [3.0, 1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int)) for i, v, _ in data if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = set()
    for i, q in ok:
        if i % 20 == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))[:10]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    for how in ({}, {"slice_rows": 50, "group_queries": 4}):
        got = topk.top_k(df, F.pmod(F.col("key"), F.lit(20)) == 0, **how).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(df.limit(0), F.col("key") == 0).count() == 0


def test_bounds_never_miss_a_cell():
    rng = np.random.default_rng(0)
    centre = rng.integers(-900, 900, (12, 6))
    x = np.repeat(centre, 40, 0) + rng.integers(-30, 30, (480, 6))
    cell = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
    radius = np.array([np.sqrt(((x[cell == c] - centre[c]) ** 2).sum(1)).max(initial=0) for c in range(12)])
    need = topk.needs(x[:50], centre, np.bincount(cell, minlength=12), radius, 10)
    assert need.mean() < 0.6
    for i in range(50):
        s = x @ x[i]
        s[i] = -(1 << 60)
        assert need[i][cell[np.argsort(-s)[:10]]].all()


def test_scores_beyond_doubles():
    q = np.array([[1 << 40, 3]])
    assert topk.scores(q, np.array([[(1 << 20) + 1, 1]]))[0, 0] == (1 << 40) * ((1 << 20) + 1) + 3
    assert topk.scores(q, np.array([[1 << 40, 0]]))[0, 0] == (1 << 63) - 1


# 6
def test_token_histogram(docs, rows, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tokens.RANKS, "rb"))}
    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(e.encode_ordinary(r[1] or "")) for r in rows])
    h = tokens.histogram(tokens.lengths(docs))
    got = h.collect()
    assert sorted(r["length"] for r in got) == sorted(set(n.tolist()))
    for r in got:
        k = r["length"]
        assert (r["documents"], r["documents_at_least"], r["tokens_at_least"], r["truncated_tokens"]) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum(), np.minimum(n, k).sum())
        assert r["share_fitting"] == pytest.approx((n <= k).mean())
    at = {r["limit"]: r for r in tokens.at_limits(h, docs.sparkSession.createDataFrame([(0,), (17,), (10**6,)], "limit long")).collect()}
    for k, r in at.items():
        assert (r["documents_fitting"], r["truncated_tokens"]) == ((n <= k).sum(), np.minimum(n, k).sum())
    q = tokens.quantiles(h).first()
    assert q["q0.5"] == np.sort(n)[math.ceil(0.5 * len(n)) - 1]
    assert tokens.histogram(tokens.lengths(empty)).count() == 0


# 7
PAGES = [(3, "http://a/", "x" * 200), (1, "http://b/", "x" * 200), (2, None, None), (4, "u\r\nInjected: 1", "ä" * 60), (5, "u", "short"), (6, "u", "short"), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n" * 30), (9, "u", "ä" * 60), (10, "v", "y" * 300_000)]


@pytest.mark.parametrize("compress", ["true", "false"])
def test_warc_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = {tuple(r) for r in warc.round_trip(pages, folder=str(tmp_path / "w")).collect()}
    want = set()
    for i, _, t in PAGES:
        b = (t or "").encode()
        first = min(j for j, _, u in PAGES if (u or "").encode() == b)
        again = len(b) >= 100 and first != i
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == want
    warc.register(spark)
    rows = warc.records(pages)
    rows.write.format("warc").mode("append").option("compress", compress).save(str(tmp_path / "x"))
    full = {r["page_id"]: r for r in spark.read.format("warc").load(str(tmp_path / "x")).collect()}
    assert len(full) == len(PAGES) and bytes(full["8"]["payload"]) == PAGES[7][2].encode() and full["4"]["target_uri"] == "u Injected: 1" and full["2"]["target_uri"] is None
    one = spark.read.format("warc").load(str(tmp_path / "x")).filter("page_id = '9'").collect()
    assert [(r["warc_type"], r["refers_to_page"]) for r in one] == [("revisit", "4")]
    again = spark.createDataFrame([(1, "a", "x" * 200), (1, "b", "x" * 200), (2, "c", "x" * 200), (None, "d", "x" * 200), (None, None, "z" * 150), (None, "e", "z" * 150), (5, "f", "s"), (5, "f", "s")], "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r)[0:1] + tuple(r)[3:] for r in warc.round_trip(again, folder=str(tmp_path / "r")).collect())
    assert got == Counter({(1, "response", None): 1, (1, "revisit", 1): 1, (2, "revisit", 1): 1, (None, "revisit", 1): 1, (None, "response", None): 1, (None, "revisit", None): 1, (5, "response", None): 2})
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty, folder=str(tmp_path / "e")).count() == 0


def test_foreign_archive_without_an_index(spark, tmp_path):
    warc.register(spark)
    body = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Target-URI: http://x\r\n  y\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n" + b"WARC/1.0\r\nwarc-type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(r["warc_type"], r["target_uri"], bytes(r["payload"])) for r in got] == [("request", "http://x y", b"GET"), ("response", None, b"ok")]
    r = warc.WarcReader({"path": str(tmp_path), "payload": "false"})
    r.wanted = {"warc_type": {"response"}}
    assert [x[-1] for p in r.partitions() for x in r.read(p)] == [None]


# 8
def test_language(docs, rows, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = langid.identify(docs, held_out=held, steps=120).collect()
    assert len(out) == len(rows)
    by_id, right, n = {r[0]: r for r in rows}, 0, 0
    for r in out:
        t = by_id[r["doc_id"]][1]
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not t or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and 8 <= r["doc_id"] < 68:
            n += 1
            right += r["lang_pred"] == ("en", "de")[(r["doc_id"] - 8) % 2] == by_id[r["doc_id"]][2] or r["lang_pred"] != "und" and by_id[r["doc_id"]][2] == r["lang_pred"]
    assert right > 0.85 * n
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._start(rng, 3, 4).items()}
    grid, y = rng.integers(0, 256, (6, 5)), np.array([0, 1, 2, 1, 0])
    grid[4:, 2:] = grid[3:, 4:] = 256  # rows by falling length
    _, g = langid._gradient(p, grid, y)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape) if k[0] != "x" else (grid[2, 1], 3)
        hold, e = p[k][at], 1e-3
        p[k][at] = hold + e
        up = langid._gradient(p, grid, y)[0]
        p[k][at] = hold - e
        down = langid._gradient(p, grid, y)[0]
        p[k][at] = hold
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=2e-4), k


# 9
def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_lines(spark):
    rng = random.Random(2)
    alphabet = "abcdé "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 40))) for _ in range(25)]
    every = list(base)
    for b in base * 4:
        t = list(b)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", "yy"])
        every.append("".join(t))
    every += ["", "  ", "short", "shore", base[0]]
    rng.shuffle(every)
    texts = [(i, "\n".join(every[i * 5 : i * 5 + 5])) for i in range(len(every) // 5)] + [(90, None), (91, "")]
    docs = spark.createDataFrame([(*t, "u", 1) for t in texts], "doc_id long, text string, uid string, place int").repartition(2)
    seen = sorted({x for _, t in texts for x in (t or "").split("\n") if x.strip()})
    up = list(range(len(seen)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(seen):
        for j in range(i):
            if min(len(a), len(seen[j])) >= 24 and _distance(a, seen[j]) <= 2:
                up[find(i)] = find(j)
    first, want = {}, {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        n = [0, [], 0, 0]
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                n[0] += 1
                c = find(seen.index(x))
                if c not in first:
                    first[c] = x
                    n[1].append(k)
                else:
                    n[2 + (first[c] != x)] += 1
        want[i] = (n[0], len(n[1]), n[2], n[3], n[1])
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.documents(docs).collect()}
    assert {k: (*v[:4], list(v[4])) for k, v in got.items()} == want and sum(v[3] for v in want.values()) > 20
    text = {r["doc_id"]: r["text"] for r in lines.deduplicated(docs).collect()}
    assert text[90] is None and sum(len([x for x in (t or "").split("\n") if x.strip()]) for t in text.values()) == sum(len(v[4]) for v in want.values())
    assert lines.documents(docs.limit(0)).count() == 0


def test_banded_distance(spark):
    rng = random.Random(0)
    pairs = [("", ""), ("", "ab"), ("abc", "abc"), ("abcd", "bcda"), ("abcdef", "abdefg")]
    for _ in range(120):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        pairs.append((a, "".join(rng.choice("ab") for _ in range(rng.randrange(9)))))
    df = spark.createDataFrame([(a, b, [ord(c) for c in a], [ord(c) for c in b]) for a, b in pairs], "a string, b string, x array<int>, y array<int>")
    for t in (1, 2, 3):
        for r in df.select("a", "b", lines.within(F.col("x"), F.col("y"), t).alias("near")).collect():
            assert r["near"] == (_distance(r["a"], r["b"]) <= t), (r, t)


# 10
def _least_capacity(sizes, shards):
    def fits(c):
        n, a = 1, 0
        for z in sizes:
            if z > c:
                return False
            if a + z > c:
                n, a = n + 1, 0
            a += z
        return n <= shards

    low, high = 1, sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if fits(m) else (m + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 24, 200])
def test_shards_by_bytes(docs, rows, empty, shards):
    out = sharding.assign(docs, shards, "bytes").collect()
    by_id, group = {r[0]: r[1] for r in rows}, Counter()
    for r in rows:
        group[sharding.NULL_GROUP if r[1] is None else hashlib.sha256(r[1].encode()).hexdigest()] += len((r[1] or "").encode()) + 8
    load, slots, home = Counter(), {}, {}
    for r in out:
        t = by_id[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes") and 0 <= r["shard"] < shards
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert home.setdefault(t, r["shard"]) == r["shard"]
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == _least_capacity([group[g] for g in sorted(group)], shards)
    assert sharding.assign(empty, shards).count() == 0


def test_other_laws(docs, rows):
    out = sharding.assign(docs, 5, "rows").collect()
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1
    a = sharding.assign(docs, 5, "key").collect()
    b = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 6, "key").collect()}
    assert all(r["grown_shard"] == b[r["doc_id"]] and r["grown_shard"] in (r["shard"], 5) for r in a)
    for s in (out, a):
        slots = {}
        for r in s:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
