"""A hidden Markov language model of whole texts.

A text is its words (A-Z lower-cased) and one end token. Words fall into a fixed number of classes by
their last three bytes; hidden states emit classes, a class emits its words with add-one counts of all
training documents (one slot of each class is for words never seen):

    log10 P(text) = log10 P(classes; forward recursion) + sum over tokens of log10 (n(w) + 1) / (N_c + V_c + 1)

so the parameters that every task needs (states x classes) are bounded, while word counts stay a
distributed table. Baum-Welch counts are summed over partitions as fixed-point numbers (the sum does not
depend on the order of tasks). The start counts and every round cover all training documents, as do all word
and class counts.

Counts of frequent words (at most `head_words`) are sent to the tasks that score; the rest of each
document's words are looked up by a join, so the vocabulary may be of any size.

Defined cases: a null, empty or blank text is the end token alone; a null key is a training document, and neither keys
nor ties nor repeats matter (repeated rows are learned from and scored one by one); very long texts are read whole, in
training too (their backward pass goes block by block over recomputed forward states); without training documents N and
V are 0 and only the model's start values score; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import SPACES, lean, stage

STATES, CLASSES, SUFFIX, FIXED = 8, 4096, 3, 1 << 16
#: Rounds of Baum-Welch after the start counts, each over all training documents.
ROUNDS = 2
#: Steps whose forward states are held at once; of longer sequences they are computed anew, block by block.
BLOCK = 1 << 16
#: Bytes of text that are turned into arrays at once (a longer text alone).
PIECE = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWERED = np.frombuffer(_LOWER, np.uint8)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def pieces(texts: pa.Array):
    """Runs of texts of PIECE bytes or so: (first, end, lower-cased bytes, where each text begins and the last ends in them)."""
    t = texts.cast(pa.large_binary())
    n = len(t)
    if not n:
        return
    ends = np.frombuffer(t.buffers()[1], np.int64, n + 1, t.offset * 8)
    raw = np.frombuffer(t.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        yield i, j, _LOWERED[raw[ends[i] : ends[j]]], ends[i : j + 1] - ends[i]
        i = j


class Words:
    """The words of a piece's texts, found on the buffer for all texts at once."""

    def __init__(self, low: np.ndarray, ends: np.ndarray):
        self.low, self.texts = low, len(ends) - 1
        self.inside = ~SPACES[low]
        filled = ends[:-1] < ends[1:]
        self.opens = np.zeros(len(low) + 1, bool)  # a text begins here, so a word of the text before has ended
        self.opens[ends[:-1][filled]] = True
        last = self.inside.copy()
        last[:-1] &= ~self.inside[1:] | self.opens[1:-1]
        self.at = np.flatnonzero(last)  # the last byte of each word
        self.upto = np.searchsorted(self.at, ends)  # words before each text

    def array(self) -> pa.LargeBinaryArray:
        cuts = np.concatenate(([0], np.cumsum(self.inside)[self.at])).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at), [None, pa.py_buffer(cuts), pa.py_buffer(self.low[self.inside])])

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """(class numbers of all words, each text's end token last; where each text's begin and the last ends). A word's class is the
        CRC-32 of its last bytes."""
        at, low = self.at, self.low
        crc, going, reach = np.full(len(at), 0xFFFFFFFF, np.uint32), np.ones(len(at), bool), []
        for back in range(SUFFIX):
            if back:
                going = going & ~self.opens[at - back + 1] & (at >= back) & self.inside[np.maximum(at - back, 0)]
            reach.append(going)
        for back in range(SUFFIX - 1, -1, -1):
            step = _CRC[(crc ^ low[np.maximum(at - back, 0)]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            crc = np.where(reach[back], step, crc)
        out = np.full(len(at) + self.texts, CLASSES, np.int16)
        out[np.arange(len(at)) + np.repeat(np.arange(self.texts), np.diff(self.upto))] = (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(CLASSES)
        return out, self.upto + np.arange(self.texts + 1)


def _groups(seqs: list[np.ndarray], tokens: int = 400_000, most: int = 512):
    """Sequences by descending length, in groups that stay under a number of cells."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    while order:
        n = max(1, min(most, tokens // max(1, len(seqs[order[0]]))))
        yield order[:n]
        order = order[n:]


def _grid(seqs, group):
    lengths = np.array([len(seqs[i]) for i in group])
    grid = np.full((lengths[0], len(group)), CLASSES, np.int32)
    for j, i in enumerate(group):
        grid[: lengths[j], j] = seqs[i]
    active = len(group) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    return grid, active


def forward(model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled forward recursion."""
    start, move, emit = model
    out = np.zeros(len(seqs))
    for group in _groups(seqs):
        grid, active = _grid(seqs, group)
        logs = np.zeros(len(group))
        a = None
        for t, n in enumerate(active):
            e = emit[grid[t, :n]]
            a = start * e if a is None else (a[:n] @ move) * e
            s = a.sum(1)
            a /= s[:, None]
            logs[:n] += np.log10(s)
        out[group] = logs
    return out


def expected(model, seqs: list[np.ndarray], counts: np.ndarray, block: int = BLOCK) -> None:
    """Adds the expected counts (emissions, moves, starts; flat) of the sequences."""
    start, move, emit = (x.astype(np.float32) for x in model)
    k = STATES
    n_emit = (CLASSES + 1) * k
    emissions, moves, starts = counts[:n_emit].reshape(-1, k), counts[n_emit : n_emit + k * k].reshape(k, k), counts[n_emit + k * k :]
    for group in _groups(seqs):
        grid, active = _grid(seqs, group)

        def ahead_of(a, begin, end):
            """Forward states and scales of the steps from begin to end; a: those of the step before."""
            alphas, scales = [], []
            for t in range(begin, end):
                n = active[t]
                e = emit[grid[t, :n]]
                a = start * e if t == 0 else (a[:n] @ move) * e
                s = a.sum(1)[:, None]
                a = a / s
                alphas.append(a)
                scales.append(s)
            return alphas, scales

        begins, entry, held = range(0, len(active), block), {0: None}, None
        for b in begins:
            held = ahead_of(entry[b], b, min(b + block, len(active)))
            entry[b + block] = held[0][-1]
        beta, after = np.ones((len(group), k), np.float32), None  # after: the moves' share of the step behind a block's last
        for b in reversed(begins):
            alphas, scales = held if b + block >= len(active) else ahead_of(entry[b], b, b + block)
            gammas = [None] * len(alphas)
            for t in range(b + len(alphas) - 1, b - 1, -1):
                n, a = active[t], alphas[t - b]
                if after is not None:
                    moves += (a[: len(after)].T @ after) * move
                gammas[t - b] = a * beta[:n]
                after = emit[grid[t, :n]] * beta[:n] / scales[t - b]
                beta[:n] = after @ move.T
            if b == 0:
                starts += gammas[0].sum(0)
            seen = np.concatenate([grid[t, : active[t]] for t in range(b, b + len(alphas))])
            g = np.concatenate(gammas).T.astype(np.float64)
            for s in range(k):
                emissions[:, s] += np.bincount(seen, weights=g[s], minlength=CLASSES + 1)


def first_counts(seqs: list[np.ndarray], counts: np.ndarray) -> None:
    """Start counts: each sequence mostly in the state that its most frequent class hashes to."""
    k = STATES
    by_state: list[list] = [[] for _ in range(k)]
    for s in seqs:
        top = int(np.bincount(s[:-1]).argmax()) if len(s) > 1 else 0
        by_state[(top * 0x9E3779B1 >> 16) % k].append(s)
    emissions = counts[: (CLASSES + 1) * k].reshape(-1, k)
    for state, own in enumerate(by_state):
        if own:
            share = np.full(k, 0.15 / k)
            share[state] += 0.85
            emissions += np.bincount(np.concatenate(own), minlength=CLASSES + 1)[:, None] * share


def estimated(counts: np.ndarray, start: bool):
    """(start, move, emit) from summed counts; emissions are smoothed by the class distribution of all states."""
    k = STATES
    n_emit = (CLASSES + 1) * k
    emissions, moves, starts = counts[:n_emit].reshape(-1, k), counts[n_emit : n_emit + k * k].reshape(k, k), counts[n_emit + k * k :]
    overall = emissions.sum(1) + 0.5
    overall /= overall.sum()
    emit = emissions + 20.0 * overall[:, None]
    emit /= emit.sum(0)
    if start:
        move = np.full((k, k), 0.04 / k) + 0.96 * np.eye(k)
        begin = np.full(k, 1 / k)
    else:
        move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
        begin = (starts + 0.1) / (starts + 0.1).sum()
    return begin, move, emit


def encoded(docs: DataFrame, text: str = "text") -> DataFrame:
    """(seq): each text's class numbers as 16-bit integers."""

    def run(batches):
        for b in batches:
            for _, _, low, ends in pieces(b.column(0)):
                numbers, cuts = Words(low, ends).sequences()
                yield pa.RecordBatch.from_arrays([pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(2 * cuts), pa.py_buffer(numbers)]).cast(pa.binary())], names=["seq"])

    return lean(docs).select(F.col(text).alias("text")).mapInArrow(run, "seq binary")


def _summed(seqs: DataFrame, model) -> np.ndarray:
    """Counts over encoded texts, summed over partitions."""
    size = (CLASSES + 1) * STATES + STATES * STATES + STATES
    sent = seqs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        counts, waiting, held = np.zeros(size), [], 0

        def flush():
            first_counts(waiting, counts) if sent.value is None else expected(sent.value, waiting, counts)
            waiting.clear()

        for b in batches:
            for x in b.column(0):
                waiting.append(np.frombuffer(x.as_buffer(), np.int16))
                held += len(waiting[-1])
                if held > 1_000_000:
                    flush()
                    held = 0
        if waiting:
            flush()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.rint(counts[at] * FIXED).astype(np.int64))], names=["at", "n"])

    total = np.zeros(size)
    for r in seqs.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        total[r["at"]] = r["n"] / FIXED
    sent.unpersist()
    return total


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS):
    """(start, move, emit) from docs by Baum-Welch. Texts are read once; every round goes over all of their staged sequences."""
    seqs, model = stage(encoded(docs, text), "sequences"), None
    for _ in range(rounds + 1):
        model = estimated(_summed(seqs, model), start=model is None)
    return model


def vocabulary(docs: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(word, n) over docs; the empty word counts the end tokens."""

    def run(batches):
        parts, rows, texts = [], 0, 0

        def merged():
            t = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": t["word"], "n": t["n_sum"]})

        def rows_of(t):
            for b in pa.table({"word": t["word"].cast(pa.string()), "n": t["n"]}).combine_chunks().to_batches(100_000):
                yield b

        for b in batches:
            texts += b.num_rows
            for _, _, low, ends in pieces(b.column(0)):
                c = Words(low, ends).array().value_counts()
                parts.append(pa.table({"word": c.field("values"), "n": c.field("counts")}))
                rows += len(c)
            if rows > 3 * flush:
                parts = [merged()]
                rows = len(parts[0])
                if rows > flush:
                    yield from rows_of(parts[0])
                    parts, rows = [], 0
        if texts:
            parts.append(pa.table({"word": pa.array([b""], pa.large_binary()), "n": pa.array([texts], pa.int64())}))
            yield from rows_of(merged())

    return lean(docs).select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class(word):
    return F.when(word == "", F.lit(CLASSES)).otherwise(F.crc32(F.substring(word.cast("binary"), -SUFFIX, SUFFIX)) % CLASSES).cast("int")


def _head(vocab: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """Words of at least a count that at most `most` words have, and that count. The end token is always among them."""
    floor, held = 1 << 62, 0
    for r in vocab.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).collect():
        if held + r["words"] > most:
            break
        floor, held = r["n"], held + r["words"]
    rows = vocab.filter((F.col("n") >= floor) | (F.col("word") == "")).collect()
    return {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in rows}, floor


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out=None, head_words: int = 150_000, rounds: int = ROUNDS) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a column; the model learns from the rest."""
    out = F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False))
    learn = docs.filter(~out)
    model = train(learn, text, rounds)
    vocab = stage(vocabulary(learn, text), "vocabulary")
    tokens, types = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per_class = np.ones(CLASSES + 1)
    for r in vocab.filter("word <> ''").groupBy(_class(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES rows
        per_class[r["c"]] = r["n"] + r["v"] + 1
    head, floor = _head(vocab, head_words)
    per_class[CLASSES] = head.get(b"", 0) + 1
    sent = docs.sparkSession.sparkContext.broadcast((model, np.log10(per_class), head))

    def run(batches):
        model, logs, head = sent.value
        known_words = pa.array(list(head), pa.large_binary())
        n = np.fromiter(head.values(), np.int64, len(head))
        gain, known = np.append(np.log10(n + 1.0), 0.0), np.append(n > 0, False)
        end = list(head).index(b"") if b"" in head else len(head)
        for b in batches:
            for i, j, low, ends in pieces(b.column(3)):
                w = Words(low, ends)
                numbers, cuts = w.sequences()
                words = w.array()
                found = pc.fill_null(pc.index_in(words, value_set=known_words), len(head)).to_numpy()
                at = np.full(len(numbers), end)
                ends_of = cuts[1:] - 1
                inner = np.ones(len(numbers), bool)
                inner[ends_of] = False
                at[inner] = found
                missing = np.flatnonzero(found == len(head))
                rest: list[Counter] = [Counter() for _ in range(j - i)]
                for t, x in zip(np.searchsorted(w.upto, missing, "right") - 1, words.take(pa.array(missing)).cast(pa.string()).to_pylist()):
                    rest[t][x] += 1
                if end == len(head):  # without training documents the end token is unknown too
                    for c in rest:
                        c[""] += 1
                sums = lambda x: np.add.reduceat(x, cuts[:-1])
                likely = forward(model, [numbers[a:z] for a, z in zip(cuts, cuts[1:])]) - sums(logs[numbers])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(np.diff(cuts), pa.int64()), pa.array(likely), pa.array(sums(gain[at])), pa.array(sums(known[at].astype(np.int64))),
                    pa.array([list(c) for c in rest], pa.list_(pa.string())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64())), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i),
                ], names=["uid", "n_tokens", "model", "gain", "known", "words", "times", "key", "held_out"])

    kind = docs.schema[key].dataType.simpleString()
    rows = lean(docs).select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), out.alias("held_out"), F.col(text).alias("text"))
    shape = f"uid long, n_tokens long, model double, gain double, known long, words array<string>, times array<long>, key {kind}, held_out boolean"
    part = stage(rows.mapInArrow(run, shape), "scores")
    tail = part.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    found = tail.join(vocab.filter(F.col("n") < floor), "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(n + 1.0)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    total = F.col("gain") + F.coalesce("more", F.lit(0.0))
    return part.join(found, "uid", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.log10(F.lit(tokens + types + 1.0))).alias("base_score"), (total + F.col("model")).alias("score"),
    )
