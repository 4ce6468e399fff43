"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its UTF-8 bytes, read in chunks of fixed length by two gated recurrent layers, one from either
side, each started afresh in a chunk. Every position is labelled: a softmax over the languages from the two
states. A text's probabilities are the mean over all its positions.

The network is trained in numpy by backpropagation through time, on the driver, from a bounded sample:
at most `sample_rows` labelled rows, drawn by a hash of the key with a share for each language, of each a
run of `chunk` bytes or so at a hashed place. Everything else covers whole texts.

Defined cases: null texts and texts without a letter are `und` with score 0; so is everything if no row is
labelled; very long texts are read whole, chunk by chunk; ties go to the language first by code point; a null key is a
learned row like any other; repeated rows are labelled one by one; an empty table gives an empty result; `label` takes
other columns along, but for such as have the names asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.llm.common import lean

HIDDEN, CHUNK = 8, 128
UNKNOWN = "und"


def _start(rng, languages: int, hidden: int) -> dict:
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (257, 3 * hidden))  # a row for each byte and one for padding: input weights of both gates and the candidate
        p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"c{side}"] = np.zeros(hidden)
    p["w"] = rng.normal(0, 0.3, (2 * hidden, languages))
    p["b"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict, side: str, grid: np.ndarray, keep: bool):
    """States of one direction at every position: (positions, rows, hidden), and what backpropagation needs.

    Rows come by falling length, with padding (256) at their ends only: a step has just the rows that reach it, so a row begins afresh
    at its own end from behind, whatever it shares a grid with."""
    x, u, c = p[f"x{side}"], p[f"u{side}"], p[f"c{side}"]
    k = len(u)
    steps, rows = grid.shape
    active = (grid < 256).sum(1)
    out, held = np.zeros((steps, rows, k), u.dtype), []
    h = np.zeros((rows if side == "f" else 0, k), u.dtype)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        n = active[t]
        h = h[:n] if len(h) >= n else np.concatenate([h, np.zeros((n - len(h), k), u.dtype)])
        hu = h @ u
        g = x[grid[t, :n]]
        gates = np.tanh((g[:, : 2 * k] + hu[:, : 2 * k]) * np.float32(0.5))  # a logistic function of the sum is (1 + this) / 2
        gates += 1
        gates *= np.float32(0.5)
        z, r = gates[:, :k], gates[:, k:]
        a = hu[:, 2 * k :] + c
        new = np.tanh(g[:, 2 * k :] + r * a)
        if keep:
            held.append((t, h, z, r, a, new))
        h = new + z * (h - new)
        out[t, :n] = h
    return out, held


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(-1, keepdims=True))
    return s / s.sum(-1, keepdims=True)


def _gradient(p: dict, grid: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of all positions that are no padding, and its gradient. Rows of the grid come by falling length."""
    hidden = len(p["uf"])
    sides = {s: _states(p, s, grid, True) for s in "fb"}
    both = np.concatenate([sides["f"][0], sides["b"][0]], -1)
    prob = _softmax(both @ p["w"] + p["b"])
    real = grid < 256
    n = max(1, int(real.sum()))
    chosen = np.take_along_axis(prob, np.broadcast_to(labels[None, :, None], (*grid.shape, 1)), -1)[..., 0]
    loss = float(-(np.log(chosen + 1e-9) * real).sum() / n)
    d = prob.copy()
    np.put_along_axis(d, np.broadcast_to(labels[None, :, None], (*grid.shape, 1)), chosen[..., None] - 1, -1)
    d *= (real / np.float32(n))[..., None]
    g = {"w": np.einsum("tbk,tbl->kl", both, d, optimize=True), "b": d.sum((0, 1))}
    d_both = d @ p["w"].T
    for s, part in (("f", d_both[..., :hidden]), ("b", d_both[..., hidden:])):
        u = p[f"u{s}"]
        dx, du, dc = np.zeros_like(p[f"x{s}"]), np.zeros_like(u), np.zeros_like(p[f"c{s}"])
        carry = np.zeros((0, hidden), u.dtype)
        for t, h, z, r, a, cand in reversed(sides[s][1]):
            n_rows = len(h)
            dh = part[t, :n_rows].copy()
            some = min(n_rows, len(carry))
            dh[:some] += carry[:some]
            d_n = dh * (1 - z) * (1 - cand * cand)
            d_z = dh * (h - cand) * z * (1 - z)
            d_a = d_n * r
            d_r = d_n * a * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_a], 1)
            np.add.at(dx, grid[t, :n_rows], np.concatenate([d_z, d_r, d_n], 1))
            du += h.T @ d_hu
            dc += d_a.sum(0)
            carry = dh * z + d_hu @ u.T
        g |= {f"x{s}": dx, f"u{s}": du, f"c{s}": dc}
    return loss, g


def fit(texts: list[bytes], labels: list[int], languages: int, hidden: int = HIDDEN, chunk: int = 64, steps: int = 300, batch: int = 96, rate: float = 0.012, seed: int = 3) -> dict:
    """Parameters after `steps` batches of Adam."""
    rng = np.random.default_rng(seed)
    p = _start(rng, languages, hidden)
    if not texts:
        return p
    grid = np.full((len(texts), chunk), 256, np.int16)
    for i, t in enumerate(texts):
        grid[i, : min(chunk, len(t))] = np.frombuffer(t[:chunk], np.uint8)
    y, reach = np.array(labels), (grid < 256).sum(1)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    share = 1.0 / np.bincount(y, minlength=languages)[y]
    share /= share.sum()
    for n in range(1, steps + 1):
        at = rng.choice(len(y), min(batch, len(y)), p=share)
        at = at[np.argsort(-reach[at], kind="stable")]
        _, g = _gradient(p, np.ascontiguousarray(grid[at].T), y[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        lr = rate * (1 - n / (steps + 1))
        for k in p:
            x = g[k] * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return p


def probabilities(p: dict, texts: list[bytes], chunk: int = CHUNK, rows: int = 2048) -> np.ndarray:
    """Pooled probabilities, a row for each text; zeros for an empty one."""
    total = np.zeros((len(texts), len(p["b"])))
    counts = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(counts) - counts
    pieces = -(-counts // chunk)
    owner = np.repeat(np.arange(len(texts)), pieces)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * chunk
    lengths = np.minimum(chunk, counts[owner] - place)
    order = np.argsort(-lengths, kind="stable")  # pieces of equal length together: little padding
    for i in range(0, len(order), rows):
        at = order[i : i + rows]
        steps = np.arange(lengths[at[0]])
        index = (starts[owner[at]] + place[at])[None, :] + steps[:, None]
        real = steps[:, None] < lengths[at][None, :]
        grid = np.where(real, flat[np.minimum(index, len(flat) - 1)], np.int16(256)).astype(np.int16)
        f, b = _states(p, "f", grid, False)[0], _states(p, "b", grid, False)[0]
        w, k = p["w"], len(p["uf"])
        s = np.exp(np.clip(f @ w[:k] + b @ w[k:] + p["b"], -30, 30))
        s *= (real / s.sum(-1))[..., None]
        np.add.at(total, owner[at], s.sum(0))
    return total / np.maximum(counts, 1)[:, None]


#: Labels up to which the chances to be drawn are a map in the query; more are joined.
MAP_LABELS = 1_000


def sample(docs: DataFrame, key: str, text: str, lang: str, sample_rows: int, chunk: int = 64) -> pd.DataFrame:
    """(lang, snippet) of at most sample_rows rows. Counts by language come first, without texts; a language's rows are drawn with
    a chance that gives each language an equal share."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    by_lang = labelled.groupBy(lang).agg(F.count("*").alias("n"))
    counts = {r[lang]: r["n"] for r in by_lang.limit(MAP_LABELS + 1).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "snippet": []})
    if len(counts) <= MAP_LABELS:
        share = sample_rows / len(counts)
        chance = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, share / n)))])[F.col(lang)]
    else:
        share = sample_rows / by_lang.count()
        labelled = labelled.join(by_lang.select(F.col(lang), F.least(F.lit(1.0), share / F.col("n")).alias("__chance")), lang)
        chance = F.col("__chance")
    h = F.xxhash64(F.lit("sample"), F.col(key))
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(key)), F.greatest(F.length(text) - chunk, F.lit(0)) + 1).cast("int") + 1
    drawn = labelled.filter(F.pmod(h, F.lit(1_000_003)) / 1_000_003.0 < chance)
    return drawn.select(F.col(lang).alias("lang"), F.substring(F.col(text), place, F.lit(chunk)).alias("snippet"), h.alias("h")).orderBy("h", "snippet").limit(sample_rows).select("lang", "snippet").toPandas()


class Identifier:
    """Trained parameters and the languages learned."""

    def __init__(self, docs: DataFrame, key="doc_id", text="text", lang="lang", sample_rows: int = 6000, **how):
        rows = sample(docs, key, text, lang, sample_rows)
        self.languages = sorted(set(rows["lang"]))
        number = {x: i for i, x in enumerate(self.languages)}
        self.weights = fit([s.encode() for s in rows["snippet"]], [number[x] for x in rows["lang"]], max(1, len(self.languages)), **how)

    def label(self, docs: DataFrame, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
        """docs with the predicted language and its pooled probability."""
        import pyarrow as pa

        sent = docs.sparkSession.sparkContext.broadcast((self.weights, self.languages))
        names = docs.columns
        at = names.index(text)

        def run(batches):
            weights, languages = sent.value
            for b in batches:
                texts = b.column(at).to_pylist()
                read = [t.encode("utf-8", "surrogatepass") if t and languages and any(map(str.isalpha, t)) else b"" for t in texts]
                best, sure = np.zeros(len(read), int), np.zeros(len(read))
                i = 0
                while i < len(read):  # runs of texts of a few MB
                    j, size = i, 0
                    while j < len(read) and (j == i or size + len(read[j]) <= 2_000_000):
                        size += len(read[j])
                        j += 1
                    p = probabilities(weights, read[i:j]) if size else np.zeros((j - i, 1))
                    best[i:j], sure[i:j] = p.argmax(1), p.max(1)
                    i = j
                said = [languages[k] if t else UNKNOWN for k, t in zip(best, read)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(np.clip(sure, 0, 1))], names=[*names, pred, score])

        return lean(docs).mapInArrow(run, StructType([*docs.schema.fields]).add(pred, "string").add(score, "double"))


def identify(docs: DataFrame, held_out=None, key="doc_id", text="text", lang="lang", **how) -> DataFrame:
    """Per document: key, held_out, lang_pred, score. Labels of rows that are held out are never read."""
    out = F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False))
    model = Identifier(docs.filter(~out), key, text, lang, **how)
    d = docs.select(F.col(key), out.alias("held_out"), F.col(text).alias("__text"))
    return model.label(d, "__text").drop("__text")
