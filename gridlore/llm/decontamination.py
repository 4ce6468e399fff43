"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document. A shard covers a run of whole documents of about
`shard_words` words (one longer document is a shard of its own) and stores, for each term of
the query vocabulary that it holds, the sorted positions of the term. Shards are the rows of
a table in the shared folder. A query reads corpus-wide term counts off the index, orders each
phrase's terms from the rarest, and intersects offset-adjusted position lists shard by shard:
no posting is shuffled, whatever a term's frequency.

Queries (benchmark items) are the stated query set; they are sent to the executors in blocks of
at most `block_words` words, a pass over the index for each block.

Defined cases: null, empty and wordless texts have no words, no hits; items without words are
ignored; items sharing an item_id count once; a null item_id is written as an empty string;
very long documents are one shard of their own; repeated rows of documents, and rows with tied or
null keys, are reported one by one; empty tables give no rows or no hits; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import lean, stage

#: Every ASCII character that is no letter or digit parts words; A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WINDOW = 13


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if isinstance(text, str) else []


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """All runs of `size` words; of fewer words, the one run of all."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


INDEX = "shard string, doc_key array<string>, doc_words array<int>, terms array<int>, counts array<int>, positions binary"


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text", shard_words: int = 400_000) -> DataFrame:
    """The index of docs for the vocabulary (term to number), a row for each shard; positions are int32, term after term."""
    names = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def shards(batches):
        get = names.value.get
        keys, lengths, ids, held = [], [], [], 0
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"]):
                w = words_of(t)
                if keys and held + len(w) > shard_words:
                    yield _shard(keys, lengths, ids)
                    keys, lengths, ids, held = [], [], [], 0
                keys.append(k)
                lengths.append(len(w))
                ids.append(np.fromiter((get(x, -1) for x in w), np.int32, len(w)))
                held += len(w)
        if keys:
            yield _shard(keys, lengths, ids)

    return lean(docs).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(shards, INDEX)


def _shard(keys, lengths, ids) -> pd.DataFrame:
    at = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    known = np.flatnonzero(at >= 0).astype(np.int32)
    known = known[np.argsort(at[known], kind="stable")]
    terms, counts = np.unique(at[known], return_counts=True)
    return pd.DataFrame({"shard": [uuid.uuid4().hex], "doc_key": [keys], "doc_words": [lengths], "terms": [terms], "counts": [counts.astype(np.int32)], "positions": [known.tobytes()]})


def term_counts(index: DataFrame) -> dict[int, int]:
    """Corpus-wide counts of the vocabulary's terms; at most a row for each of its terms."""
    t = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    return {r["terms"]: r["n"] for r in t.collect()}


class Postings:
    """A shard's lists, and the word count before each document."""

    def __init__(self, terms, counts, positions: bytes, doc_words):
        ends = np.cumsum(np.asarray(counts, np.int64))
        flat = np.frombuffer(positions, np.int32)
        self.lists = {int(t): flat[e - c : e] for t, c, e in zip(terms, counts, ends)}
        self.ends = np.cumsum(np.asarray(doc_words, np.int64))
        self.none = flat[:0]

    def phrase(self, terms, order) -> np.ndarray:
        """Start positions of the exact phrase within one document. order: places of terms, the rarest first."""
        start = None
        for o in order:
            here = self.lists.get(terms[o], self.none)
            if start is None:
                start = here.astype(np.int64) - o
                start = start[start >= 0]
            elif len(here):
                want = start + o
                at = np.searchsorted(here, want)
                start = start[here[np.minimum(at, len(here) - 1)] == want]
            else:
                return np.zeros(0, np.int64)
            if not len(start):
                return start
        doc = np.searchsorted(self.ends, start, "right")
        return start[self.ends[doc] >= start + len(terms)]

    def near(self, terms, order, slop: int) -> np.ndarray:
        """Positions of the rarest term around which each of the terms occurs within `slop` words, in the same document."""
        base = self.lists.get(terms[order[0]], self.none).astype(np.int64)
        doc = np.searchsorted(self.ends, base, "right")
        low = np.maximum(base - slop, np.where(doc > 0, self.ends[doc - 1], 0)) if len(base) else base
        high = np.minimum(base + slop, self.ends[doc] - 1) if len(base) else base
        for o in order[1:]:
            here = self.lists.get(terms[o], self.none)
            keep = np.searchsorted(here, high, "right") > np.searchsorted(here, low, "left")
            base, low, high = base[keep], low[keep], high[keep]
            if not len(base):
                break
        return base


def _search(index: DataFrame, phrases: list[tuple], counts: dict[int, int], slop: int | None) -> DataFrame:
    """phrases: (terms, items). Rows: every document by shard and place in it, the spans hit (start and end in words) and the items."""
    by_rarest: dict[int, list] = {}
    for t, owners in phrases:
        if all(x in counts for x in t):
            order = sorted(range(len(t)), key=lambda o: (counts.get(t[o], 0), o))
            by_rarest.setdefault(t[order[0]], []).append((t, order, owners))
    ready = index.sparkSession.sparkContext.broadcast(by_rarest)

    def run(batches):
        for pdf in batches:
            for shard, keys, lengths, terms, n, positions in zip(*(pdf[c] for c in ("shard", "doc_key", "doc_words", "terms", "counts", "positions"))):
                p = Postings(terms, n, positions, lengths)
                spans: dict[int, set] = {}
                items: dict[int, set] = {}
                # Only phrases whose rarest term this shard has.
                for t, order, owners in (x for term in p.lists.keys() & ready.value.keys() for x in ready.value[term]):
                    found = p.phrase(t, order) if slop is None else p.near(t, order, slop)
                    if len(found):
                        docs = np.searchsorted(p.ends, found, "right")
                        for d in np.unique(docs).tolist():
                            items.setdefault(d, set()).update(owners)
                        before = np.where(docs > 0, p.ends[docs - 1], 0)
                        for d, s in zip(docs.tolist(), (found - before).tolist()):
                            spans.setdefault(d, set()).add((s, s + (len(t) if slop is None else 1)))
                merged = [merged_spans(spans.get(d, ())) for d in range(len(keys))]
                yield pd.DataFrame({
                    "shard": shard, "place": np.arange(len(keys), dtype=np.int32), "doc_key": keys, "n_words": np.asarray(lengths, np.int64),
                    "n_hit": np.array([sum(b - a for a, b in m) for m in merged], np.int64),
                    "starts": [[a for a, _ in m] for m in merged], "ends": [[b for _, b in m] for m in merged],
                    "items": [sorted(items.get(d, ())) for d in range(len(keys))],
                })

    return index.select("shard", "doc_key", "doc_words", "terms", "counts", "positions").mapInPandas(run, FOUND)


FOUND = "shard string, place int, doc_key string, n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>"


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item: str, text: str, block_words: int):
    """The query set in blocks of bounded size, streamed to the driver."""
    block, n = [], 0
    for r in items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if w := words_of(r["t"]):
            if block and n + len(w) > block_words:
                yield block
                block, n = [], 0
            block.append((r["i"], w))
            n += len(w)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item="item_id", item_text="text", window: int = WINDOW, slop: int | None = None, block_words: int = 2_000_000) -> DataFrame:
    """A row for each document: doc_key, n_words, n_hit, starts and ends of the hit spans in words, items (ids, as sorted strings).

    slop None: exact occurrences of the items' windows. Else proximity: places of a window's rarest word with
    all its words within slop words on either side."""
    names: set[bytes] = set()
    for block in _blocks(items, item, item_text, block_words):
        names.update(*(ws for _, ws in block))
    vocabulary = {w: n for n, w in enumerate(sorted(names))}
    index = stage(build_index(docs, vocabulary, key, text), "positions")
    counts = term_counts(index)
    found = []
    for block in _blocks(items, item, item_text, block_words):
        owners: dict[tuple, set] = {}
        for i, ws in block:
            for w in windows_of([vocabulary[x] for x in ws], window):
                owners.setdefault(w, set()).add(i)
        found.append(_search(index, sorted((t, sorted(o)) for t, o in owners.items()), counts, slop))
    if len(found) < 2:
        rows = found[0] if found else _search(index, [], counts, slop)
    else:
        rows = _united(found)
    return rows.drop("shard", "place")


def _united(found: list[DataFrame]) -> DataFrame:
    """Hits of several blocks of items, put together by document."""
    rows = found[0]
    for r in found[1:]:
        rows = rows.unionByName(r)

    def merge(batches):
        for pdf in batches:
            spans = [merged_spans(zip(a, b)) for a, b in zip(pdf["starts"], pdf["ends"])]
            yield pdf.assign(starts=[[a for a, _ in m] for m in spans], ends=[[b for _, b in m] for m in spans], n_hit=[sum(b - a for a, b in m) for m in spans])

    both = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  a list for each block
    g = rows.groupBy("shard", "place", "doc_key", "n_words").agg(F.lit(0).cast("long").alias("n_hit"), both("starts").alias("starts"), both("ends").alias("ends"), F.array_sort(F.array_distinct(both("items"))).alias("items"))
    return g.select(*rows.columns).mapInPandas(merge, FOUND)


def scan(docs: DataFrame, items: DataFrame, key: str = "doc_id", min_share: int = 20, **how) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and one word of min_share, or more, hit)."""
    r = search(docs, items, key=key, **how)
    return r.select(
        F.col("doc_key").cast(docs.schema[key].dataType).alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))).alias("contaminated"),
    )
