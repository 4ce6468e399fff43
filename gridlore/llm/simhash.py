"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most 3 are cut into two segments of 32, of which
one then differs in at most one bit. Each fingerprint is indexed under every variant of a segment
with one bit wildcarded (2 x 32 keys); fingerprints that share a key are candidates, and their
distance is verified.

Equal fingerprints are one node, however many documents have them. A key's fingerprints are
streamed from a sort; of a group, only a forest of its verified links is emitted (never all
pairs), which keeps every connection. A group of more than `group_limit` fingerprints is not held:
it goes to a next round under longer keys, whose other segment is cut and wildcarded in the same
way, until the fixed bits themselves bound the group. Components come from large-star and small-star
rounds over the links.

Defined cases: null, empty and wordless texts have fingerprint 0 and are linked like any other;
very long texts are read whole; repeated rows stay rows; a null doc_id takes part, but is no component's id unless it
is the only one; ties go to the least key; an empty table gives an empty result; other columns ride along in
`representatives`, whatever their names (working columns start with `__simhash_`), and are not read elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.llm.common import lean, stage

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Rows of a slim table for each task and file that writes it. Hadoop's local file system starts three processes for every file.
ROWS_A_FILE = 50_000
#: Rows that near copies lose up to which they are broadcast; the texts are then not shuffled.
FEW_ROWS = 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats counted; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if isinstance(text, str) else []
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(flat)]
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[i : i + step], stops[i : i + step])), np.uint64, min(step, n - i))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep=("doc_id",), name: str = "fp") -> DataFrame:
    """The columns to keep and the fingerprint as a signed long."""
    keep = list(keep)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*keep, name])

    schema = StructType([*docs.select(*keep).schema.fields]).add(name, "long")
    return lean(docs).select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


#: A level fixes a segment but for one wildcard: (level, low bit, bits) of the segments it chooses from, given the one before.
def _segments(free: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cuts the widest free run of bits in two."""
    low, bits = max(free, key=lambda x: x[1])
    return [(low, bits // 2), (low + bits // 2, bits - bits // 2)]


def _masks(free: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
    """For a run of bits: (mask of what a variant fixes in it, the run left free), one for each segment and wildcard."""
    a, b = _segments([free])
    out = []
    for (low, bits), other in ((a, b), (b, a)):
        run = ((1 << bits) - 1) << low
        out += [(run & ~(1 << p), other) for p in range(low, low + bits)]
    return out


def _pairs(fps: np.ndarray, distance: int, block: int = 1024):
    """All (i, j), i < j, of fps within distance, in blocks."""
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block]) <= distance
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            yield a[a < b], b[a < b]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within fps."""
    if len(fps) == 2:
        return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= distance else []
    f, out = Forest(len(fps)), []
    for a, b in _pairs(fps, distance):
        out += [(x, y) for x, y in zip(a.tolist(), b.tolist()) if f.join(x, y)]
    return out


def _files(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_FILE))


def links(fps: DataFrame, distance: int = DISTANCE, group_limit: int = 4096, name: str = "fp") -> DataFrame:
    """Distinct fingerprints (long) to links (a, b) that connect all within distance: every pair's ends are connected."""
    if distance != DISTANCE:
        raise ValueError("two segments with one wildcard serve a distance of 3")
    found, todo, free, rounds = None, fps.select(F.col(name).alias("fp"), F.lit("").alias("path")), {"": (0, 64)}, 0
    while True:
        keyed = _variants(todo, free)
        out = stage(_match(keyed, distance, group_limit if rounds < 3 else 1 << 62).repartition(_files(todo.count())), "simhash-links")
        part = out.filter("path is null").select("a", "b")
        found = part if found is None else found.unionByName(part)
        rounds += 1
        over = out.filter("path is not null").select(F.col("a").alias("fp"), "path")
        if rounds > 3 or over.isEmpty():
            return found
        free = {}
        for r in over.select(F.substring_index("path", ":", 1).alias("run")).distinct().collect():  # runs of bits: at most a few
            low, bits = map(int, r["run"].split("-"))
            free[r["run"]] = (low, bits)
        todo = over


def _variants(todo: DataFrame, free: dict[str, tuple[int, int]]) -> DataFrame:
    """(fp, path) to (fp, key, run): the path names the run of bits still free and the group so far."""

    def keys(run):
        return F.array(*(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bits"), F.lit(f"{o[0]}-{o[1]}").alias("run")) for n, (mask, o) in enumerate(_masks(run))))

    x = None
    for run, at in free.items():
        x = keys(at) if x is None else F.when(F.substring_index("path", ":", 1) == run, keys(at)).otherwise(x)
    v = todo.select("fp", "path", F.explode(x).alias("v"))
    return v.select("fp", F.xxhash64("path", "v.n", "v.bits").alias("key"), F.col("v.n").cast("int").alias("n"), "v.run")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _match(keyed: DataFrame, distance: int, limit: int) -> DataFrame:
    """Groups by key: links (a, b, null), or for a group of more than limit its rows (fp, null, path). A clash of keys only adds candidates."""

    def run(batches):
        held, held_run, held_key, over = np.zeros(0, np.uint64), "", None, False
        a_out, b_out, p_out = [], [], []

        def close(fps, key, run, big):
            if big:
                a_out.append(fps), b_out.append(np.zeros(len(fps), np.uint64)), p_out.append(np.full(len(fps), f"{run}:{key}", object))
            elif len(fps) > 1:
                fps = np.unique(fps)
                if found := _links(fps, distance):
                    i, j = np.array(found).T
                    a_out.append(fps[i]), b_out.append(fps[j]), p_out.append(np.full(len(i), None, object))

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out).view(np.int64)), pa.array(np.concatenate(b_out).view(np.int64)), pa.array(np.concatenate(p_out), pa.string())], names=["a", "b", "path"])
            a_out.clear(), b_out.clear(), p_out.clear()
            return got

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = np.flatnonzero(np.diff(key)) + 1
            first = np.concatenate(([0], cut))
            last = np.concatenate((cut, [len(key)]))
            several = np.flatnonzero(last - first > 1)
            ends = {0, len(first) - 1}
            for g in sorted(ends.union(several.tolist())):
                i, j = int(first[g]), int(last[g])
                if g == 0 and held_key == key[0]:
                    held = np.concatenate((held, fp[i:j]))
                elif g == 0:
                    close(held, held_key, held_run, over)
                    held, held_key, held_run, over = fp[i:j], key[i], batch.column(3)[i].as_py(), False
                elif g == len(first) - 1:
                    close(held, held_key, held_run, over)
                    held, held_key, held_run, over = fp[i:j], key[i], batch.column(3)[i].as_py(), False
                else:
                    close(fp[i:j], key[i], batch.column(3)[i].as_py() if j - i > limit else "", j - i > limit)
                if g in ends and (over or len(held) > limit):
                    close(held, held_key, held_run, True)
                    held, over = held[:0], True
            if a_out:
                yield flush()
        close(held, held_key, held_run, over)
        if a_out:
            yield flush()

    s = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return s.mapInArrow(run, "a long, b long, path string")


#: Edges for each task and file of a round: few edges are not spread over many tiny files.
EDGES_A_FILE = 200_000


def components(edges: DataFrame, max_rounds: int = 60, first_files: int | None = None) -> DataFrame:
    """Undirected edges (a, b) to (node, root), root the least node of its component; only nodes that have an edge.

    Large-star and small-star in turn, until nothing changes. Each round's edges are written to the shared folder, the
    first at most to first_files files."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    e = stage(e.coalesce(first_files) if first_files else e, "edges")
    before, files = None, -(-e.count() // EDGES_A_FILE) or 1  # rounds never have more edges than they began with
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        e = stage(small.coalesce(files), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def _by_fingerprint(f: DataFrame, key: str, group_limit: int) -> DataFrame:
    """Rows (key, fp, ...) to (fp, component_id), a row for each fingerprint."""
    files = _files(f.count())
    nodes = stage(f.groupBy("fp").agg(F.min(key).alias("least")).coalesce(files), "simhash-nodes")
    roots = components(links(nodes, group_limit=group_limit), first_files=files)
    linked = stage(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least"), "simhash-roots")
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    changed = linked.join(best, "root").select(F.col("node").alias("fp"), "component", "root")
    return nodes.join(changed, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", group_limit: int = 4096) -> DataFrame:
    """(key, fingerprint in hex, component_id: the least key reachable over links)."""
    f = stage(fingerprints(docs, text, [key]), "fingerprints")
    by_fp = _by_fingerprint(f, key, group_limit).drop("root")
    return f.join(by_fp, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", group_limit: int = 4096) -> DataFrame:
    """The rows of docs with the least key of each component: one row, also where rows repeat; rows without a key only if alone."""
    f = stage(fingerprints(docs, text, docs.columns, "__simhash_fp").withColumn("__simhash_row", F.monotonically_increasing_id()), "fingerprinted")
    slim = f.select(F.col(key), F.col("__simhash_fp").alias("fp"), F.col("__simhash_row"))
    roots = _by_fingerprint(slim, key, group_limit).select("fp", "root")
    first = slim.join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), F.col(key), F.col("__simhash_row"))).alias("first"))
    rows = f.count()
    kept = stage(first.select(F.col("first.__simhash_row").alias("__simhash_row")).coalesce(_files(rows)), "simhash-kept")
    if rows - kept.count() <= FEW_ROWS:
        lost = slim.select("__simhash_row").join(kept, "__simhash_row", "left_anti")
        out = f.join(F.broadcast(lost), "__simhash_row", "left_anti")
    else:
        out = f.join(kept, "__simhash_row", "left_semi")
    return out.drop("__simhash_fp", "__simhash_row")
