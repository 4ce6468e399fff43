"""Sharding by minimax contiguous partition.

Rows with equal texts are one atomic group. Groups stand in the order of the text's SHA-256, which
spreads sizes evenly and needs no sort to compare. The smallest capacity at which `shards`
contiguous runs of groups suffice is found by binary search, each candidate checked greedily (a
shard takes groups until the next would not fit); the cuts are made there.

The greedy check looks up prefix sums. Those of all groups are never gathered: the driver holds sums
by hash prefix (a fixed number) and refines only the prefixes in which cuts of capacities still in
question fall, down to single groups, so the result is exact.

Laws: `bytes` (sizes near equal, groups whole) is this partition by size; `rows` deals rows so that
counts differ by one at most; `key` places by key and shard count alone (highest random weight; one
more shard takes rows only into itself).

Defined cases: a null text has no bytes, size 8, and null texts are one group apart from empty ones;
very long texts are groups like any other, and a shard's least capacity; repeated rows and rows with null or tied keys
stay rows, with slots of their own; with fewer groups than shards, shards stay empty; an empty table gives none; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import stage

OVERHEAD = 8
#: Hex digits by which group sums are refined, step by step; the last is the whole digest.
STEPS = (3, 6, 64)
NULL_GROUP = "-" * 64  # sorts before every digest


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(NULL_GROUP)).otherwise(F.sha2(F.col(text), 256)).alias("group"),
    )


class Sums:
    """Prefix sums over ordered groups, known by pieces: (first group's prefix, start, end, whether one group)."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = self._read(groups, STEPS[0])
        self.pieces, at = [], 0
        for name, n, of in rows:
            self.pieces.append((name, at, at + n, of == 1, 0))
            at += n
        self.total = at

    @staticmethod
    def _read(groups: DataFrame, digits: int):
        g = groups.groupBy(F.substring("group", 1, digits).alias("p")).agg(F.sum("size").alias("n"), F.count("*").alias("of"))
        return sorted((r["p"], r["n"], r["of"]) for r in g.collect())

    def starts(self) -> list[int]:
        return [p[1] for p in self.pieces]

    def refine(self, which: set[int]) -> bool:
        """Splits the pieces with these indices by their next step; False if none could be split."""
        which = {i for i in which if not self.pieces[i][3]}
        for step in sorted({self.pieces[i][4] for i in which}):
            names = [self.pieces[i][0] for i in which if self.pieces[i][4] == step]
            part = self.groups.filter(F.substring("group", 1, STEPS[step]).isin(names))
            fine: dict[str, list] = {}
            for name, n, of in self._read(part, STEPS[step + 1]):
                fine.setdefault(name[: STEPS[step]], []).append((name, n, of))
            pieces = []
            for name, a, b, one, at in self.pieces:
                if at == step and name in fine and not one:
                    for x, n, of in fine[name]:
                        pieces.append((x, a, a + n, of == 1, step + 1))
                        a += n
                else:
                    pieces.append((name, a, b, one, at))
            self.pieces = pieces
        return bool(which)


def _cuts(sums: Sums, starts: list[int], capacity: int, shards: int, hopeful: bool):
    """Greedy cuts. A cut inside a piece not yet split is taken at the target (hopeful) or at the piece's start.
    Returns the cuts, the pieces that cuts fall in, and whether `shards` shards suffice."""
    at, cuts, inside = 0, [], set()
    for _ in range(shards):
        goal = at + capacity
        if goal >= sums.total:
            return cuts, inside, True
        i = bisect_right(starts, goal) - 1
        name, a, b, one, _ = sums.pieces[i]
        if one or goal == a:
            to = a
        else:
            inside.add(i)
            to = goal if hopeful else max(a, at)
        if to <= at and not hopeful:
            return cuts, inside, False
        if to <= at:
            return cuts, inside, False
        at = to
        cuts.append(at)
    return cuts, inside, False


def minimax(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(group, size), a row for each group: the smallest capacity, and the first group of each shard but the first."""
    sums = Sums(groups)
    if not sums.total:
        return 0, []
    low, high = -(-sums.total // shards), sums.total  # the answer is in low..high
    while True:
        starts = sums.starts()
        a, b = low, high  # smallest capacity that hopeful cuts allow: no smaller one is feasible
        while a < b:
            m = (a + b) // 2
            if _cuts(sums, starts, m, shards, True)[2]:
                b = m
            else:
                a = m + 1
        low = a
        a, b = low, high  # a capacity known to be feasible
        while a < b:
            m = (a + b) // 2
            if _cuts(sums, starts, m, shards, False)[2]:
                b = m
            else:
                a = m + 1
        high = a
        touched: set[int] = set()
        for capacity in {low, high, (low + high) // 2}:
            h, x, _ = _cuts(sums, starts, capacity, shards, True)
            p, y, _ = _cuts(sums, starts, capacity, shards, False)
            touched |= x | y
            if capacity in (low, high):
                for u, v in zip(p, h):  # between the two lies the true cut
                    i, j = bisect_right(starts, u) - 1, bisect_right(starts, v) - 1
                    if j - i <= 64:
                        touched |= set(range(i, j + 1))
        if low == high and not _cuts(sums, starts, low, shards, False)[1]:
            break
        if not sums.refine(touched):
            if low == high:
                break
            raise RuntimeError("no piece left to split")
    starts = sums.starts()
    cuts = _cuts(sums, starts, low, shards, False)[0]
    return low, [sums.pieces[bisect_right(starts, c) - 1][0] for c in cuts]


def _bucket(digits: int):
    return F.substring("group", 1, digits)


def _with_slots(d: DataFrame, key: str) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: numbers within a bucket, after the counts of the buckets before it."""
    d = d.withColumn("__b", _bucket(3)).withColumn("__s", F.pmod(F.xxhash64(key, "group"), F.lit(16)).cast("int"))
    n = d.groupBy("shard", "__b", "__s").agg(F.count("*").alias("n"))  # at most 4,098 x 16 rows and 16 for each cut
    before = Window.partitionBy("shard").orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.broadcast(stage(n.select("shard", "__b", "__s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o")), "slots"))
    order = Window.partitionBy("shard", "__b", "__s").orderBy("group", F.col(key).asc_nulls_first())
    out = d.join(offset, ["shard", "__b", "__s"]).withColumn("slot", F.col("__o") + F.row_number().over(order) - 1)
    return out.drop("__b", "__s", "__o")


def _heaviest(key: str, shards: int):
    """Highest random weight: depends on the key and the number of shards alone."""
    weights = [F.struct(F.xxhash64(F.col(key), F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*weights) if shards > 1 else weights[0])["s"]


def assign(docs: DataFrame, shards: int = 24, law: str = "bytes", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard)."""
    d = stage(sized(docs, key, text), "sized")
    grown = F.lit(None).cast("int")
    if law == "bytes":
        groups = stage(d.groupBy("group").agg(F.sum("size").alias("size")), "groups")
        _, firsts = minimax(groups, shards)
        past = [(F.col("group") >= F.rpad(F.lit(g), 64, " ")).cast("int") for g in firsts]
        shard = sum(past[1:], past[0]) if past else F.lit(0)
    elif law == "rows":
        shard = F.lit(0)
    elif law == "key":
        shard, grown = _heaviest(key, shards), _heaviest(key, shards + 1)
    else:
        raise ValueError(f"no such law: {law}")
    d = _with_slots(d.withColumn("shard", shard.cast("int")).withColumn("grown_shard", grown.cast("int")), key)
    if law == "rows":
        d = d.withColumn("shard", (F.col("slot") % shards).cast("int")).withColumn("slot", F.floor(F.col("slot") / shards))
    return d.select(key, "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
