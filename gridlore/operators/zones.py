"""Connected zones of equal level, their size and distance matrices, and components in general.

Zones of a region are found where its voxels meet in one task (union of neighbours in numpy). Regions of more than
TASK_VOXELS are counted out first and take another way: zones by min-label rounds over an edge table, checkpointed, and
depths by running minima along the lines of each axis, so no task holds more than a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.voxels import AXES, half_offsets, pairs
from gridlore.operators.texture import matrix_features


def label_zones(at: np.ndarray, g: np.ndarray, offsets) -> np.ndarray:
    """A zone number for each voxel (rows of coordinates): neighbours of the same level share it."""
    n = len(at)
    low = at.min(0) - 1
    shape = at.max(0) - low + 2
    flat = np.ravel_multi_index((at - low).T, shape)
    order = np.argsort(flat)
    edges = []
    for o in offsets:
        want = flat + int(np.dot(o, [shape[1] * shape[2], shape[2], 1]))
        k = np.minimum(np.searchsorted(flat, want, sorter=order), n - 1)
        other = order[k]
        ok = (flat[other] == want) & (g[other] == g)
        edges.append(np.stack([np.flatnonzero(ok), other[ok]], 1))
    e = np.concatenate(edges)
    label = np.arange(n)
    while True:  # hooking to the lesser root, then pointer jumping
        a, b = label[e[:, 0]], label[e[:, 1]]
        far = a != b
        if not far.any():
            return label
        a, b, e = a[far], b[far], e[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def taxicab_depth(at: np.ndarray) -> np.ndarray:
    """Steps along the axes from each voxel to the nearest place outside the set; 1 at its border."""
    low = at.min(0) - 1
    grid = np.zeros(at.max(0) - low + 2, np.int32)
    spot = tuple((at - low).T)
    grid[spot] = np.iinfo(np.int32).max // 2
    for axis in range(grid.ndim):
        g = np.moveaxis(grid, axis, 0)
        for k in range(1, len(g)):
            np.minimum(g[k], g[k - 1] + 1, out=g[k])
        for k in range(len(g) - 2, -1, -1):
            np.minimum(g[k], g[k + 1] + 1, out=g[k])
    return grid[spot]


def zones(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None, depth_of: DataFrame | None = None, batches: int | None = None) -> DataFrame:
    """(keys, zone, i: level, size, depth: least distance to the border). depth_of: another mask (keys, z, y, x) to take the distance in.
    flat_axis: zones stay in slices across that axis. batches: many small regions (windows) share a task's call; they are set apart along z."""
    keys = list(keys)
    offsets = half_offsets(ndim, flat_axis)
    flat = 0 if ndim == 2 else flat_axis
    rows = v.select(*keys, *AXES, "g")
    if depth_of is not None:
        both = depth_of.select(*keys, *AXES).withColumn("g0", F.lit(0))
        rows = rows.join(both, [*keys, *AXES], "full").withColumn("g", F.coalesce("g", F.lit(0))).drop("g0")

    def depths(at):
        if flat is None:
            return taxicab_depth(at)
        out, rest = np.zeros(len(at), np.int32), [a for a in range(3) if a != flat]
        for s in np.unique(at[:, flat]):
            here = at[:, flat] == s
            out[here] = taxicab_depth(at[here][:, rest])
        return out

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, g = pdf[list(AXES)].to_numpy(np.int64), pdf["g"].to_numpy(np.int64)
        if batches:
            region = pdf.groupby(keys, sort=False).ngroup().to_numpy()
            low = np.full((region.max() + 1, 3), np.iinfo(np.int64).max)
            np.minimum.at(low, region, at)
            at = at - low[region]
            at[:, 0] += region * (at[:, 0].max() + 3)
        depth = depths(at)
        inside = g > 0
        if not inside.any():
            return pdf[keys].head(0).assign(zone=0, i=0, size=0, depth=0)
        at, g, depth = at[inside], g[inside], depth[inside]
        label = label_zones(at, g, offsets)
        z = pd.DataFrame({"zone": label, "i": g, "d": depth}).groupby("zone", as_index=False).agg(i=("i", "first"), size=("i", "size"), depth=("d", "min"))
        first = pdf.loc[inside, keys].iloc[z["zone"].to_numpy()].reset_index(drop=True)  # a zone's number is a voxel of it
        return pd.concat([first, z], axis=1)[[*keys, "zone", "i", "size", "depth"]]

    schema = StructType([v.schema[k] for k in keys]).add("zone", "long").add("i", "long").add("size", "long").add("depth", "long")
    by = [F.pmod(F.xxhash64(*keys), F.lit(batches)).alias("batch")] if batches else keys
    return rows.groupBy(*by).applyInPandas(solve, schema)


#: Voxels that a task may be given of one region.
TASK_VOXELS = 20_000_000


def zones_of_any_size(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None, depth_of: DataFrame | None = None, batches: int | None = None, limit: int | None = None) -> DataFrame:
    """(keys, i, size, depth) by the way that a region's size asks for. Windows (batches) are small by their nature."""
    keys, limit, names = list(keys), limit or TASK_VOXELS, ("i", "size", "depth")
    large = None if batches else v.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*keys)
    if large is None or large.isEmpty():
        return zones(v, keys, ndim, flat_axis, depth_of, batches).select(*keys, *names)
    large = large.checkpoint()
    part = lambda df, how: None if df is None else df.join(large, keys, how)
    rest = zones(part(v, "left_anti"), keys, ndim, flat_axis, part(depth_of, "left_anti")).select(*keys, *names)
    return rest.unionByName(zones_distributed(part(v, "left_semi"), keys, ndim, flat_axis, part(depth_of, "left_semi")).select(*keys, F.col("i").cast("long").alias("i"), "size", "depth"))


def glszm(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None, batches: int | None = None, limit: int | None = None) -> DataFrame:
    m = zones_of_any_size(v, keys, ndim, flat_axis, batches=batches, limit=limit).groupBy(*keys, "i", F.col("size").alias("j")).agg(F.count("*").alias("n"))
    return matrix_features(m, keys, "glszm")


def gldzm(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None, depth_of: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    m = zones_of_any_size(v, keys, ndim, flat_axis, depth_of, limit=limit).groupBy(*keys, "i", F.col("depth").alias("j")).agg(F.count("*").alias("n"), F.sum("size").alias("voxels"))
    return matrix_features(m, keys, "gldzm", F.col("voxels"))


def depths_distributed(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None) -> DataFrame:
    """(keys, z, y, x, depth): steps along the axes to the nearest place outside. The distance parts by axis: along every line the
    least of what is known at a place and the steps to it, from either side."""
    keys, still = list(keys), 0 if ndim == 2 else flat_axis
    box = v.groupBy(*keys).agg(*(f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    for k, a in enumerate(AXES):
        pad = 0 if k == still else 1
        box = box.withColumn(a, F.explode(F.sequence(F.col(f"lo{a}") - pad, F.col(f"hi{a}") + pad)))
    at = [*keys, *AXES]
    d = box.select(*at).join(v.select(*at, F.lit(1 << 30).alias("depth")), at, "left").select(*at, F.coalesce("depth", F.lit(0)).alias("depth"))
    for k, a in enumerate(AXES):
        if k != still:
            line = Window.partitionBy(*keys, *(c for c in AXES if c != a))
            up, down = (line.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(a), F.desc(a)))
            d = d.withColumn("depth", F.least(F.min(F.col("depth") - F.col(a)).over(up) + F.col(a), F.min(F.col("depth") + F.col(a)).over(down) - F.col(a)))
    return d.join(v.select(*at), at, "left_semi")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 200) -> DataFrame:
    """edges (a, b), nodes (node): (node, root), root the least node reachable. Least labels spread and jump until none changes;
    each round is checkpointed to the shared folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = nodes.select("node", F.col("node").alias("root")).checkpoint()
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("m"))
        hooked = label.join(near, label["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        now = hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")).checkpoint()
        changed = now.filter(F.col("old") != F.col("root")).limit(1).count()
        label = now.select("node", "root")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def zones_distributed(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None, depth_of: DataFrame | None = None) -> DataFrame:
    """(keys, zone, i, size, depth) for regions beyond a task's memory: the zone's name is its least (keys, z, y, x)."""
    keys = list(keys)
    node = lambda *c: F.concat_ws("/", *(F.lpad(F.col(x).cast("string"), 10, "0") for x in c))
    p = pairs(v, keys, half_offsets(ndim, flat_axis)).filter("g1 = g2")
    e = p.select(node(*keys, "z1", "y1", "x1").alias("a"), node(*keys, *AXES).alias("b"))
    mask = v.select(*keys, *AXES) if depth_of is None else depth_of.select(*keys, *AXES).unionByName(v.select(*keys, *AXES)).distinct()
    rows = v.select(*keys, *AXES, "g").join(depths_distributed(mask, keys, ndim, flat_axis), [*keys, *AXES])
    rows = rows.select(*keys, node(*keys, *AXES).alias("node"), F.col("g").alias("i"), "depth")
    zone = rows.join(components(e, rows.select("node")), "node").groupBy(*keys, F.col("root").alias("zone"), "i")
    return zone.agg(F.count("*").alias("size"), F.min("depth").cast("long").alias("depth"))
