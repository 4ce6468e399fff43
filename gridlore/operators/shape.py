"""Morphology of regions: moments by aggregation, surfaces and hulls by grouped numpy.

The surface passes half-way between inside and outside voxels. What it looks like in a cell of 8 voxel centres (or 4 in a
plane) follows from a rule, not a table: on each face, the edges that it crosses are joined in pairs, around a single
inside corner where that is ambiguous; the segments of all faces close to loops, which are cut into triangles.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from numpy.polynomial.legendre import legval
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.voxels import AXES

#: Names of the features, in their order.
SHAPE = (
    "MeshVolume", "VoxelVolume", "SurfaceArea", "SurfaceVolumeRatio", "Sphericity", "Compactness1", "Compactness2", "SphericalDisproportion", "Maximum3DDiameter", "Maximum2DDiameterSlice",
    "Maximum2DDiameterColumn", "Maximum2DDiameterRow", "MajorAxisLength", "MinorAxisLength", "LeastAxisLength", "Elongation", "Flatness", "Asphericity", "CentreOfMassShift",
    "IntegratedIntensity", "VolumeDensityAABB", "AreaDensityAABB", "VolumeDensityAEE", "AreaDensityAEE", "VolumeDensityConvexHull", "AreaDensityConvexHull",
)
SHAPE2D = (
    "MeshSurface", "PixelSurface", "Perimeter", "PerimeterSurfaceRatio", "Sphericity", "SphericalDisproportion", "MaximumDiameter", "MajorAxisLength", "MinorAxisLength", "Elongation",
)

CORNERS = list(product((0, 1), repeat=3))


@lru_cache(maxsize=256)
def cell_triangles(code: int) -> np.ndarray:
    """Triangles (n, 3, 3) of a cell; bit c of code: corner c is inside. Corners at 0 and 1, crossings half-way, normals outward."""
    inside = {c for n, c in enumerate(CORNERS) if code >> n & 1}
    joined: dict[tuple, list] = {}
    for axis in range(3):
        for side in (0, 1):
            a, b = (n for n in range(3) if n != axis)
            ring = []
            for u, w in ((0, 0), (0, 1), (1, 1), (1, 0)):
                c = [0, 0, 0]
                c[axis], c[a], c[b] = side, u, w
                ring.append(tuple(c))
            cuts = [(ring[n], ring[(n + 1) % 4]) for n in range(4) if (ring[n] in inside) != (ring[(n + 1) % 4] in inside)]
            if len(cuts) == 4:  # join the two cuts that share an inside corner
                cuts = [e for c in ring if c in inside for e in cuts if c in e]
            for e, f in zip(cuts[::2], cuts[1::2]):
                e, f = tuple(sorted(e)), tuple(sorted(f))
                joined.setdefault(e, []).append(f)
                joined.setdefault(f, []).append(e)
    out, left = [], set(joined)
    while left:
        loop = [min(left)]
        while True:
            left.discard(loop[-1])
            ahead = [e for e in joined[loop[-1]] if e in left]
            if not ahead:
                break
            loop.append(ahead[0])
        p = np.array([(np.add(*e)) / 2 for e in loop])
        away = sum(np.subtract(*(e if e[1] in inside else e[::-1])) for e in loop)  # from inside to outside
        normal = sum(np.cross(p[n], p[(n + 1) % len(p)]) for n in range(len(p)))
        if normal @ away < 0:
            p = p[::-1]
        out += [(p[0], p[n], p[n + 1]) for n in range(1, len(p) - 1)]
    return np.array(out).reshape(-1, 3, 3)


def mesh(at: np.ndarray, spacing) -> np.ndarray:
    """Triangles of the surface around voxels (rows z, y, x), in mm."""
    low = at.min(0) - 1
    grid = np.zeros(at.max(0) - low + 2, bool)
    grid[tuple((at - low).T)] = True
    code = sum(grid[tuple(slice(c, grid.shape[n] - 1 + c) for n, c in enumerate(corner))].astype(np.int64) << k for k, corner in enumerate(CORNERS))
    out = []
    for c in np.unique(code):
        t = cell_triangles(int(c))
        if len(t):
            base = np.argwhere(code == c) + low
            out.append((base[:, None, None, :] + t[None]).reshape(-1, 3, 3))
    return np.concatenate(out) * np.asarray(spacing, float)


def farthest(p: np.ndarray, block: int = 1024) -> float:
    """Largest distance between points. Only points that end a line along the last axis can be farthest."""
    if len(p) < 2:
        return 0.0
    order = np.lexsort(p.T[::-1])
    p = p[order]
    same = (p[1:, :-1] == p[:-1, :-1]).all(1)
    ends = np.ones(len(p), bool)
    ends[1:-1] = ~(same[1:] & same[:-1])
    p, best = p[ends], 0.0
    for i in range(0, len(p), block):
        d = p[i : i + block, None] - p[None, i:]
        best = max(best, float((d * d).sum(-1).max()))
    return best**0.5


def hull(points: np.ndarray) -> tuple[float, float]:
    """(volume, area) of the convex hull. Points are jogged by a millionth of a millionth so that none are coplanar."""
    p = np.unique(points, axis=0)
    order = np.lexsort(p.T[::-1])
    p = p[order]
    same = (p[1:, :2] == p[:-1, :2]).all(1)
    ends = np.ones(len(p), bool)
    ends[1:-1] = ~(same[1:] & same[:-1])
    p = p[ends]
    p = p + np.random.default_rng(0).uniform(-1, 1, p.shape) * 1e-9 * max(1.0, np.ptp(p))
    if len(p) < 4:
        return float("nan"), float("nan")
    seed = [int(p[:, 0].argmin())]
    seed.append(int(((p - p[seed[0]]) ** 2).sum(1).argmax()))
    seed.append(int((np.cross(p - p[seed[0]], p[seed[1]] - p[seed[0]]) ** 2).sum(1).argmax()))
    n = np.cross(p[seed[1]] - p[seed[0]], p[seed[2]] - p[seed[0]])
    seed.append(int(np.abs((p - p[seed[0]]) @ n).argmax()))
    centre = p[seed].mean(0)

    def facing_out(f):
        f = np.asarray(f)
        a, b, c = p[f[:, 0]], p[f[:, 1]], p[f[:, 2]]
        back = ((a - centre) * np.cross(b - a, c - a)).sum(1) < 0
        f[back] = f[back][:, ::-1]
        return f

    faces = facing_out([(seed[0], seed[1], seed[2]), (seed[0], seed[1], seed[3]), (seed[0], seed[2], seed[3]), (seed[1], seed[2], seed[3])])
    for i in range(len(p)):
        a, b, c = (p[faces[:, k]] for k in range(3))
        seen = ((p[i] - a) * np.cross(b - a, c - a)).sum(1) > 0
        if i in seed or not seen.any():
            continue
        v = faces[seen]
        edges = np.concatenate([v[:, [0, 1]], v[:, [1, 2]], v[:, [2, 0]]])
        pairs = {tuple(e) for e in edges.tolist()}
        rim = [e for e in pairs if e[::-1] not in pairs]
        faces = np.concatenate([faces[~seen], facing_out([(u, w, i) for u, w in rim])])
    a, b, c = (p[faces[:, k]] - centre for k in range(3))
    return float((a * np.cross(b, c)).sum() / 6), float(np.sqrt((np.cross(b - a, c - a) ** 2).sum(1)).sum() / 2)


def ellipsoid_area(axes) -> float:
    """Area of an ellipsoid by semi-axes: exact for spheres and spheroids, else a Legendre series of degree 20."""
    a, b, c = sorted(map(float, axes), reverse=True)
    if not c > 0:
        return float("nan")
    close = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)
    if close(a, b) and close(c, b):
        return 4 * np.pi * a * a
    if close(c, b):  # prolate
        e = np.sqrt(1 - c * c / (a * a))
        return 2 * np.pi * c * c * (1 + a * np.arcsin(e) / (c * e))
    if close(a, b):  # oblate
        e = np.sqrt(1 - c * c / (a * a))
        return 2 * np.pi * a * a * (1 + (1 - e * e) / e * np.arctanh(e))
    u, w = np.sqrt(1 - b * b / (a * a)), np.sqrt(1 - c * c / (a * a))
    n = np.arange(21.0)
    return float(4 * np.pi * a * b * legval((u * u + w * w) / (2 * u * w), (u * w) ** n / (1 - 4 * n * n)))


def moments(v: DataFrame, keys=("roi",), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Count, centres and covariances of a region, by aggregation alone: they hold for regions of any size."""
    at = [F.col(a) * float(s) for a, s in zip(AXES, spacing)]
    return v.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"m{a}") for a, c in zip(AXES, at)), *((F.sum(c * F.col("val")) / F.when(F.sum("val") != 0, F.sum("val"))).alias(f"w{a}") for a, c in zip(AXES, at)),
        *(F.covar_pop(at[i], at[j]).alias(f"c{AXES[i]}{AXES[j]}") for i in range(3) for j in range(i, 3)), F.avg("val").alias("mean"),
    )


def shape(v: DataFrame, keys=("roi",), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """26 features of regions in space. spacing: z, y, x."""
    keys = list(keys)
    space = np.asarray(spacing, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, x = pdf[list(AXES)].to_numpy(np.int64), pdf["val"].to_numpy(float)
        t = mesh(at, space)
        volume = abs(float((t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6))
        area = float(np.sqrt((np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(1)).sum() / 2)
        p = np.unique(np.round(t.reshape(-1, 3) / (space / 2)).astype(np.int64), axis=0)
        across = []
        for axis in range(3):
            parts = [p[p[:, axis] == c] for c in np.unique(p[:, axis])]
            across.append(max(farthest(q * (space / 2)) for q in parts))
        mm = at * space
        least, minor, major = np.maximum(np.linalg.eigvalsh(np.atleast_2d(np.cov(mm.T, bias=True))), 0) if len(at) > 1 else (0.0, 0.0, 0.0)
        shift = float(np.linalg.norm(mm.mean(0) - (mm * x[:, None]).sum(0) / x.sum())) if abs(x.sum()) > 1e-8 else np.nan
        sphericity = (36 * np.pi * volume**2) ** (1 / 3) / area
        hv, ha = hull(p * (space / 2))
        box = (p.max(0) - p.min(0)) * (space / 2)
        semi = 2 * np.sqrt([least, minor, major])
        ok = (semi > 0).all()
        ratio = lambda a, b: a / b if b else np.nan
        values = [
            volume, len(at) * space.prod(), area, area / volume, sphericity, volume / (area**1.5 * np.sqrt(np.pi)), 36 * np.pi * volume**2 / area**3, 1 / sphericity, farthest(p * (space / 2)), *across,
            4 * np.sqrt(major), 4 * np.sqrt(minor), 4 * np.sqrt(least), np.sqrt(minor / major) if major > 0 else 0.0, np.sqrt(least / major) if major > 0 else 0.0, (36 * np.pi * volume**2 / area**3) ** (-1 / 3) - 1, shift, volume * x.mean(),
            ratio(volume, box.prod()), ratio(area, 2 * (box[0] * box[1] + box[1] * box[2] + box[0] * box[2])), 3 * volume / (4 * np.pi * semi.prod()) if ok else np.nan, area / ellipsoid_area(semi) if ok else np.nan, ratio(volume, hv), ratio(area, ha),
        ]
        return pdf[keys].head(1).assign(**dict(zip(SHAPE, values)))

    schema = StructType([v.schema[k] for k in keys])
    for n in SHAPE:
        schema = schema.add(n, "double")
    return v.select(*keys, *AXES, "val").groupBy(*keys).applyInPandas(run, schema)


def contour(at: np.ndarray) -> np.ndarray:
    """Segments (n, 2, 2) of the line around pixels (rows y, x), the inside to one side of all."""
    low = at.min(0) - 1
    grid = np.zeros(at.max(0) - low + 2, bool)
    grid[tuple((at - low).T)] = True
    ring = [(0, 0), (0, 1), (1, 1), (1, 0)]
    code = sum(grid[a : grid.shape[0] - 1 + a, b : grid.shape[1] - 1 + b].astype(int) << k for k, (a, b) in enumerate(ring))
    out = []
    for c in np.unique(code):
        segments = []
        for n in range(4):  # from the edge where the ring goes inside to the next where it leaves
            if c >> n & 1 and not c >> (n - 1) % 4 & 1:
                m = n
                while c >> (m + 1) % 4 & 1:
                    m += 1
                segments.append([np.add(ring[(n - 1) % 4], ring[n]) / 2, np.add(ring[m % 4], ring[(m + 1) % 4]) / 2])
        if segments:
            out.append((np.argwhere(code == c)[:, None, None, :] + low + np.array(segments)[None]).reshape(-1, 2, 2))
    return np.concatenate(out)


def shape2d(v: DataFrame, keys=("roi",), spacing=(1.0, 1.0), deprecated: bool = False) -> DataFrame:
    """9 features of regions in a plane (y, x), and with `deprecated` SphericalDisproportion."""
    keys = list(keys)
    space = np.asarray(spacing, float)
    names = [n for n in SHAPE2D if deprecated or n != "SphericalDisproportion"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["y", "x"]].to_numpy(np.int64)
        s = contour(at) * space
        area = abs(float((s[:, 0, 0] * s[:, 1, 1] - s[:, 1, 0] * s[:, 0, 1]).sum() / 2))
        length = float(np.sqrt(((s[:, 1] - s[:, 0]) ** 2).sum(1)).sum())
        minor, major = np.maximum(np.linalg.eigvalsh(np.cov((at * space).T, bias=True)), 0) if len(at) > 1 else (0.0, 0.0)
        sphericity = 2 * np.sqrt(np.pi * area) / length
        values = {
            "MeshSurface": area, "PixelSurface": len(at) * space.prod(), "Perimeter": length, "PerimeterSurfaceRatio": length / area, "Sphericity": sphericity, "SphericalDisproportion": 1 / sphericity,
            "MaximumDiameter": farthest(np.unique(s.reshape(-1, 2), axis=0)), "MajorAxisLength": 4 * np.sqrt(major), "MinorAxisLength": 4 * np.sqrt(minor), "Elongation": np.sqrt(minor / major) if major > 0 else 0.0,
        }
        return pdf[keys].head(1).assign(**{n: values[n] for n in names})

    schema = StructType([v.schema[k] for k in keys])
    for n in names:
        schema = schema.add(n, "double")
    return v.select(*keys, "y", "x").groupBy(*keys).applyInPandas(run, schema)
