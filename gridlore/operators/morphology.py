"""Masks as sets of places: dilation, erosion, shells and holes, as joins and, image by image, in numpy."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions.voxels import AXES
from gridlore.operators.zones import label_zones


def diamond(radius: int = 1, flat_axis: int | None = None) -> list[tuple[int, int, int]]:
    """Offsets within `radius` steps along the axes."""
    r = range(-radius, radius + 1)
    return [o for o in product(r, r, r) if sum(map(abs, o)) <= radius and (flat_axis is None or o[flat_axis] == 0)]


def _moved(mask: DataFrame, keys, offsets) -> DataFrame:
    steps = F.array(*(F.struct(*(F.lit(o[i]).alias(a) for i, a in enumerate(AXES))) for o in offsets))
    return mask.select(*keys, *AXES, F.explode(steps).alias("s")).select(*keys, *((F.col(a) + F.col(f"s.{a}")).alias(a) for a in AXES))


def dilate(mask: DataFrame, keys=("roi",), offsets=None) -> DataFrame:
    return _moved(mask, keys, offsets or diamond()).distinct()


def erode(mask: DataFrame, keys=("roi",), offsets=None) -> DataFrame:
    """Places all of whose neighbours are in the mask."""
    o = offsets or diamond()
    return _moved(mask, keys, o).groupBy(*keys, *AXES).agg(F.count("*").alias("n")).filter(F.col("n") == len(o)).drop("n")


def shell(mask: DataFrame, keys=("roi",), offsets=None) -> DataFrame:
    """The places just outside."""
    return dilate(mask, keys, offsets).join(mask, [*keys, *AXES], "left_anti")


def surface(mask: DataFrame, keys=("roi",), offsets=None) -> DataFrame:
    """The mask's places that erosion takes."""
    return mask.select(*keys, *AXES).join(erode(mask, keys, offsets), [*keys, *AXES], "left_anti")


def grid_dilate(m: np.ndarray, offsets) -> np.ndarray:
    r = max(max(map(abs, o)) for o in offsets) if offsets else 0
    wide = np.pad(m, r)
    out = np.zeros_like(m)
    for o in offsets:
        out |= wide[tuple(slice(r - d, r - d + n) for d, n in zip(o, m.shape))]
    return out


def grid_erode(m: np.ndarray, offsets) -> np.ndarray:
    """Outside of the grid counts as outside of the mask."""
    r = 1 + max((max(map(abs, o)) for o in offsets), default=0)
    out = ~grid_dilate(~np.pad(m, r), [tuple(-d for d in o) for o in offsets])
    return out[tuple(slice(r, r + n) for n in m.shape)]


def grid_fill(m: np.ndarray) -> np.ndarray:
    """Fills what the outside does not reach over faces."""
    free = ~np.pad(m, 1)
    at = np.argwhere(free)
    label = label_zones(at, np.ones(len(at), int), [o for o in diamond() if o > (0, 0, 0)])
    hole = np.zeros(free.shape, bool)
    hole[tuple(at[label != label[0]].T)] = True  # the first place is a corner: outside
    return m | hole[tuple(slice(1, -1) for _ in m.shape)]


def grid_components(m: np.ndarray, full: bool = True) -> np.ndarray:
    """Component numbers from 1 (0: outside): over corners, or over faces only."""
    from gridlore.functions.voxels import half_offsets

    out = np.zeros(m.shape, np.int64)
    at = np.argwhere(m)
    if len(at):
        offsets = half_offsets() if full else [o for o in diamond() if o > (0, 0, 0)]
        out[tuple(at.T)] = np.unique(label_zones(at, np.ones(len(at), int), offsets), return_inverse=True)[1] + 1
    return out


def smooth(m: np.ndarray, closing: int = 2, opening: int = 1, dilation: int = 0, fill: bool = True, in_plane: bool = False) -> np.ndarray:
    """Closing, dilation, filling of holes, opening."""
    flat = 0 if in_plane else None
    if closing:
        m = grid_erode(grid_dilate(m, diamond(closing, flat)), diamond(closing, flat))
    if dilation:
        m = grid_dilate(m, diamond(dilation, flat))
    if fill:
        m = np.stack([grid_fill(p[None])[0] for p in m]) if in_plane else grid_fill(m)
    if opening:
        m = grid_dilate(grid_erode(m, diamond(opening, flat)), diamond(opening, flat))
    return m


def keep_components(m: np.ndarray, least: int, most: int = 0) -> np.ndarray:
    """Components of at least `least` voxels (if none is, the largest), of those the `most` largest (0: all)."""
    label = grid_components(m)
    sizes = np.bincount(label.ravel())[1:]
    if not len(sizes):
        return m
    keep = np.flatnonzero(sizes >= least)
    if not len(keep):
        keep = np.array([sizes.argmax()])
    if most and len(keep) > most:
        keep = keep[np.argsort(-sizes[keep], kind="stable")[:most]]
    return np.isin(label, keep + 1)


def distance_to(m: np.ndarray, at: np.ndarray, block: int = 512) -> np.ndarray:
    """Euclidean distance from places to the nearest voxel of the mask's surface, or 0 inside."""
    rim = np.argwhere(m & ~grid_erode(m, diamond()))
    out = np.zeros(len(at))
    for i in range(0, len(at), block):
        d = at[i : i + block, None].astype(float) - rim[None]
        out[i : i + block] = np.sqrt((d * d).sum(-1).min(1))
    return np.where(m[tuple(at.T)], 0.0, out)
