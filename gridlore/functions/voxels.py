"""Voxel tables: views over the driver's tables, gray levels, neighbours and windows.

A voxel table has key columns (a case, a region, an image type, for maps also the window's centre), integer
coordinates z, y, x, an intensity `val` and, once discretised, a gray level `g` from 1.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def vox2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding a row of pixels of the region of its label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").alias("roi"), F.lit(0).alias("z"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).select(
        "roi", "z", "y", "x", F.floor(F.col("v").cast("double") * 1000).cast("double").alias("val")
    )


def vox3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 7 x 24 x 24 volume for each return flag."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = {"roi": F.col("l_returnflag"), "z": (F.col("l_linenumber") - 1).cast("int"), "y": (F.col("l_orderkey") % 24).cast("int"), "x": (F.col("l_partkey") % 24).cast("int")}
    g = t.groupBy(*(c.alias(n) for n, c in at.items())).agg((F.sum(F.col("l_quantity").cast("long")) % 50).cast("double").alias("val"))
    return g.select("roi", "z", "y", "x", "val")


def select_roi(voxels: DataFrame, mask: DataFrame, on=("z", "y", "x")) -> DataFrame:
    """The voxels that the mask has a row for."""
    return voxels.join(mask.select(*on), list(on), "left_semi")


def fixed_width(v: DataFrame, keys, width: float, minimum: float | None = None) -> DataFrame:
    """Levels by bins of a width, aligned to multiples of it, or to minimum (values below drop out)."""
    if minimum is not None:
        g = F.floor((F.col("val") - F.lit(float(minimum))) / width) + 1
        return v.filter(F.col("val") >= minimum).withColumn("g", g.cast("int"))
    low = v.groupBy(*keys).agg(F.floor(F.min("val") / width).alias("__low"))
    return v.join(low, list(keys)).withColumn("g", (F.floor(F.col("val") / width) - F.col("__low") + 1).cast("int")).drop("__low")


def fixed_count(v: DataFrame, keys, count: int) -> DataFrame:
    """Levels by a number of equal bins between a region's ends. A constant region lies in the middle bin."""
    ends = v.groupBy(*keys).agg(F.min("val").alias("__a"), F.max("val").alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    inside = F.least(F.lit(count), F.floor(count * (F.col("val") - a) / F.when(b > a, b - a).otherwise(1.0)) + 1)
    return v.join(ends, list(keys)).withColumn("g", F.when(b > a, inside).otherwise(count // 2 + 1).cast("int")).drop("__a", "__b")


def compacted(v: DataFrame, keys) -> DataFrame:
    """Levels renumbered without the empty ones."""
    seen = v.groupBy(*keys, "g").count()
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("g")
    return v.join(seen.select(*keys, "g", F.row_number().over(w).alias("__n")), [*keys, "g"]).drop("g").withColumnRenamed("__n", "g")


def half_offsets(ndim: int = 3, flat_axis: int | None = None) -> list[tuple[int, int, int]]:
    """One offset (z, y, x) of each pair of opposite neighbours: 13 in space, 4 in a plane."""
    out = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    still = 0 if ndim == 2 else flat_axis
    return [o for o in out if still is None or o[still] == 0]


def pairs(v: DataFrame, keys, offsets, distances=(1,)) -> DataFrame:
    """Neighbouring voxels of a region: dir (number of offset and distance), coordinates and levels of both ends, each pair once."""
    steps = F.array(*(F.struct(F.lit(n).alias("dir"), *(F.lit(d * o[i]).alias(a) for i, a in enumerate(AXES))) for n, (d, o) in enumerate((d, o) for d in distances for o in offsets)))
    a = v.select(*keys, *(F.col(c).alias(f"{c}1") for c in AXES), F.col("g").alias("g1"), F.explode(steps).alias("s"))
    a = a.select(*keys, *(f"{c}1" for c in AXES), "g1", "s.dir", *((F.col(f"{c}1") + F.col(f"s.{c}")).alias(c) for c in AXES))
    b = v.select(*keys, *AXES, F.col("g").alias("g2"))
    return a.join(b, [*keys, *AXES])


def windows(v: DataFrame, keys, radius: int = 1, ndim: int = 3, centres: DataFrame | None = None, flat_axis: int | None = None) -> DataFrame:
    """For each voxel (or each of `centres`) the voxels of its window, keyed by keys and the centre cz, cy, cx. flat_axis: windows
    stay in slices across that axis."""
    r, still = range(-radius, radius + 1), 0 if ndim == 2 else flat_axis
    cells = [o for o in product(r, r, r) if still is None or o[still] == 0]
    steps = F.array(*(F.struct(*(F.lit(o[i]).alias(a) for i, a in enumerate(AXES))) for o in cells))
    c = (v if centres is None else centres).select(*keys, *(F.col(a).alias(f"c{a}") for a in AXES), F.explode(steps).alias("s"))
    c = c.select(*keys, *(f"c{a}" for a in AXES), *((F.col(f"c{a}") + F.col(f"s.{a}")).alias(a) for a in AXES))
    return c.join(v, [*keys, *AXES])


CENTRE = ("cz", "cy", "cx")


def to_long(wide: DataFrame, keys, family: str) -> DataFrame:
    """keys, family, feature, value: a row for each feature."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.lit(family).alias("family"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("double"))])).alias("feature", "value"))
