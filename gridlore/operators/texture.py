"""Texture families: co-occurrence, run length, zones, distance zones, dependence, gray-tone difference.

Matrices are long tables (keys, i, j, n). Families take a voxel table with levels `g`; with window centres among
the keys the same code makes feature maps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.voxels import AXES, half_offsets, pairs

#: The names of the features, in their order.
GLCM_FEATURES = (
    "Autocorrelation", "JointAverage", "ClusterProminence", "ClusterShade", "ClusterTendency", "Contrast", "Correlation", "DifferenceAverage", "DifferenceEntropy", "DifferenceVariance",
    "JointEnergy", "JointEntropy", "Imc1", "Imc2", "Idm", "MCC", "Idmn", "Id", "Idn", "InverseVariance", "MaximumProbability", "SumAverage", "SumEntropy", "SumSquares", "SumVariance", "Dissimilarity",
)


def glcm_counts(v: DataFrame, keys, distances=(1,), ndim: int = 3, flat_axis=None) -> DataFrame:
    """(keys, dir, i, j, n) with i <= j: the pairs of two levels in a direction and its opposite."""
    at = (F.least("g1", "g2").alias("i"), F.greatest("g1", "g2").alias("j"))
    return pairs(v, keys, half_offsets(ndim, flat_axis), distances).groupBy(*keys, "dir", *at).agg(F.count("*").alias("n"))


def _symmetric(counts: DataFrame, by) -> DataFrame:
    """Counts to rows (by, i, j, p, h): of levels that differ one for either order, of equal levels two; p is the cell's probability,
    and over all rows h adds up to 1. So a sum over the matrix is a sum over rows weighted by h."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    c = counts.select(*by, "i", "j", share.alias("w"))
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return c.select(*by, both.alias("x"), "w").select(*by, "x.i", "x.j", F.when(F.col("x.i") == F.col("x.j"), F.col("w")).otherwise(F.col("w") / 2).alias("p"), (F.col("w") / 2).alias("h"))


def glcm_matrix(v: DataFrame, keys, distances=(1,), ndim: int = 3, flat_axis=None) -> DataFrame:
    """(keys, dir, i, j, p): symmetric, normalised by direction. Pairs are counted once and mirrored as counts."""
    by = [*keys, "dir"]
    return _symmetric(glcm_counts(v, list(keys), distances, ndim, flat_axis), by).groupBy(*by, "i", "j").agg(F.first("p").alias("p"))


def _entropy(p):
    return -F.sum(p * F.log2(p))


def glcm(v: DataFrame, keys=("roi",), distances=(1,), ndim: int = 3, flat_axis=None, mcc: bool = True, flat_correlation: float = 1.0) -> DataFrame:
    """26 features of each direction's matrix, averaged over directions that have pairs.

    Counts come from one join of the voxels with themselves. They are shuffled by region and direction once; the sums by level, by
    sum and by difference of levels are windows within that, and all features one aggregate."""
    keys = list(keys)
    by = [*keys, "dir"]
    counts = glcm_counts(v, keys, distances, ndim, flat_axis)
    levels = v.groupBy(*keys).agg(F.max("g").alias("ng"))
    i, j, p, h = F.col("i"), F.col("j"), F.col("p"), F.col("h")
    m = _symmetric(counts, by).withColumn("d", F.abs(i - j)).withColumn("k", i + j).withColumn("mu", F.sum(i * h).over(Window.partitionBy(*by)))
    for name, of in (("of_i", "i"), ("of_d", "d"), ("of_k", "k")):
        m = m.withColumn(name, F.sum("h").over(Window.partitionBy(*by, of)))
    d, k, u, c = F.col("d"), F.col("k"), i - F.col("mu"), i + j - 2 * F.col("mu")
    mean = lambda x: F.sum(x * h)
    f = m.groupBy(*by).agg(
        mean(i * j).alias("Autocorrelation"), F.first("mu").alias("JointAverage"), mean(c * c * c * c).alias("ClusterProminence"), mean(c * c * c).alias("ClusterShade"), mean(c * c).alias("ClusterTendency"),
        mean(d * d).alias("Contrast"), mean(p).alias("JointEnergy"), (-mean(F.log2(p))).alias("JointEntropy"), F.sum(h / (1 + d * d)).alias("Idm"), F.sum(h / (1 + d)).alias("Id"),
        # What the highest level scales is kept by difference of levels, and summed when that level is known.
        F.collect_set(F.struct("d", "of_d")).alias("by_d"), F.sum(F.when(d > 0, h / F.greatest(d * d, F.lit(1))).otherwise(0.0)).alias("InverseVariance"), F.max(p).alias("MaximumProbability"),
        mean(u * u).alias("SumSquares"), mean(d).alias("Dissimilarity"), mean(u * (j - F.col("mu"))).alias("cov"), (F.min(i) < F.max(i)).alias("kinds"), mean(k).alias("SumAverage"), (-mean(F.log2("of_k"))).alias("SumEntropy"),
        (-mean(F.log2("of_d"))).alias("DifferenceEntropy"), (-mean(F.log2("of_i"))).alias("hx"),
    )
    f = f.join(levels, keys)
    scaled = lambda share: F.aggregate("by_d", F.lit(0.0), lambda s, x: s + x["of_d"] / (1 + share(x["d"])))
    ng = F.col("ng").cast("double")
    f = f.withColumn("Idmn", scaled(lambda x: x * x / (ng * ng))).withColumn("Idn", scaled(lambda x: x / ng))
    f = f.withColumn("DifferenceAverage", F.col("Dissimilarity")).withColumn("DifferenceVariance", F.col("Contrast") - F.col("Dissimilarity") * F.col("Dissimilarity"))
    hx, hxy = F.col("hx"), F.col("JointEntropy")  # of a symmetric matrix both entropies of the margins' product are twice hx
    more, two = 2 * hx - hxy, F.col("kinds")
    f = f.withColumn("Correlation", F.when(~two | (F.col("SumSquares") <= 0), flat_correlation).otherwise(F.col("cov") / F.when(F.col("SumSquares") <= 0, 1.0).otherwise(F.col("SumSquares"))))
    f = f.withColumn("Imc1", F.when((hx == 0) | ~two, 0.0).otherwise(-more / F.when(hx == 0, 1.0).otherwise(hx))).withColumn("Imc2", F.when((more <= 0) | ~two, 0.0).otherwise(F.sqrt(1 - F.exp(-2 * F.greatest(more, F.lit(0.0))))))
    f = f.withColumn("SumVariance", F.col("ClusterTendency"))  # both are the variance of i + j
    if mcc:
        f = f.join(_mcc(_symmetric(counts, by).dropDuplicates([*by, "i", "j"]), by), by)
    names = [n for n in GLCM_FEATURES if mcc or n != "MCC"]
    return f.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in names))


def _mcc(m: DataFrame, by) -> DataFrame:
    """Square root of the second largest eigenvalue of the matrix of level correlations; 1 with fewer than two levels."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at, where = np.unique(pdf["i"], return_inverse=True)
        p = np.zeros((len(at), len(at)))
        p[where, np.searchsorted(at, pdf["j"])] = pdf["p"]
        scale = 1 / np.sqrt(p.sum(1))
        e = np.sort(np.abs(np.linalg.eigvalsh(p * scale[:, None] * scale[None, :])))
        return pdf[by].head(1).assign(MCC=1.0 if len(at) < 2 else float(e[-2]))

    return m.groupBy(*by).applyInPandas(solve, StructType([m.schema[c] for c in by]).add("MCC", "double"))


#: The names of the features that run length, zones, distance zones and dependence share.
TEMPLATE = {
    "glrlm": ("ShortRunEmphasis", "LongRunEmphasis", "LowGrayLevelRunEmphasis", "HighGrayLevelRunEmphasis", "ShortRunLowGrayLevelEmphasis", "ShortRunHighGrayLevelEmphasis", "LongRunLowGrayLevelEmphasis", "LongRunHighGrayLevelEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "RunLengthNonUniformity", "RunLengthNonUniformityNormalized", "RunPercentage", "GrayLevelVariance", "RunVariance", "RunEntropy"),
    "glszm": ("SmallAreaEmphasis", "LargeAreaEmphasis", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis", "SmallAreaLowGrayLevelEmphasis", "SmallAreaHighGrayLevelEmphasis", "LargeAreaLowGrayLevelEmphasis", "LargeAreaHighGrayLevelEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "SizeZoneNonUniformity", "SizeZoneNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneVariance", "ZoneEntropy"),
    "gldzm": ("SmallDistanceEmphasis", "LargeDistanceEmphasis", "LowGrayLevelZoneEmphasis", "HighGrayLevelZoneEmphasis", "SmallDistanceLowGrayLevelEmphasis", "SmallDistanceHighGrayLevelEmphasis", "LargeDistanceLowGrayLevelEmphasis", "LargeDistanceHighGrayLevelEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "ZoneDistanceNonUniformity", "ZoneDistanceNonUniformityNormalized", "ZonePercentage", "GrayLevelVariance", "ZoneDistanceVariance", "ZoneDistanceEntropy"),
    "gldm": ("SmallDependenceEmphasis", "LargeDependenceEmphasis", "LowGrayLevelEmphasis", "HighGrayLevelEmphasis", "SmallDependenceLowGrayLevelEmphasis", "SmallDependenceHighGrayLevelEmphasis", "LargeDependenceLowGrayLevelEmphasis", "LargeDependenceHighGrayLevelEmphasis", "GrayLevelNonUniformity", "GrayLevelNonUniformityNormalized", "DependenceNonUniformity", "DependenceNonUniformityNormalized", "DependenceCountPercentage", "GrayLevelVariance", "DependenceVariance", "DependenceEntropy"),
}


def matrix_features(m: DataFrame, keys, family: str, voxels=None) -> DataFrame:
    """The 16 features of (keys, i, j, n). voxels: how many voxels a row stands for, a column; None: j times n. The counts are
    shuffled by region once; sums by level and by size are windows within that, and all features one aggregate."""
    keys = list(keys)
    a = m.select(*keys, *(F.col(c).cast("double").alias(c) for c in "ijn"), (F.col("j") * F.col("n") if voxels is None else voxels).cast("double").alias("nv"))
    a = a.withColumn("ns", F.sum("n").over(Window.partitionBy(*keys)))
    for c in "ij":
        a = a.withColumn(f"of_{c}", F.sum("n").over(Window.partitionBy(*keys, c)))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    sums = (n / (j * j), n * j * j, n / (i * i), n * i * i, n / (i * i * j * j), n * i * i / (j * j), n * j * j / (i * i), n * i * i * j * j)
    ns = F.first("ns")  # products of whole numbers are summed before the division, which keeps them exact
    f = a.groupBy(*keys).agg(
        ns.alias("ns"), F.sum("nv").alias("nv"), *((F.sum(x) / ns).alias(f"f{k}") for k, x in enumerate(sums)), (F.sum(n * i) / ns).alias("mi"), (F.sum(n * j) / ns).alias("mj"), _entropy(n / F.col("ns")).alias("f15"),
        (F.sum(n * n) / (ns * ns)).alias("energy"), F.sum(n * F.col("of_i")).alias("gi"), F.sum(n * F.col("of_j")).alias("gj"),
    )
    ns = F.col("ns")
    f = f.select(
        *keys, *(f"f{x}" for x in range(8)), (F.col("gi") / ns).alias("f8"), (F.col("gi") / (ns * ns)).alias("f9"), (F.col("gj") / ns).alias("f10"), (F.col("gj") / (ns * ns)).alias("f11"), (ns / F.col("nv")).alias("f12"),
        (F.col("f3") - F.col("mi") * F.col("mi")).alias("f13"), (F.col("f1") - F.col("mj") * F.col("mj")).alias("f14"), "f15", "energy",
    )
    return f.select(*keys, *(F.col(f"f{x}").alias(name) for x, name in enumerate(TEMPLATE[family])), *([F.col("energy").alias("DependenceCountEnergy")] if family == "gldm" else []))


def runs(v: DataFrame, keys, ndim: int = 3, flat_axis=None) -> DataFrame:
    """Maximal runs of a level along each direction: (keys, dir, i, j: length, n). Gaps and islands: along a line, a run begins where
    the level changes or the position before is not in the region."""
    keys = list(keys)
    offsets = half_offsets(ndim, flat_axis)
    along = [next(a for a in range(3) if o[a]) for o in offsets]  # the axis whose step is 1: its coordinate is the place on the line
    lines = F.array(*(F.struct(F.lit(n).alias("dir"), F.col(AXES[a]).alias("t"), *((F.col(AXES[b]) - F.col(AXES[a]) * (o[b] * o[a])).alias(f"l{b}") for b in range(3))) for n, (o, a) in enumerate(zip(offsets, along))))
    d = v.select(*keys, F.col("g").alias("i"), F.explode(lines).alias("l")).select(*keys, "i", "l.*")
    w = Window.partitionBy(*keys, "dir", "l0", "l1", "l2").orderBy("t")
    new = F.when((F.lag("i").over(w) == F.col("i")) & (F.lag("t").over(w) == F.col("t") - 1), 0).otherwise(1)
    r = d.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    each = r.groupBy(*keys, "dir", "l0", "l1", "l2", "run", "i").agg(F.count("*").alias("j"))
    return each.groupBy(*keys, "dir", "i", "j").agg(F.count("*").alias("n"))


def glrlm(v: DataFrame, keys=("roi",), ndim: int = 3, flat_axis=None) -> DataFrame:
    """16 features of each direction, averaged."""
    keys = list(keys)
    f = matrix_features(runs(v, keys, ndim, flat_axis), [*keys, "dir"], "glrlm")
    return f.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in TEMPLATE["glrlm"]))


def gldm(v: DataFrame, keys=("roi",), distances=(1,), alpha: float = 0, ndim: int = 3, flat_axis=None) -> DataFrame:
    """17 features: a voxel's dependence is one more than its neighbours within alpha levels."""
    keys = list(keys)
    near = pairs(v, keys, half_offsets(ndim, flat_axis), distances).filter(F.abs(F.col("g1") - F.col("g2")) <= alpha)
    ends = near.select(*keys, F.explode(F.array(F.struct(*(F.col(f"{a}1").alias(a) for a in AXES)), F.struct(*AXES))).alias("e")).groupBy(*keys, *(f"e.{a}" for a in AXES)).agg(F.count("*").alias("k"))
    d = v.select(*keys, *AXES, "g").join(ends, [*keys, *AXES], "left")
    m = d.groupBy(*keys, F.col("g").alias("i"), (F.coalesce("k", F.lit(0)) + 1).alias("j")).agg(F.count("*").alias("n"))
    return matrix_features(m, keys, "gldm", F.col("n"))


def ngtdm(v: DataFrame, keys=("roi",), distances=(1,), ndim: int = 3, flat_axis=None) -> DataFrame:
    """5 features of the difference between a voxel's level and its neighbours' mean; voxels without neighbours take no part."""
    keys = list(keys)
    p = pairs(v, keys, half_offsets(ndim, flat_axis), distances)
    ends = p.select(*keys, F.explode(F.array(F.struct(*(F.col(f"{a}1").alias(a) for a in AXES), F.col("g1").alias("g"), F.col("g2").alias("o")), F.struct(*AXES, F.col("g2").alias("g"), F.col("g1").alias("o")))).alias("e")).select(*keys, "e.*")
    each = ends.groupBy(*keys, *AXES, "g").agg(F.abs(F.col("g") - F.avg("o")).alias("d"))
    lev = each.groupBy(*keys, "g").agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    every = Window.partitionBy(*keys)
    lev = lev.withColumn("nv", F.sum("n").over(every)).withColumn("ng", F.count("*").over(every)).withColumn("ss", F.sum("s").over(every)).withColumn("p", F.col("n") / F.col("nv")).withColumn("ps", F.sum(F.col("p") * F.col("s")).over(every))
    a, b = lev.alias("a"), lev.select(*keys, F.col("g").alias("h"), F.col("s").alias("s2"), F.col("p").alias("p2"))
    i, j, pi, pj, si, sj = (F.col(c) for c in ("g", "h", "p", "p2", "s", "s2"))
    x = a.join(b, keys).groupBy(*keys).agg(
        F.sum(pi * pj * (i - j) * (i - j)).alias("c"), F.sum(F.abs(i * pi - j * pj)).alias("b"), F.sum(F.abs(i - j) * (pi * si + pj * sj) / (pi + pj)).alias("x"), F.sum((pi + pj) * (i - j) * (i - j)).alias("st"),
        F.first("nv").alias("nv"), F.first("ng").alias("ng"), F.first("ss").alias("ss"), F.first("ps").alias("ps"),
    )
    ng, ss, ps = F.col("ng"), F.col("ss"), F.col("ps")
    over = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return x.select(
        *keys, F.when(ps == 0, 1e6).otherwise(1 / over(ps)).alias("Coarseness"), F.when(ng > 1, F.col("c") / over(ng * (ng - 1)) * ss / F.col("nv")).otherwise(0.0).alias("Contrast"),
        F.when((ng > 1) & (F.col("b") > 0), ps / over(F.col("b"))).otherwise(0.0).alias("Busyness"), (F.col("x") / F.col("nv")).alias("Complexity"), F.when(ss > 0, F.col("st") / over(ss)).otherwise(0.0).alias("Strength"),
    )
