"""Families against values worked out by hand for a plane of 4 x 4 voxels, and against laws that hold for any region."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.functions import voxels as V
from gridlore.operators import intensity, texture, zones


def one(df):
    return df.first().asDict()


def near(row, **want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-6), k


def test_firstorder(grid):
    r = one(intensity.firstorder(grid))
    near(r, Mean=2.25, Variance=1.0625, Skewness=0.171202, Kurtosis=-1.197232, Median=2.0, Energy=98.0, Entropy=1.923795, Uniformity=0.2734375)
    near(r, **{"10Percentile": 1.0, "90Percentile": 3.5})


def test_ih_gradient(grid):
    r = one(intensity.ih(grid))
    near(r, MaximumHistogramGradient=0.0, MaximumHistogramGradientIntensity=2.0, MinimumHistogramGradient=-3.0, MinimumHistogramGradientIntensity=4.0, Mode=3.0)


def test_ivh_levels(grid):
    r = one(intensity.ivh(grid))
    near(r, VolumeFractionAt10Intensity=11 / 16, VolumeFractionAt90Intensity=2 / 16, IntensityAt90Volume=2.0, IntensityAt10Volume=5.0)


def test_glcm(grid):
    near(one(texture.glcm(grid, ndim=2)), Contrast=0.951389, JointEnergy=0.137539, JointEntropy=3.047243)
    m = texture.glcm_matrix(grid, ["roi"], ndim=2)
    assert all(abs(r["s"] - 1) < 1e-12 for r in m.groupBy("dir").agg(F.sum("p").alias("s")).collect())
    p = {(r["dir"], r["i"], r["j"]): r["p"] for r in m.collect()}
    assert all(abs(p[d, j, i] - v) < 1e-15 for (d, i, j), v in p.items())


def test_mcc_is_the_second_eigenvalue(grid):
    want = []
    rows = texture.glcm_matrix(grid, ["roi"], ndim=2).toPandas()
    for _, m in rows.groupby("dir"):
        p = np.zeros((5, 5))
        p[m["i"], m["j"]] = m["p"]
        p = p[1:, 1:]
        px = p.sum(1)
        q = (p / px[:, None]) @ (p / px[None, :]).T
        want.append(np.sqrt(np.sort(np.linalg.eigvals(q).real)[-2]))
    near(one(texture.glcm(grid, ndim=2)), MCC=np.mean(want))


def test_runs(grid):
    near(one(texture.glrlm(grid, ndim=2)), ShortRunEmphasis=0.622362)
    r = texture.runs(grid, ["roi"], ndim=2)
    assert {x["s"] for x in r.groupBy("dir").agg(F.sum(F.col("j") * F.col("n")).alias("s")).collect()} == {16}


def test_runs_stop_at_gaps(spark):
    v = spark.createDataFrame([(0, 0, 0, x, 1) for x in (0, 1, 3)], "roi int, z int, y int, x int, g int")
    along = [r for r in texture.runs(v, ["roi"], ndim=2).collect() if r["j"] > 1]
    assert [(r["j"], r["n"]) for r in along] == [(2, 1)]


def test_gldm(grid):
    near(one(texture.gldm(grid, ndim=2)), SmallDependenceEmphasis=0.100920, LargeDependenceEmphasis=14.0, DependenceCountEnergy=0.15625)


def test_ngtdm(grid):
    near(one(texture.ngtdm(grid, ndim=2)), Coarseness=0.538418, Contrast=0.077566, Busyness=0.495278, Complexity=2.389649, Strength=2.711058)


def test_zones(grid):
    near(one(zones.glszm(grid, ndim=2)), SmallAreaEmphasis=0.098125, ZonePercentage=0.25)
    z = zones.zones(grid, ndim=2).collect()
    assert sorted(r["size"] for r in z) == [2, 4, 5, 5] and all(r["depth"] == 1 for r in z)


def test_zones_in_batches_and_distributed_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(k, z, y, x, int(rng.integers(1, 4))) for k in range(6) for z in range(3) for y in range(4) for x in range(5) if rng.random() < 0.8]
    v = spark.createDataFrame(rows, "roi int, z int, y int, x int, g int").cache()
    size = lambda df: sorted((r["roi"], r["i"], r["size"], r["depth"]) for r in df.collect())
    alone = size(zones.zones(v))
    assert alone == size(zones.zones_distributed(v))
    assert [x[:3] for x in alone] == [x[:3] for x in size(zones.zones(v, batches=2))]


@pytest.mark.parametrize("how", [{}, {"flat_axis": 1}, {"ndim": 2}])
def test_large_regions_take_another_way_to_the_same_zones(spark, how):
    rng = np.random.default_rng(2)
    rows = [(k, z, y, x, int(rng.integers(1, 3))) for k in range(3) for z in range(4) for y in range(4) for x in range(5) if rng.random() < (0.9 if k else 0.3)]
    v = spark.createDataFrame(rows, "roi int, z int, y int, x int, g int").cache()
    for family in (zones.glszm, zones.gldzm):
        a, b = (family(v, limit=n, **how).orderBy("roi").toPandas() for n in (40, 10_000))
        assert len(a) == 3 and np.allclose(a, b)
    wide = v.select("roi", "z", "y", "x").distinct()
    inner = v.filter("z > 0 and y > 0")
    one, two = (sorted(tuple(r) for r in zones.zones_of_any_size(inner, depth_of=wide, limit=n).collect()) for n in (1, 10_000))
    assert one == two

def test_depth_counts_steps_to_the_outside(spark):
    cube = spark.createDataFrame([(0, z, y, x, 1) for z in range(5) for y in range(5) for x in range(5)], "roi int, z int, y int, x int, g int")
    assert zones.taxicab_depth(np.argwhere(np.ones((5, 5, 5)))).max() == 3
    near(one(zones.gldzm(cube)), SmallDistanceEmphasis=1.0, ZonePercentage=1 / 125)


def test_constant_region(spark):
    v = spark.createDataFrame([(0, 0, y, x, 7.0, 1) for y in range(3) for x in range(3)], "roi int, z int, y int, x int, val double, g int")
    near(one(intensity.firstorder(v)), Variance=0.0, Skewness=0.0, CoefficientOfVariation=0.0, Entropy=0.0)
    near(one(texture.glcm(v, ndim=2)), Correlation=1.0, MCC=1.0, Imc1=0.0, Imc2=0.0, Contrast=0.0)
    near(one(texture.ngtdm(v, ndim=2)), Coarseness=1e6, Contrast=0.0, Strength=0.0)
    assert one(V.fixed_count(v.drop("g"), ["roi"], 32).select(F.max("g").alias("g")))["g"] == 17
    assert one(V.fixed_width(v.drop("g"), ["roi"], 25).select(F.max("g").alias("g")))["g"] == 1


def test_dispersion_and_variation_without_a_denominator(spark):
    v = spark.createDataFrame([(0, 0, 0, x, float(x - 1), x + 1) for x in range(3)], "roi int, z int, y int, x int, val double, g int")
    r = one(intensity.firstorder(v))
    assert r["QuartileCoefficientOfDispersion"] == 1.0 and r["CoefficientOfVariation"] == float("inf")


def test_levels_do_not_change_when_values_move_by_bins(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(0, 0, y, x, float(rng.integers(-80, 80))) for y in range(6) for x in range(6)], "roi int, z int, y int, x int, val double")
    g = lambda d: [r["g"] for r in V.fixed_width(d, ["roi"], 8.0).orderBy("y", "x").collect()]
    assert g(v) == g(v.withColumn("val", F.col("val") + 40))


def test_isolated_voxels_have_no_neighbours(spark):
    v = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 5, 2), (0, 0, 0, 6, 3)], "roi int, z int, y int, x int, g int")
    assert V.pairs(v, ["roi"], V.half_offsets()).count() == 1
    assert V.pairs(v, ["roi"], V.half_offsets(), (1, 5)).count() == 2
