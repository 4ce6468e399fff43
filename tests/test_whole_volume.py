"""Queries over the volume take all of it."""

import pytest
from pyspark.sql import functions as F

from gridlore.functions import voxels as V
from gridlore.plans import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["phenotype_tiers", "phenotype_fused_pes", "phenotype_global_top"])
def test_phenotypes_cover_every_voxel(spark, name):
    want = {r["roi"]: r["count"] for r in V.vox3d(spark, DIR).groupBy("roi").count().collect()}
    got = {r["roi"]: r["n"] for r in Q.queries()[name](spark, DIR).groupBy("roi").agg(F.sum("voxels").alias("n")).collect()}
    assert got == want


def test_maps_have_every_slice(spark):
    slices = lambda df: {r["z"] for r in df.select("z").distinct().collect()}
    assert slices(Q.maps(spark, DIR)) == slices(V.vox3d(spark, DIR)) == set(range(7))


def test_planar_shapes_of_every_slice(spark):
    want = {(r["roi"], r["z"]): r["count"] for r in V.vox3d(spark, DIR).filter("val >= 10").groupBy("roi", "z").count().collect()}
    got = {(r["roi"], r["z"]): r["PixelSurface"] for r in Q.queries()["shape_2d"](spark, DIR).collect()}
    assert got == want and {z for _, z in got} == set(range(7))
