"""One engine in several runs, spacing by case, and resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import filters, preprocess
from gridlore.plans.engine import Engine

BOTH = {"setting": {"resampledPixelSpacing": [2, 2, 2], "interpolator": "linear", "binWidth": 10}, "scalar": {"firstorder": ["Mean"]}, "spatial": {"firstorder": ["Mean"]}}


def _cube(spark, cases, shape=(4, 8, 8)):
    rng = np.random.default_rng(0)
    rows = [(c, z, y, x, float(rng.integers(0, 90))) for c in cases for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2])]
    images = spark.createDataFrame(rows, "case_id string, z int, y int, x int, val double").cache()
    return images, images.select("case_id", F.lit("r").alias("roi_id"), "z", "y", "x", F.lit(1).alias("label")).cache()


def test_an_engine_serves_any_number_of_runs(spark):
    images, masks = _cube(spark, ["a"])
    e = Engine(BOTH)
    first, again = e.execute(images, masks), e.execute(images, masks)
    fresh = Engine(BOTH).spatial(images, masks)
    assert first["spatial"].count() == again["spatial"].count() == fresh.count() == 2 * 4 * 4
    assert first["scalar"].first()["value"] == again["scalar"].first()["value"] == Engine(BOTH).scalar(images, masks).first()["value"]


def test_spacing_by_case(spark):
    images, masks = _cube(spark, ["a", "b"], (4, 4, 4))
    geometry = spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("b", [2.0, 1.0, 4.0])], "case_id string, spacing array<double>")
    n = {r["case_id"]: r["count"] for r in Engine(BOTH, spacing=geometry).spatial(images, masks).groupBy("case_id").count().collect()}
    assert n == {"a": 2 * 2 * 2, "b": 8 * 2 * 4}
    with pytest.raises(ValueError, match="every axis"):
        Engine({"scalar": {"firstorder": ["Mean"]}}, spacing=geometry)


def test_filters_know_the_spacing(spark):
    images, masks = _cube(spark, ["a"], (3, 4, 5))
    e = Engine({"scalar": {"firstorder": ["Mean"]}, "imageType": {"Gradient": {}, "LoG": {"sigma": 2.0}}}, spacing=(3.0, 1.0, 1.0))
    got = {r["image_type"]: r["value"] for r in e.scalar(images, masks).collect()}
    for name, how in (("gradient", {}), ("log", {"sigma": 2.0})):
        want = filters.IMAGE_TYPES[name](images, ["case_id"], spacing=(3.0, 1.0, 1.0), **how).agg(F.avg("val")).first()[0]
        assert got[name] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_flat_windows_stay_in_their_slices(spark, axis):
    images, masks = _cube(spark, ["a"], (3, 4, 5))
    e = Engine({"setting": {"force2D": True, "force2Ddimension": axis}, "scalar": None, "spatial": {"firstorder": ["Mean"]}})
    cube = {(r["z"], r["y"], r["x"]): r["val"] for r in images.collect()}
    for r in e.spatial(images, masks).collect():
        c = (r["z"], r["y"], r["x"])
        near = [v for k, v in cube.items() if all(abs(i - j) <= (n != axis) for n, (i, j) in enumerate(zip(k, c)))]
        assert r["firstorder_Mean"] == pytest.approx(np.mean(near))


def _spline(n, values, at):
    """The mirrored cubic spline through values, by solving for its coefficients."""
    b = lambda t: np.where(np.abs(t) < 1, 2 / 3 - t * t + np.abs(t) ** 3 / 2, np.where(np.abs(t) < 2, (2 - np.abs(t)) ** 3 / 6, 0.0))
    fold = lambda k: (2 * n - 2 - k % (2 * n - 2)) if k % (2 * n - 2) >= n else k % (2 * n - 2)
    rows = lambda places: np.array([[sum(b(p - k) for k in range(-n, 2 * n) if fold(k) == j) for j in range(n)] for p in places])
    return rows(at) @ np.linalg.solve(rows(range(n)), values)


def test_spline_goes_through_its_voxels_and_is_the_mirrored_cubic(spark):
    rng = np.random.default_rng(2)
    cube = rng.normal(size=(5, 6, 4)) * 50
    v = spark.createDataFrame([(0, *map(int, i), float(cube[i])) for i in np.ndindex(cube.shape)], "roi int, z int, y int, x int, val double")
    same = {(r["z"], r["y"], r["x"]): r["val"] for r in preprocess.resample(v, spacing=(1, 1, 1), to=(1, 1, 1), interpolator="bspline").collect()}
    assert all(same[i] == pytest.approx(cube[i], abs=1e-9) for i in np.ndindex(cube.shape))
    got = preprocess.resample(v, spacing=(1, 1, 1), to=(0.7, 1.0, 1.5), interpolator="bspline").toPandas()
    want = cube
    for axis, t in enumerate((0.7, 1.0, 1.5)):
        n = cube.shape[axis]
        m = int(np.ceil(n / t))
        at = np.clip((n - 1) / 2 - (m - 1) * t / 2 + np.arange(m) * t, 0, n - 1)
        want = np.apply_along_axis(lambda line: _spline(len(line), line, at), axis, want)  # noqa: B023
    assert len(got) == want.size and np.allclose(got["val"], want[tuple(got[list("zyx")].to_numpy().T)], atol=1e-9)


def test_resample_to_a_reference(spark):
    v = spark.createDataFrame([(0, z, y, x, float(z + 10 * y + 100 * x)) for z in range(3) for y in range(4) for x in range(5)], "roi int, z int, y int, x int, val double")
    reference = spark.createDataFrame([(0, z, y, x) for z in range(2) for y in range(3) for x in range(6)], "roi int, z int, y int, x int")
    got = preprocess.resample_to(v, reference, reference_spacing=(1.0, 1.5, 1.0), reference_origin=(0.5, 0.0, 0.25), outside=-1.0)
    for r in got.collect():
        z, y, x = r["z"] + 0.5, r["y"] * 1.5, r["x"] + 0.25
        inside = z <= 2.5 and y <= 3.5 and x <= 4.5
        assert r["val"] == pytest.approx(min(z, 2) + 10 * min(y, 3) + 100 * min(x, 4) if inside else -1.0)
    mask = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 1)], "roi int, z int, y int, x int")
    on = preprocess.correct_mask(mask, v, ["roi"], mask_spacing=(2.0, 2.0, 2.0))
    assert {(r["z"], r["y"], r["x"]) for r in on.collect()} == {(z, y, x) for z in (0, 1, 2) for y in (1, 2) for x in (1, 2)}
    with pytest.raises(Exception, match="reaches out"):
        preprocess.correct_mask(mask, v, ["roi"], mask_spacing=(20.0, 2.0, 2.0)).collect()
