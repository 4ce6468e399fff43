"""Surfaces of bodies whose measures are known; filters against numpy."""

import numpy as np
import pytest

from gridlore.operators import filters, morphology, shape


def table(spark, a, keys="roi int"):
    return spark.createDataFrame([(0, *map(int, i), float(a[tuple(i)])) for i in np.argwhere(np.ones(a.shape))], f"{keys}, z int, y int, x int, val double")


def image(df, size):
    out = np.full(size, np.nan)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r["val"]
    return out


def test_every_cell_surface_is_closed():
    for code in range(1, 255):
        t = shape.cell_triangles(code)
        assert len(t) and (np.abs(t * 2 - np.round(t * 2)) < 1e-12).all()
    rng = np.random.default_rng(0)
    for _ in range(5):
        t = shape.mesh(np.argwhere(rng.random((5, 6, 7)) < 0.5), (1, 1, 1))
        edges = {}
        for tri in np.round(t * 2).astype(int).tolist():
            p = [tuple(x) for x in tri]
            for e in ((p[0], p[1]), (p[1], p[2]), (p[2], p[0])):
                edges[e] = edges.get(e, 0) + 1
        assert all(edges.get(e[::-1]) == n for e, n in edges.items())  # each edge is run along both ways


def test_single_voxel_is_an_octahedron():
    t = shape.mesh(np.array([[0, 0, 0]]), (1, 1, 1))
    assert len(t) == 8
    assert (t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6 == pytest.approx(1 / 6)


def test_box(spark):
    n = 12
    v = spark.createDataFrame([(0, z, y, x, 1.0 + x) for z in range(n) for y in range(n) for x in range(n)], "roi int, z int, y int, x int, val double")
    r = shape.shape(v).first()
    assert r["VoxelVolume"] == n**3 and 0.9 * n**3 < r["MeshVolume"] < n**3
    assert r["MajorAxisLength"] == pytest.approx(4 * np.sqrt((n * n - 1) / 12)) and r["Elongation"] == pytest.approx(1) and r["Flatness"] == pytest.approx(1)
    assert r["VolumeDensityConvexHull"] == pytest.approx(1, abs=1e-5) and r["AreaDensityConvexHull"] == pytest.approx(1, abs=1e-5)
    assert r["Sphericity"] == pytest.approx(1 / r["SphericalDisproportion"]) and r["Asphericity"] == pytest.approx(1 / r["Sphericity"] - 1)
    x = np.arange(n)
    assert r["CentreOfMassShift"] == pytest.approx((x * (1 + x)).sum() / (1 + x).sum() - x.mean())
    assert r["Maximum2DDiameterSlice"] < r["Maximum3DDiameter"]


def test_spacing_scales(spark):
    v = spark.createDataFrame([(0, z, y, x, 1.0) for z in range(3) for y in range(4) for x in range(5)], "roi int, z int, y int, x int, val double")
    a, b = shape.shape(v).first(), shape.shape(v, spacing=(2.0, 2.0, 2.0)).first()
    assert b["MeshVolume"] == pytest.approx(8 * a["MeshVolume"]) and b["SurfaceArea"] == pytest.approx(4 * a["SurfaceArea"]) and b["Sphericity"] == pytest.approx(a["Sphericity"])


def test_hull_of_a_cloud():
    cube = np.array(np.meshgrid(*[[0.0, 1.0]] * 3)).reshape(3, -1).T
    inner = np.random.default_rng(0).random((200, 3))
    assert shape.hull(np.concatenate([cube, inner])) == pytest.approx((1.0, 6.0), abs=1e-6)


def test_ellipsoid_area():
    assert shape.ellipsoid_area((2, 2, 2)) == pytest.approx(16 * np.pi)
    assert shape.ellipsoid_area((2, 1, 2)) == pytest.approx(34.6875, abs=1e-3) and shape.ellipsoid_area((2, 1, 1)) == pytest.approx(21.4784, abs=1e-3)


def test_plane(spark):
    v = spark.createDataFrame([(0, 0, y, x, 1.0) for y in range(4) for x in range(6)], "roi int, z int, y int, x int, val double")
    r = shape.shape2d(v).first()
    assert r["PixelSurface"] == 24 and r["MeshSurface"] == pytest.approx(23.5) and r["Perimeter"] == pytest.approx(2 * (3 + 5) + 4 * np.sqrt(0.5))
    assert "SphericalDisproportion" not in r.asDict() and "SphericalDisproportion" in shape.shape2d(v, deprecated=True).columns


def _np_convolve(a, kernel, axis, mode):
    h = len(kernel) // 2
    pad = [(h, h) if n == axis else (0, 0) for n in range(3)]
    wide = np.pad(a, pad, mode={"mirror": "reflect", "reflect": "symmetric", "nearest": "edge", "wrap": "wrap", "constant": "constant"}[mode])
    return np.apply_along_axis(lambda x: np.convolve(x, kernel, "valid"), axis, wide)


@pytest.mark.parametrize("mode", ["mirror", "reflect", "nearest", "wrap", "constant"])
def test_convolution_at_the_ends(spark, mode):
    a = np.random.default_rng(0).normal(size=(5, 6, 7))
    k = [0.2, -1.0, 3.0, 0.5, 0.1]
    got = image(filters.convolve(table(spark, a), ["roi"], [k, None, k], mode), a.shape)
    assert np.allclose(got, _np_convolve(_np_convolve(a, np.array(k), 0, mode), np.array(k), 2, mode))


def test_pointwise_filters(spark):
    a = np.random.default_rng(0).normal(size=(2, 3, 4)) * 10
    m = np.abs(a).max()
    want = {"square": a * a / m, "squareroot": np.sign(a) * np.sqrt(np.abs(a) * m), "logarithm": np.sign(a) * np.log(np.abs(a) + 1) * m / np.log(m + 1), "exponential": np.exp(a * np.log(m) / m)}
    for n, w in want.items():
        assert np.allclose(image(filters.IMAGE_TYPES[n](table(spark, a)), a.shape), w), n


def test_stationary_wavelet_keeps_energy(spark):
    a = np.random.default_rng(0).normal(size=(6, 6, 8))
    energy = sum((image(b, a.shape) ** 2).sum() for _, b in filters.wavelet_bands(table(spark, a), level=1))
    assert energy == pytest.approx(8 * (a**2).sum())  # each axis doubles the samples of an orthogonal transform


def test_rotations_of_a_kernel_set():
    assert len(filters.rotations(((1, 2, 4), (1, 3, 9), (1, 5, 25)))) == 24
    assert len(filters.rotations((None, (1, 2, 4), (1, 3, 9)))) == 4
    assert len(filters.rotations(((1, 2, 1), (1, 2, 1), (1, 2, 1)))) == 1


def test_laplacian_of_a_parabola(spark):
    z, y, x = np.mgrid[:15, :15, :15].astype(float)
    got = image(filters.log(table(spark, z * z + y * y + x * x), sigma=1.0), (15, 15, 15))
    assert got[7, 7, 7] == pytest.approx(6, rel=0.01)


def test_simoncelli_bands_add_up():
    a, b = (filters.simoncelli_band((65, 65), n) for n in (1, 2))
    _, d = filters._frequencies((65, 65))
    inside = (d > 0.26) & (d < 0.49)
    assert np.allclose((a**2 + b**2)[inside], 1)


def test_gabor_answers_to_its_wave():
    y, x = np.mgrid[:64, :64]
    wave = np.cos(2 * np.pi * x / 8)
    along, across = (np.abs(filters.gabor_plane(wave, 4, 8, 1.0, t, "wrap"))[32, 32] for t in (0, np.pi / 2))
    assert along > 50 * across


def test_lbp_of_a_flat_and_an_edge_plane():
    flat = filters.lbp_plane(np.ones((5, 5)), 1, 8, "uniform")
    assert flat[2, 2] == 8
    peak = np.zeros((5, 5))
    peak[2, 2] = 1
    assert filters.lbp_plane(peak, 1, 8, "uniform")[2, 2] == 0 and filters.lbp_plane(peak, 1, 8, "default")[2, 2] == 0


def test_morphology(spark):
    rng = np.random.default_rng(0)
    m = rng.random((5, 6, 7)) < 0.5
    t = spark.createDataFrame([(0, *map(int, i)) for i in np.argwhere(m)], "roi int, z int, y int, x int")
    at = lambda df: {(r["z"], r["y"], r["x"]) for r in df.collect()}
    wide = np.pad(m, 1)
    d, e = morphology.grid_dilate(wide, morphology.diamond()), morphology.grid_erode(wide, morphology.diamond())
    assert at(morphology.dilate(t)) == {tuple(i - 1) for i in np.argwhere(d).tolist() for i in [np.array(i)]}
    assert at(morphology.erode(t)) == {tuple(i - 1) for i in np.argwhere(e).tolist() for i in [np.array(i)]}
    ring = np.zeros((3, 5, 5), bool)
    ring[:, 1:4, 1:4] = True
    ring[1, 2, 2] = False
    assert morphology.grid_fill(ring)[1, 2, 2] and morphology.grid_fill(ring).sum() == 27
    two = np.zeros((1, 4, 8), bool)
    two[0, 0, 0] = two[0, 1, 1] = two[0, 3, 5:8] = True
    assert morphology.grid_components(two).max() == 2 and morphology.grid_components(two, False).max() == 3
    assert morphology.keep_components(two, 3).sum() == 3
    assert morphology.distance_to(two, np.array([[0, 3, 2], [0, 0, 0]])).tolist() == [5**0.5, 0.0]
