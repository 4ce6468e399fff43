"""Binary patterns on a sphere against their definition."""

import numpy as np
import pytest

from gridlore.operators import filters


def test_icosphere():
    for n, corners in ((0, 12), (1, 42), (2, 162)):
        at = filters.icosphere(n)
        assert at.shape == (corners, 3) and np.allclose(np.linalg.norm(at, axis=1), 1) and np.allclose(at.sum(0), 0)


def test_harmonics_are_orthonormal():
    x, w = np.polynomial.legendre.leggauss(12)
    azimuth = np.arange(24) * 2 * np.pi / 24
    a, p = (g.ravel() for g in np.meshgrid(azimuth, np.arccos(x), indexing="ij"))
    weight = np.tile(w, 24) * 2 * np.pi / 24
    y = np.stack([filters._harmonic(n, m, a, p) for n in range(4) for m in range(-n, n + 1)])
    assert np.allclose((y * weight) @ y.conj().T, np.eye(len(y)), atol=1e-12)


def test_spline_of_a_volume():
    rng = np.random.default_rng(0)
    image = rng.normal(size=(4, 5, 3))
    spots = np.argwhere(np.ones(image.shape))
    assert np.allclose(filters.spline_at(image, spots.astype(float)), image.ravel(), atol=1e-10)
    assert (filters.spline_at(image, np.array([[-0.01, 0, 0], [3.01, 0, 0], [0, 0, 2.5]])) == 0).all()
    line = np.arange(20.0)[:, None, None] * np.ones((1, 4, 4))  # a straight line stays one, away from its ends
    assert filters.spline_at(line, np.array([[9.3, 1.5, 2.2]]))[0] == pytest.approx(9.3, abs=1e-4)


def test_patterns_by_the_definition(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(4, 4, 5)) * 10
    got = filters.lbp_volume(image, levels=3)
    corners = filters.icosphere(1)
    azimuth, polar = np.arccos(corners[:, 2]), np.arctan2(corners[:, 1], corners[:, 0])
    for spot in ((0, 0, 0), (1, 2, 3), (3, 3, 4), (2, 1, 0)):
        f = filters.spline_at(image, np.array(spot) + corners)
        b = (f >= image[spot]).astype(float)
        for n in range(3):
            g = np.zeros(len(corners), complex)
            for m in range(-n, n + 1):
                y = filters._harmonic(n, m, azimuth, polar)
                g += (b * y).sum() * y
            assert got[n][spot] == pytest.approx(np.sqrt((g**2).sum()).real, abs=1e-9)
        d = f - f.mean()
        assert got[3][spot] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    rows = [(0, *map(int, i), float(image[i])) for i in np.ndindex(image.shape)]
    v = spark.createDataFrame(rows, "roi int, z int, y int, x int, val double")
    out = {(r["z"], r["y"], r["x"]): r["val"] for r in filters.lbp3d(v, level=2, levels=3).collect()}
    assert all(out[i] == pytest.approx(got[1][i]) for i in out) and len(out) == image.size
    flat = filters.lbp_volume(np.full((5, 5, 5), 3.0))
    assert flat[2][2, 2, 2] == -3.0
