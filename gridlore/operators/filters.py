"""Image types: filters from a dense voxel table (keys, z, y, x, val) to another.

Point-wise filters are expressions. Separable filters work on lines: a line's values are gathered into an array,
which every position then reads its taps from, so an axis costs one shuffle and no row is multiplied. Filters of the
frequency domain and of texture codes take a whole image into a task (numpy).

`IMAGE_TYPES` holds all by name; `@image_type` adds more.
"""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.voxels import AXES

IMAGE_TYPES: dict = {}


def image_type(name: str):
    """Registers f(v, keys, **settings) as the image type `name`."""

    def add(f):
        IMAGE_TYPES[name] = f
        return f

    return add


def dense(v: DataFrame, keys, fill: float = 0.0) -> DataFrame:
    """Every place of the box around each image's voxels; missing ones get fill."""
    box = v.groupBy(*keys).agg(*(f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    for a in AXES:
        box = box.withColumn(a, F.explode(F.sequence(f"lo{a}", f"hi{a}")))
    at = [*keys, *AXES]
    return box.select(*at).join(v.select(*at, "val"), at, "left").select(*at, F.coalesce("val", F.lit(float(fill))).alias("val"))


@image_type("original")
def original(v, keys=("roi",), **_):
    return v


def _with_peak(v, keys):
    """Adds the image's largest absolute value."""
    peak = v.groupBy(*keys).agg(F.max(F.abs("val")).alias("__m"))
    return v.join(peak, list(keys))


def _pointwise(v, keys, f):
    m = F.col("__m")
    return _with_peak(v, keys).withColumn("val", F.when(m == 0, F.lit(float("nan"))).otherwise(f(F.col("val"), F.when(m == 0, 1.0).otherwise(m)))).drop("__m")


@image_type("square")
def square(v, keys=("roi",), **_):
    return _pointwise(v, keys, lambda x, m: x * x / m)


@image_type("squareroot")
def squareroot(v, keys=("roi",), **_):
    return _pointwise(v, keys, lambda x, m: F.signum(x) * F.sqrt(F.abs(x) * m))


@image_type("logarithm")
def logarithm(v, keys=("roi",), **_):
    return _pointwise(v, keys, lambda x, m: F.signum(x) * F.log1p(F.abs(x)) * m / F.log1p(m))


@image_type("exponential")
def exponential(v, keys=("roi",), **_):
    return _pointwise(v, keys, lambda x, m: F.exp(x * F.log(m) / m))


def _source(i, n, boundary: str):
    """Where a position off the line is read, by boundary; null: the constant."""
    if boundary == "wrap":
        return F.pmod(i, n)
    if boundary == "nearest":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if boundary == "reflect":  # d c b a | a b c d
        m = F.pmod(i, 2 * n)
        return F.when(m >= n, 2 * n - 1 - m).otherwise(m)
    if boundary == "mirror":  # d c b | a b c d
        m = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
        return F.when(m >= n, 2 * n - 2 - m).otherwise(m)
    if boundary == "constant":
        return F.when((i >= 0) & (i < n), i)
    raise ValueError(f"no such boundary: {boundary}")


def convolve_axis(v: DataFrame, keys, axis: str, taps: dict[int, float], boundary: str = "mirror", constant: float = 0.0) -> DataFrame:
    """val at i becomes the sum of weight x val at i + offset. taps: offset to weight."""
    rest = [a for a in AXES if a != axis]
    line = v.groupBy(*keys, *rest).agg(F.array_sort(F.collect_list(F.struct(axis, "val"))).alias("line"))
    n = F.size("line")
    value = lambda i, o: F.coalesce(F.get("line.val", _source(i + o, n, boundary)), F.lit(float(constant)))

    def total(i):
        out = None
        for o, w in sorted(taps.items()):
            if w:
                t = value(i, o) * w
                out = t if out is None else out + t
        return F.lit(0.0) if out is None else out

    new = F.transform("line", lambda x, i: F.struct(x[axis].alias(axis), total(i).alias("val")))
    return line.select(*keys, *rest, F.explode(new).alias("p")).select(*keys, *AXES[: AXES.index(axis)], f"p.{axis}", *AXES[AXES.index(axis) + 1 :], "p.val")


def convolve(v: DataFrame, keys, kernels, boundary: str = "mirror", constant: float = 0.0) -> DataFrame:
    """Separable convolution. kernels: for z, y, x a list of weights (as in a convolution, so flipped) or None."""
    for axis, k in zip(AXES, kernels):
        if k is not None:
            half = len(k) // 2
            v = convolve_axis(v, keys, axis, {half - i: float(w) for i, w in enumerate(k)}, boundary, constant)
    return v


def pool(images: list[DataFrame], keys, method: str) -> DataFrame:
    """Voxel by voxel the max, min or mean of images over the same places."""
    how = {"max": F.max, "min": F.min, "mean": F.avg, "average": F.avg, "sum": F.sum}[method]
    if len(images) == 1:
        return images[0]
    out = images[0]
    for i in images[1:]:
        out = out.unionByName(i)
    return out.groupBy(*keys, *AXES).agg(how("val").alias("val"))


def rotations(kernels) -> list[tuple]:
    """The kernels under all proper rotations of the grid (24 in space, 4 in a plane), each distinct set once."""
    free = [i for i, k in enumerate(kernels) if k is not None]
    out, seen = [], set()
    for order in permutations(free):
        odd = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order))) % 2
        for flips in product((False, True), repeat=len(free)):
            if (odd + sum(flips)) % 2 == 0:
                k = list(kernels)
                for to, (at, flip) in zip(free, zip(order, flips)):
                    k[to] = tuple(kernels[at][::-1]) if flip else tuple(kernels[at])
                if tuple(k) not in seen:
                    seen.add(tuple(k))
                    out.append(tuple(k))
    return out


@image_type("mean")
def mean(v, keys=("roi",), size: int = 3, boundary: str = "reflect", flat_axis: int | None = None, **_):
    """Local mean over a cube of `size`; an even one reaches further back."""
    for n, axis in enumerate(AXES):
        if n != flat_axis:
            v = convolve_axis(v, keys, axis, {o - size // 2: 1 / size for o in range(size)}, boundary)
    return v


def gaussian(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian, or of its second derivative."""
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    return list(g if order == 0 else g * (x * x / sigma**4 - 1 / sigma**2))


@image_type("log")
def log(v, keys=("roi",), sigma: float = 1.0, spacing=(1.0, 1.0, 1.0), flat_axis: int | None = None, boundary: str = "reflect", truncate: float = 4.0, **_):
    """Laplacian of a Gaussian of `sigma` mm, sampled and cut at `truncate` sigmas. spacing: of z, y, x."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    axes = [n for n in range(3) if n != flat_axis]
    parts = []
    for second in axes:
        kernels = [gaussian(sigma / spacing[n], 2 if n == second else 0, truncate) if n in axes else None for n in range(3)]
        parts.append(convolve(v, keys, kernels, boundary))
    return pool(parts, keys, "sum")


#: Laws' kernels, before they are brought to length 1.
LAWS = {
    "l5": (1, 4, 6, 4, 1), "e5": (-1, -2, 0, 2, 1), "s5": (-1, 0, 2, 0, -1), "w5": (-1, 2, 0, -2, 1), "r5": (1, -4, 6, -4, 1),
    "l3": (1, 2, 1), "e3": (-1, 0, 1), "s3": (-1, 2, -1),
}


@image_type("laws")
def laws(v, keys=("roi",), kernels: str = "l5e5s5", rotational: bool = False, pooling: str = "max", energy: int | None = None, boundary: str = "mirror", constant: float = 0.0, **_):
    """Laws' response: kernel names for x, y and, in space, z. energy: the local mean of its size over 2 x energy + 1."""
    named = [LAWS[kernels[i : i + 2].lower()] for i in range(0, len(kernels), 2)]
    unit = [tuple(float(w) / math.sqrt(sum(x * x for x in k)) for w in k) for k in named]
    zyx = (None,) * (3 - len(unit)) + tuple(reversed(unit))
    sets = rotations(zyx) if rotational else [zyx]
    out = pool([convolve(v, keys, k, boundary, constant) for k in sets], keys, pooling)
    if energy is not None:
        box = [1.0 / (2 * energy + 1)] * (2 * energy + 1)
        out = convolve(out.withColumn("val", F.abs("val")), keys, [None if k is None else box for k in zyx], boundary, constant)
    return out


#: Low-pass decomposition filters of orthogonal wavelets. The high-pass ones follow.
LOW_PASS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db2": (-0.12940952255126037, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416),
    "db3": (0.03522629188570953, -0.08544127388202666, -0.13501102001025458, 0.45987750211849154, 0.8068915093110925, 0.33267055295008263),
    "coif1": (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539),
}


def wavelet_taps(name: str, part: str) -> tuple[float, ...]:
    low = LOW_PASS[name]
    return low if part.lower() == "l" else tuple((-1) ** (k + 1) * w for k, w in enumerate(reversed(low)))


@image_type("wavelet")
def wavelet(v, keys=("roi",), name: str = "coif1", combination: str = "LLH", level: int = 1, **_):
    """A band of the stationary wavelet transform with periodic ends. combination: L or H for z, y, x at the last level; levels before are L."""
    for n in range(level):
        for axis, part in zip(AXES, combination if n == level - 1 else "L" * len(combination)):
            taps = wavelet_taps(name, part)
            middle = len(taps) // 2 << n
            v = convolve_axis(v, keys, axis, {middle - (k << n): w for k, w in enumerate(taps)}, "wrap")
    return v


def wavelet_bands(v, keys=("roi",), name: str = "coif1", level: int = 1, start: int = 0):
    """(name, image) of all bands of levels start to start + level - 1, and the last approximation."""
    bands = ["".join(b) for b in product("LH", repeat=3)]
    for n in range(start, start + level):
        for b in bands[1:]:
            yield f"wavelet-{b}" if n == 0 else f"wavelet{n + 1}-{b}", wavelet(v, keys, name, b, n + 1)
    n = start + level
    yield "wavelet-LLL" if n == 1 else f"wavelet{n}-LLL", wavelet(v, keys, name, "LLL", n)


@image_type("ibsiwavelet")
def ibsi_wavelet(v, keys=("roi",), name: str = "db3", combination: str = "LH", level: int = 1, rotational: bool = False, pooling: str = "mean", boundary: str = "mirror", **_):
    """Undecimated separable wavelet response. combination: for x, y and, in space, z; kernels are dilated by level."""

    def odd(k):
        return tuple(k) + (0.0,) * (len(k) % 2 == 0)

    def dilated(k, n):
        if k is None or not n:
            return k
        step = 1 << n
        return odd([k[i // step] if i % step == 0 else 0.0 for i in range((len(k) - 1) * step + 1)])

    each = [odd(wavelet_taps(name, c)) for c in combination]
    zyx = (None,) * (3 - len(each)) + tuple(reversed(each))
    low = tuple(None if k is None else odd(wavelet_taps(name, "l")) for k in zyx)
    out = []
    for k in rotations(zyx) if rotational else [zyx]:
        image = v
        for n in range(level):
            image = convolve(image, keys, [dilated(x, n) for x in (k if n == level - 1 else low)], boundary)
        out.append(image)
    return pool(out, keys, pooling)


@image_type("gradient")
def gradient(v, keys=("roi",), spacing=(1.0, 1.0, 1.0), use_spacing: bool = True, **_):
    """Length of the gradient by central differences; the image goes on beyond its ends with their values."""
    parts = []
    for axis, step in zip(AXES, spacing):
        h = float(step) if use_spacing else 1.0
        d = convolve_axis(v, keys, axis, {-1: -0.5 / h, 1: 0.5 / h}, "nearest")
        parts.append(d.withColumn("val", F.col("val") * F.col("val")))
    return pool(parts, keys, "sum").withColumn("val", F.sqrt("val"))


def _whole_image(v: DataFrame, keys, f) -> DataFrame:
    """f from array (z, y, x) to array, image by image."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(AXES)].to_numpy()
        low = at.min(0)
        spot = tuple((at - low).T)
        image = np.zeros(at.max(0) - low + 1)
        image[spot] = pdf["val"].to_numpy()
        return pdf.assign(val=np.asarray(f(image), float)[spot])[[*keys, *AXES, "val"]]

    schema = StructType([*v.select(*keys, *AXES).schema.fields]).add("val", "double")
    return v.select(*keys, *AXES, "val").groupBy(*keys).applyInPandas(run, schema)


def _response(c: np.ndarray, kind: str) -> np.ndarray:
    return {"modulus": np.abs, "real": np.real, "imaginary": np.imag, "angle": np.angle}[kind](c)


_PAD = {"mirror": "reflect", "reflect": "symmetric", "nearest": "edge", "wrap": "wrap", "constant": "constant"}


def gabor_plane(plane: np.ndarray, sigma: float, wavelength: float, gamma: float, theta: float, boundary: str) -> np.ndarray:
    """Complex Gabor response of a plane: a Gaussian envelope, stretched by gamma, around a wave along theta."""
    half = [s // 2 for s in plane.shape]
    y, x = np.meshgrid(*(np.arange(-h, h + 1) for h in half), indexing="ij")
    along, across = y * np.sin(theta) + x * np.cos(theta), -y * np.cos(theta) + x * np.sin(theta)
    kernel = np.exp(-(along**2 + (gamma * across) ** 2) / (2 * sigma**2) + 2j * np.pi * along / wavelength)
    wide = np.pad(plane, [(h, h) for h in half], mode=_PAD[boundary])
    shape = [a + b - 1 for a, b in zip(wide.shape, kernel.shape)]
    full = np.fft.ifft2(np.fft.fft2(wide, shape) * np.fft.fft2(kernel, shape))
    return full[2 * half[0] : 2 * half[0] + plane.shape[0], 2 * half[1] : 2 * half[1] + plane.shape[1]]


@image_type("gabor")
def gabor(v, keys=("roi",), sigma: float = 5.0, wavelength: float = 2.0, gamma: float = 1.5, thetas=None, axes=(0,), spacing=(1.0, 1.0, 1.0), response: str = "modulus", pooling: str = "mean", boundary: str = "mirror", **_):
    """Gabor responses in the planes across `axes`, pooled over them and over thetas. Lengths in mm."""
    turns = list(np.arange(0.0, np.pi, np.pi / 8)) if thetas is None else list(thetas)
    how = {"mean": np.mean, "max": np.max, "min": np.min}[pooling]

    def f(image):
        out = []
        for axis in axes:
            step = max(s for n, s in enumerate(spacing) if n != axis)
            planes = np.moveaxis(image, axis, 0)
            for t in turns:
                r = np.stack([_response(gabor_plane(p, sigma / step, wavelength / step, gamma, t, boundary), response) for p in planes])
                out.append(np.moveaxis(r, 0, axis))
        return how(np.stack(out), axis=0)

    return _whole_image(v, keys, f)


def _frequencies(shape):
    """Coordinates from -1 to 1 along each axis, and the distance from the middle."""
    c = [np.zeros(n) if n < 2 else np.linspace(-1, 1, n) for n in shape]
    grid = np.meshgrid(*c, indexing="ij")
    return grid, np.sqrt(sum(g * g for g in grid))


def simoncelli_band(shape, level: int) -> np.ndarray:
    """Band-pass of a decomposition level, between a quarter of its highest frequency and that."""
    _, d = _frequencies(shape)
    top = 2.0 ** (1 - level)
    inside = (d >= top / 4) & (d <= top)
    return np.where(inside, np.cos(np.pi / 2 * np.log2(np.where(inside, 2 * d / top, 1.0))), 0.0)


def _filtered(image: np.ndarray, transfer: np.ndarray) -> np.ndarray:
    return np.fft.ifftn(np.fft.fftn(image) * np.fft.ifftshift(transfer))


def _by_slice(f, flat_axis):
    if flat_axis is None:
        return f
    return lambda image: np.moveaxis(np.stack([f(p) for p in np.moveaxis(image, flat_axis, 0)]), 0, flat_axis)


@image_type("simoncelli")
def simoncelli(v, keys=("roi",), level: int = 1, response: str = "real", flat_axis: int | None = None, **_):
    return _whole_image(v, keys, _by_slice(lambda p: _response(_filtered(p, simoncelli_band(p.shape, level)), response), flat_axis))


def riesz_factor(order) -> complex:
    n = sum(order)
    return (-1j) ** n * math.sqrt(math.factorial(n) / math.prod(map(math.factorial, order)))


def riesz_transfer(shape, order) -> np.ndarray:
    """Multiplier of the Riesz transform of an order (for each axis); zero in the middle."""
    grid, d = _frequencies(shape)
    if not sum(order):
        return np.ones(shape, complex)
    safe = np.where(d > 0, d, 1.0)
    m = riesz_factor(order) * np.ones(shape, complex)
    for g, n in zip(grid, order):
        m *= (g / safe) ** n if n else 1
    return np.where(d > 0, m, 0)


def riesz_plain(image, level, order):
    return _filtered(image, simoncelli_band(image.shape, level) * riesz_transfer(image.shape, order))


def _smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    k = np.array(gaussian(sigma))
    for axis in range(a.ndim):
        wide = np.pad(a, [(len(k) // 2,) * 2 if n == axis else (0, 0) for n in range(a.ndim)], mode="reflect" if a.shape[axis] > 1 else "edge")
        a = np.apply_along_axis(np.convolve, axis, wide, k, mode="valid")
    return a


def riesz_steered(image, level, order, sigma):
    """Responses of all orders of the same degree, weighted by the local direction of the gradient."""
    g = [np.gradient(image, axis=n) if image.shape[n] > 1 else np.zeros_like(image) for n in range(image.ndim)]
    g = [_smoothed(c, sigma) if sigma else c for c in g]
    norm = np.sqrt(sum(c * c for c in g))
    way = [np.where(norm > 0, c / np.where(norm > 0, norm, 1), 0) for c in g]
    n, out = sum(order), np.zeros(image.shape, complex)
    for o in product(range(n + 1), repeat=image.ndim):
        if sum(o) == n:
            weight = np.full(image.shape, riesz_factor(o).real)
            for w, k in zip(way, o):
                weight = weight * w**k
            out += weight * riesz_plain(image, level, o)
    return out


@image_type("riesz")
def riesz(v, keys=("roi",), level: int = 1, order=(1, 0, 0), response: str = "real", steering: bool = False, sigma: float = 1.0, flat_axis: int | None = None, **_):
    f = (lambda p: riesz_steered(p, level, order, sigma)) if steering else (lambda p: riesz_plain(p, level, order))
    return _whole_image(v, keys, _by_slice(lambda p: _response(f(p), response), flat_axis))


def lbp_plane(plane: np.ndarray, radius: float, samples: int, method: str) -> np.ndarray:
    """Codes of local binary patterns: bit k is set if the k-th sample on the circle (bilinear, zero outside) is not below the centre."""
    wide = np.pad(plane, int(math.ceil(radius)) + 1)
    pad = int(math.ceil(radius)) + 1
    y, x = np.mgrid[: plane.shape[0], : plane.shape[1]]
    bits, values = [], []
    for k in range(samples):
        a = 2 * math.pi * k / samples
        r, c = round(-radius * math.sin(a), 5), round(radius * math.cos(a), 5)
        fy, fx = math.floor(r), math.floor(c)
        dy, dx = r - fy, c - fx
        at = lambda i, j: wide[y + pad + fy + i, x + pad + fx + j]  # noqa: B023, E731
        t = at(0, 0) * (1 - dy) * (1 - dx) + (at(1, 0) * dy * (1 - dx) if dy else 0) + (at(0, 1) * (1 - dy) * dx if dx else 0) + (at(1, 1) * dy * dx if dy and dx else 0)
        values.append(t)
        bits.append(t - plane >= 0)
    b = np.stack(bits).astype(np.int64)
    if method == "default":
        return (b << np.arange(samples)[:, None, None]).sum(0).astype(float)
    if method == "ror":
        turned = [(np.roll(b, s, 0) << np.arange(samples)[:, None, None]).sum(0) for s in range(samples)]
        return np.min(turned, 0).astype(float)
    if method == "var":
        return np.stack(values).var(0)
    changes = (b != np.roll(b, -1, 0))[:-1].sum(0) if samples > 1 else np.zeros(plane.shape)
    return np.where(changes <= 2, b.sum(0), samples + 1).astype(float)


@image_type("lbp2d")
def lbp2d(v, keys=("roi",), radius: float = 1.0, samples: int = 8, method: str = "uniform", flat_axis: int = 0, **_):
    return _whole_image(v, keys, _by_slice(lambda p: lbp_plane(p, radius, samples, method), flat_axis))


def icosphere(subdivisions: int = 1) -> np.ndarray:
    """Corners on the unit sphere: an icosahedron's (0, 1, golden ratio, in all signs and cyclic orders), and the middles of the edges
    of each subdivision, brought out to the sphere."""
    gold = (1 + math.sqrt(5)) / 2
    at = np.array([np.roll((0.0, a, b * gold), k) for k in range(3) for a in (-1, 1) for b in (-1, 1)])
    at /= np.linalg.norm(at[0])
    near = np.isclose(np.linalg.norm(at[:, None] - at[None], axis=-1), 2 / math.sqrt(1 + gold * gold))
    faces = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if near[a, b] and near[b, c] and near[a, c]]
    for _ in range(subdivisions):
        middle: dict[tuple[int, int], int] = {}
        corners = list(at)

        def between(a, b, middle=middle, corners=corners):
            edge = (min(a, b), max(a, b))
            if edge not in middle:
                m = corners[a] + corners[b]
                corners.append(m / np.linalg.norm(m))
                middle[edge] = len(corners) - 1
            return middle[edge]

        split = []
        for a, b, c in faces:
            ab, bc, ca = between(a, b), between(b, c), between(c, a)
            split += [(a, ab, ca), (b, ab, bc), (c, bc, ca), (ab, bc, ca)]
        at, faces = np.array(corners), split
    return at


def _harmonic(n: int, m: int, azimuth: np.ndarray, polar: np.ndarray) -> np.ndarray:
    """The spherical harmonic of degree n and order m, by the recurrence of associated Legendre functions."""
    k, x = abs(m), np.cos(polar)
    low, now = np.zeros_like(x), np.prod(np.arange(1, 2 * k, 2.0)) * (-1) ** k * (1 - x * x) ** (k / 2)
    for d in range(k, n):
        low, now = now, ((2 * d + 1) * x * now - (d + k) * low) / (d - k + 1)
    y = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k)) * now * np.exp(1j * k * azimuth)
    return y if m >= 0 else (-1) ** k * np.conj(y)


def spline_at(image: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cubic spline values of an image, mirrored at its ends, at places (rows z, y, x); 0 outside of the box of its voxels' centres."""
    from gridlore.operators.preprocess import POLE, REACH

    c = image.astype(float)
    for axis, n in enumerate(image.shape):
        fold = np.arange(-REACH, n + REACH) % max(2 * n - 2, 1)
        wide = np.take(c, np.where(fold >= n, 2 * n - 2 - fold, fold), axis)
        c = sum(-6 * POLE / (1 - POLE * POLE) * POLE ** abs(k) * np.take(wide, np.arange(n) + REACH + k, axis) for k in range(-REACH, REACH + 1))
    size = np.array(image.shape)
    ok = ((places >= 0) & (places <= size - 1)).all(1)
    base = np.floor(places).astype(int)
    f = places - base
    g = 1 - f
    weights = np.stack([g**3 / 6, 2 / 3 - f * f * (2 - f) / 2, 2 / 3 - g * g * (2 - g) / 2, f**3 / 6])
    out = np.zeros(len(places))
    for o in product(range(4), repeat=3):
        at = (base + np.array(o) - 1) % np.maximum(2 * size - 2, 1)
        at = np.clip(np.where(at >= size, 2 * size - 2 - at, at), 0, size - 1)
        out += np.prod([weights[k, :, d] for d, k in enumerate(o)], axis=0) * c[tuple(at.T)]
    return np.where(ok, out, 0.0)


def lbp_volume(image: np.ndarray, levels: int = 2, radius: float = 1.0, subdivisions: int = 1) -> list[np.ndarray]:
    """Binary patterns on a sphere around each voxel: which of its corners are no lower than the centre, projected on spherical
    harmonics of each degree below `levels` (the length of each projection does not change as the pattern turns), and at last the
    excess kurtosis of the values on the sphere. Angles are taken as the definition has them: polar angle in the azimuth's place."""
    corners = icosphere(subdivisions) * radius
    azimuth, polar = np.arccos(corners[:, 2] / radius), np.arctan2(corners[:, 1], corners[:, 0])
    kernels = [sum(np.outer(y, y) for y in (_harmonic(n, m, azimuth, polar) for m in range(-n, n + 1))) for n in range(levels)]
    spots = np.argwhere(np.ones(image.shape, bool))
    values = np.stack([spline_at(image, spots + c) for c in corners], 1)
    # Equal values differ in their last digits after the spline.
    above = (values >= image.ravel()[:, None] - 1e-9 * np.maximum(1, np.abs(image.ravel()[:, None]))).astype(float)
    out = [np.sqrt(((above @ k) ** 2).sum(1)).real.reshape(image.shape) for k in kernels]
    d = values - values.mean(1, keepdims=True)
    square = (d * d).mean(1)
    flat = square <= 1e-18 * np.maximum(1, np.abs(values).max(1)) ** 2
    return [*out, np.where(flat, -3.0, (d**4).mean(1) / np.where(flat, 1, square) ** 2 - 3).reshape(image.shape)]


@image_type("lbp3d")
def lbp3d(v, keys=("roi",), level: int = 1, levels: int = 2, radius: float = 1.0, subdivisions: int = 1, **_):
    """One image of `lbp_volume`: level 1 to `levels`, or 0 for the kurtosis."""
    return _whole_image(v, keys, lambda p: lbp_volume(p, levels, radius, subdivisions)[level - 1])
