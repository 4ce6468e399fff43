"""Preprocessing: checks, crops, resampling, normalisation, resegmentation, PET and MR intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.voxels import AXES


def label_mask(mask: DataFrame, label: int = 1, channel: int | None = None) -> DataFrame:
    """Rows of a label; with a channel, `label` is an array of one label for each."""
    value = F.col("label") if channel is None else F.get("label", channel)
    return mask.filter(value == label)


def isolate_label(mask: DataFrame, label: int, output: int = 1) -> DataFrame:
    return mask.filter(F.col("label") == label).withColumn("label", F.lit(output))


def check_mask(mask: DataFrame, keys=("roi",), minimum_dimensions: int = 2, minimum_size: int | None = None) -> DataFrame:
    """A row for each region: its box, extents and size, and what is wrong with it (null: nothing)."""
    m = mask.groupBy(*keys).agg(F.count("*").alias("voxels"), *(f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))))
    wide = sum(((F.col(f"max_{a}") > F.col(f"min_{a}")).cast("int") for a in AXES), F.lit(0))
    m = m.withColumn("dimensions", wide)
    wrong = F.when(F.col("voxels") <= 1, "a single voxel").when(F.col("dimensions") < minimum_dimensions, "too few dimensions")
    if minimum_size is not None:
        wrong = wrong.when(F.col("voxels") <= minimum_size, "too few voxels")
    return m.withColumn("problem", wrong)


def valid_or_fail(mask: DataFrame, keys=("roi",), **how) -> DataFrame:
    """mask, which fails when read if a region is unfit."""
    bad = check_mask(mask, keys, **how)
    ok = bad.select(*keys, F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("region not usable: "), "problem"))).alias("__ok"))
    return mask.join(ok.filter(F.col("__ok").isNull()).drop("__ok"), list(keys), "left_semi")


def crop(image: DataFrame, mask: DataFrame, keys=("roi",), pad=(0, 0, 0)) -> DataFrame:
    """The image within the mask's box, which reaches `pad` voxels (z, y, x) further."""
    box = mask.groupBy(*keys).agg(*(f(a).alias(f"__{n}{a}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    j = image.join(box, list(keys))
    for a, p in zip(AXES, pad):
        j = j.filter(F.col(a).between(F.col(f"__lo{a}") - p, F.col(f"__hi{a}") + p))
    return j.select(*image.columns)


def crop_margin(image: DataFrame, mask: DataFrame, keys=("roi",), margin_mm: float = 50.0, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    return crop(image, mask, keys, [int(-(-margin_mm // s)) for s in spacing])


def normalize(v: DataFrame, keys=("roi",), scale: float = 1.0, outliers: float | None = None) -> DataFrame:
    """Whole-image z-score (sample deviation), cut at outliers, times scale."""
    s = v.groupBy(*keys).agg(F.avg("val").alias("__m"), F.stddev_samp("val").alias("__s"))
    z = (F.col("val") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    if outliers is not None:
        z = F.greatest(F.least(z, F.lit(float(outliers))), F.lit(-float(outliers)))
    return v.join(s, list(keys)).withColumn("val", z * scale).drop("__m", "__s")


def zscore_roi(image: DataFrame, mask: DataFrame, keys=("roi",), clip: float | None = 3.0, scale: float = 100.0, shift: float = 300.0) -> DataFrame:
    """z-score of the image by the region's mean and population deviation (0 counts as 1), cut, scaled and shifted."""
    inside = image.join(mask.select(*keys, *AXES), [*keys, *AXES], "left_semi").filter(~F.isnan("val"))
    s = inside.groupBy(*keys).agg(F.avg("val").alias("__m"), F.stddev_pop("val").alias("__s"))
    z = (F.col("val") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    if clip:
        z = F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip)))
    return image.join(s, list(keys)).withColumn("val", z * scale + shift).drop("__m", "__s")


def clip_intensity(v: DataFrame, low: float, high: float) -> DataFrame:
    return v.withColumn("val", F.greatest(F.least(F.col("val"), F.lit(float(high))), F.lit(float(low))))


def mr_normalize(image: DataFrame, reference: DataFrame, keys=("roi",), target: float = 1.0, statistic: str = "median") -> DataFrame:
    """Scales an image so that the reference mask's median or mean becomes target."""
    how = {"median": lambda c: F.percentile(c, 0.5), "mean": F.avg}[statistic]
    r = image.join(reference.select(*keys, *AXES), [*keys, *AXES], "left_semi").filter(~F.isnan("val")).groupBy(*keys).agg(how("val").alias("__r"))
    fail = F.raise_error(F.lit("reference tissue statistic is zero")).cast("double")
    return image.join(r, list(keys)).withColumn("val", F.col("val") * (target / F.when(F.col("__r") == 0, fail).otherwise(F.col("__r")))).drop("__r")


def resegment(v: DataFrame, keys=("roi",), limits=(), mode: str = "absolute") -> DataFrame:
    """Keeps voxels from the lower to the upper limit, both included: values, shares of the maximum, or deviations from the mean."""
    if not 1 <= len(limits) <= 2:
        raise ValueError("one or two limits are needed")
    s = v.groupBy(*keys).agg(F.max("val").alias("__max"), F.avg("val").alias("__m"), F.stddev_pop("val").alias("__s"))
    at = {"absolute": F.lit, "relative": lambda t: F.col("__max") * t, "sigma": lambda t: F.col("__m") + F.col("__s") * t}[mode]
    low, *high = sorted(map(float, limits))
    out = v.join(s, list(keys)).filter(F.col("val") >= at(low))
    for h in high:
        out = out.filter(F.col("val") <= at(h))
    return out.select(*v.columns)


#: The pole of the cubic spline filter, and how far its response is followed (to 1e-14 of it).
POLE = 3**0.5 - 2
REACH = 24


def spline_coefficients(v: DataFrame, keys) -> DataFrame:
    """val becomes the cubic spline's coefficient; an image goes on beyond its ends mirrored about its last voxels. The filter is
    recursive; here its response, which falls to a quarter with every voxel, is a convolution along each axis."""
    from gridlore.operators.filters import convolve_axis

    taps = {k: -6 * POLE / (1 - POLE * POLE) * POLE ** abs(k) for k in range(-REACH, REACH + 1)}
    for a in AXES:
        v = convolve_axis(v, keys, a, taps, "mirror")
    return v


def _spline_weights(f: Column):
    """Weights of the voxels one before to two behind a place, f of the way from one voxel to the next."""
    g = 1 - f
    return [g * g * g / 6, 2 / F.lit(3.0) - f * f * (2 - f) / 2, 2 / F.lit(3.0) - g * g * (2 - g) / 2, f * f * f / 6]


def sampled(v: DataFrame, keys, places: DataFrame, interpolator: str = "linear") -> DataFrame:
    """Values at places (keys, n<axis>: index in the new grid, p<axis>: place in the old, within its box lo<axis> to hi<axis>).
    Linear weights are over the neighbours there are. Splines are taken of whole boxes, mirrored at the ends."""
    keys, one = list(keys), lambda c, w: F.struct(c.cast("int").alias("c"), w.cast("double").alias("f"))
    if interpolator == "bspline":
        v = spline_coefficients(v, keys)
    elif interpolator not in ("nearest", "linear"):
        raise ValueError(f"no such interpolator: {interpolator}")
    near = places.withColumn("w", F.lit(1.0))
    for a in AXES:
        p = F.col(f"p{a}")
        base = F.floor(p)
        f = p - base
        if interpolator == "nearest":
            near = near.withColumn(a, F.floor(p + 0.5).cast("int"))
            continue
        if interpolator == "linear":
            ends = F.array(one(base, 1 - f), one(base + 1, f))
        else:
            lo, n = F.col(f"lo{a}"), F.col(f"hi{a}") - F.col(f"lo{a}") + 1
            turn = lambda c, lo=lo, n=n: F.pmod(c - lo, F.greatest(2 * n - 2, F.lit(1)))
            folded = lambda c, lo=lo, n=n: lo + F.when(turn(c) >= n, 2 * n - 2 - turn(c)).otherwise(turn(c))
            ends = F.array(*(one(folded(base + k - 1), w) for k, w in enumerate(_spline_weights(f))))
        near = near.withColumn("e", F.explode(ends)).withColumn(a, F.col("e.c")).withColumn("w", F.col("w") * F.col("e.f")).drop("e").filter("w <> 0")
    j = near.select(*keys, *(f"n{a}" for a in AXES), *AXES, "w").join(v.select(*keys, *AXES, "val"), [*keys, *AXES])
    return j.groupBy(*keys, *(F.col(f"n{a}").alias(a) for a in AXES)).agg((F.sum(F.col("w") * F.col("val")) / F.sum("w")).alias("val"))


def _boxes(v: DataFrame, keys) -> DataFrame:
    return v.groupBy(*keys).agg(*(f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))


def resample(v: DataFrame, keys=("roi",), spacing=(1.0, 1.0, 1.0), to=(2.0, 2.0, 2.0), interpolator: str = "linear", rounded: bool = False) -> DataFrame:
    """A grid of another spacing (z, y, x; 0 keeps it), centred on the old one. spacing: of all images, or a table (some of the keys,
    spacing_z, spacing_y, spacing_x)."""
    grid = _boxes(v, keys)
    by_case = isinstance(spacing, DataFrame)
    if by_case:
        grid = grid.join(spacing, [c for c in spacing.columns if c in keys])
    for a, s, t in zip(AXES, AXES if by_case else spacing, to):
        s = F.col(f"spacing_{a}") if by_case else F.lit(float(s))
        t = F.lit(float(t)) if t else s
        n = F.col(f"hi{a}") - F.col(f"lo{a}") + 1
        m = F.greatest(F.lit(1), F.ceil(n * s / t)).cast("int")
        start = F.col(f"lo{a}") + (n - 1) / 2.0 - (m - 1) * (t / s) / 2.0
        grid = grid.withColumn(f"n{a}", F.explode(F.sequence(F.lit(0), m - 1))).withColumn(f"p{a}", F.greatest(F.col(f"lo{a}").cast("double"), F.least(F.col(f"hi{a}").cast("double"), start + F.col(f"n{a}") * (t / s))))
    j = sampled(v, keys, grid, interpolator)
    return j.withColumn("val", F.rint("val")) if rounded else j


def resample_to(v: DataFrame, reference: DataFrame, keys=("roi",), spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), reference_spacing=(1.0, 1.0, 1.0), reference_origin=(0.0, 0.0, 0.0), interpolator: str = "linear", outside: float = 0.0) -> DataFrame:
    """v on the places of a reference table (keys, z, y, x), both grids given by spacing and origin (z, y, x) in mm. Places beyond half
    a voxel outside of v's box get `outside`."""
    box = _boxes(v, keys)
    places = reference.select(*keys, *(F.col(a).alias(f"n{a}") for a in AXES)).distinct()
    at, inside = places.join(box, list(keys)), F.lit(True)
    for a, s, o, rs, ro in zip(AXES, spacing, origin, reference_spacing, reference_origin):
        p = (F.lit(float(ro)) + F.col(f"n{a}") * float(rs) - float(o)) / float(s)
        inside = inside & p.between(F.col(f"lo{a}") - 0.5, F.col(f"hi{a}") + 0.5)
        at = at.withColumn(f"p{a}", p)
    at = at.filter(inside)
    for a in AXES:
        at = at.withColumn(f"p{a}", F.greatest(F.col(f"lo{a}").cast("double"), F.least(F.col(f"hi{a}").cast("double"), F.col(f"p{a}"))))
    found = sampled(v, keys, at, interpolator)
    every = places.select(*keys, *(F.col(f"n{a}").alias(a) for a in AXES))
    return every.join(found, [*keys, *AXES], "left").withColumn("val", F.coalesce("val", F.lit(float(outside))))


def correct_mask(mask: DataFrame, image: DataFrame, keys=("case_id",), mask_spacing=(1.0, 1.0, 1.0), mask_origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """A mask (keys, z, y, x) of another grid on the image's, by nearest voxel. It fails when read if the region's box reaches out of
    the image's."""
    box, mine = _boxes(image, keys), _boxes(mask, keys)
    fits = F.lit(True)
    for a, s, o, ms, mo in zip(AXES, spacing, origin, mask_spacing, mask_origin):
        place = lambda c, s=s, o=o, ms=ms, mo=mo: (F.lit(float(mo)) + c * float(ms) - float(o)) / float(s)
        fits = fits & (place(F.col(f"m.lo{a}")) >= F.col(f"i.lo{a}") - 0.5) & (place(F.col(f"m.hi{a}")) <= F.col(f"i.hi{a}") + 0.5)
    ok = mine.alias("m").join(box.alias("i"), list(keys)).select(*keys, F.when(~fits, F.raise_error(F.lit("the region reaches out of the image"))).alias("bad")).filter(F.col("bad").isNull())
    whole = dense_box(mask, keys)
    out = resample_to(whole, image, keys, mask_spacing, mask_origin, spacing, origin, "nearest").filter("val > 0.5").drop("val")
    return out.join(ok.select(*keys), list(keys), "left_semi")


def dense_box(mask: DataFrame, keys) -> DataFrame:
    """The box of a mask, one voxel wider: val 1 in the mask, else 0."""
    wide = _boxes(mask, keys)
    for a in AXES:
        wide = wide.withColumn(a, F.explode(F.sequence(F.col(f"lo{a}") - 1, F.col(f"hi{a}") + 1)))
    at = [*keys, *AXES]
    return wide.select(*at).join(mask.select(*at).distinct().withColumn("val", F.lit(1.0)), at, "left").withColumn("val", F.coalesce("val", F.lit(0.0)))


def decayed_dose(dose: Column, correction: str = "ADMIN", half_life: Column | None = None, injected: Column | None = None, acquired: Column | None = None, frame: Column | None = None, reference: Column | None = None) -> Column:
    """Dose (Bq) at the time that PET values are corrected to. Times are timestamps, lengths seconds."""
    if correction == "ADMIN":
        return dose
    gap = (F.unix_micros(acquired.cast("timestamp")) - F.unix_micros(injected.cast("timestamp"))) / 1e6
    if correction == "NONE":
        return dose / F.pow(F.lit(2.0), (gap + frame / 2) / half_life)
    if correction == "START":
        rate = F.log(F.lit(2.0)) / half_life
        inside = rate * frame
        middle = F.log(inside / (1 - F.exp(-inside))) / rate
        return dose / F.pow(F.lit(2.0), (gap + middle - reference) / half_life)
    raise ValueError(f"no such correction: {correction}")


def suv_scale(units: str, weight_kg: Column, dose: Column | None = None, counts_scale: Column | None = None, philips_scale: Column | None = None) -> Column:
    """Factor from stored PET values to body-weight uptake. dose: decayed."""
    if units in ("GML", "CM2ML"):
        return F.lit(1.0)
    if units == "CNTS" and philips_scale is not None:
        return philips_scale
    if units == "CNTS" and counts_scale is None:
        raise ValueError("counts need a scale")
    if units not in ("CNTS", "BQML"):
        raise ValueError(f"no such units: {units}")
    return (counts_scale if units == "CNTS" else F.lit(1.0)) * weight_kg * 1000.0 / dose


def diagnostics(v: DataFrame, keys=("roi",)) -> DataFrame:
    """Of each region: voxel count, mean, minimum, maximum, box, centre of mass (index), hash of its voxels."""
    text = F.concat_ws(",", *(F.col(a).cast("string") for a in AXES), F.col("val").cast("string"))
    g = v.groupBy(*keys).agg(
        F.count("*").alias("voxels"), F.avg("val").alias("mean"), F.min("val").alias("minimum"), F.max("val").alias("maximum"),
        *(f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))), *(F.avg(a).alias(f"centre_{a}") for a in AXES),
        F.sum(F.xxhash64(text).cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )
    return g.withColumn("hash", F.sha1("fingerprint")).drop("fingerprint")
