"""Extraction: voxels and masks in, lazy tables of features out.

images: case_id, z, y, x, val. masks: case_id, roi_id, z, y, x, label. A run keys everything by case, region and image type, so a
cohort is one plan: regions share scans, shuffles and tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import voxels as V
from gridlore.operators import filters, intensity, preprocess, shape, texture, zones
from gridlore.plans.config import Config, load

REGION = ("case_id", "roi_id")
KEYS = (*REGION, "image_type")

#: name: f(voxels with g, keys, settings). `@feature_family` adds more.
FAMILIES: dict = {}


def feature_family(name: str):
    def add(f):
        FAMILIES[name] = f
        return f

    return add


def _flat(s):
    return s.force2Ddimension if s.force2D else None


FAMILIES |= {
    "firstorder": lambda v, k, s: intensity.firstorder(v, k, s.voxelArrayShift),
    "ih": lambda v, k, s: intensity.ih(v, k),
    "ivh": lambda v, k, s: intensity.ivh(v, k, s.ivhDiscretizationMethod, s.ivhBinCount, s.ivhBinWidth),
    "glcm": lambda v, k, s: texture.glcm(v, k, s.distances, flat_axis=_flat(s), flat_correlation=0.0 if s.force2D else 1.0),
    "glrlm": lambda v, k, s: texture.glrlm(v, k, flat_axis=_flat(s)),
    "glszm": lambda v, k, s: zones.glszm(v, k, flat_axis=_flat(s)),
    "gldzm": lambda v, k, s: zones.gldzm(v, k, flat_axis=_flat(s)),
    "gldm": lambda v, k, s: texture.gldm(v, k, s.distances, s.gldm_a, flat_axis=_flat(s)),
    "ngtdm": lambda v, k, s: texture.ngtdm(v, k, s.distances, flat_axis=_flat(s)),
}


class Engine:
    def __init__(self, config: Config | dict | str | None = None, spacing=(1.0, 1.0, 1.0), **settings):
        """spacing: z, y, x in mm of all images; or a table (case_id, spacing: x, y, z), as the volume source's geometry gives it.
        With a table all images are brought to one spacing, so resampledPixelSpacing must name one for every axis."""
        self.config = config if isinstance(config, Config) else load(config, **settings)
        to = self.config.settings.resampledPixelSpacing
        if isinstance(spacing, DataFrame):
            if not to or not all(to):
                raise ValueError("spacing by case needs resampledPixelSpacing for every axis")
            self.spacing = spacing.select("case_id", *(F.get("spacing", 2 - n).cast("double").alias(f"spacing_{a}") for n, a in enumerate(V.AXES)))
        else:
            self.spacing = tuple(map(float, spacing))

    @property
    def grid_spacing(self) -> tuple:
        """The spacing (z, y, x) that features are taken in: after resampling."""
        to = (self.config.settings.resampledPixelSpacing or (0, 0, 0))[::-1]
        return tuple(map(float, to)) if isinstance(self.spacing, DataFrame) else tuple(float(t or old) for t, old in zip(to, self.spacing))

    def prepare(self, images: DataFrame, masks: DataFrame):
        """(image, region of shape, region of features): checked, normalised, resampled, cropped, resegmented. Nothing is kept in the
        engine, so it serves any number of runs."""
        s = self.config.settings
        m = preprocess.label_mask(masks, s.label).select(*REGION, *V.AXES) if "label" in masks.columns else masks.select(*REGION, *V.AXES)
        image = images.select("case_id", *V.AXES, "val")
        if s.normalize:
            image = preprocess.normalize(image, ["case_id"], s.normalizeScale, s.removeOutliers)
        if s.resampledPixelSpacing:
            to = s.resampledPixelSpacing[::-1]
            ground = image.join(m.select(*REGION).distinct(), "case_id").select(*REGION, *V.AXES, F.lit(0.0).alias("val"))
            whole = ground.unionByName(m.withColumn("val", F.lit(1.0))).groupBy(*REGION, *V.AXES).agg(F.max("val").alias("val"))
            m = preprocess.resample(whole, REGION, self.spacing, to, "nearest").filter("val > 0.5").drop("val")
            image = preprocess.resample(image, ["case_id"], self.spacing, to, s.interpolator)
        elif s.preCrop:
            box = m.groupBy("case_id", *V.AXES).agg(F.lit(1).alias("one"))
            image = preprocess.crop(image, box, ["case_id"], (s.padDistance,) * 3)
        m = preprocess.valid_or_fail(m, REGION, minimum_dimensions=s.minimumROIDimensions, minimum_size=s.minimumROISize)
        fine = m
        if s.resegmentRange:
            inside = image.join(m, ["case_id", *V.AXES]).select(*REGION, *V.AXES, "val")
            fine = preprocess.resegment(inside, REGION, s.resegmentRange, s.resegmentMode).select(*REGION, *V.AXES)
        return image, fine if s.resegmentShape else m, fine

    def _typed(self, image: DataFrame) -> DataFrame:
        """All image types of the images, one below the other. Filters that know distances get the grid's spacing, and with force2D
        the axis that they leave out."""
        s, out = self.config.settings, []
        known = {"spacing": self.grid_spacing} | ({"flat_axis": s.force2Ddimension} if s.force2D else {})
        for name, custom in self.config.imageTypes.items():
            custom = {**known, **(custom or {})}
            if name == "wavelet" and "combination" not in custom:
                bands = filters.wavelet_bands(image, ["case_id"], custom.get("wavelet", "coif1"), custom.get("level", 1), custom.get("start_level", 0))
                out += [b.withColumn("image_type", F.lit(n)) for n, b in bands]
            elif name == "log" and isinstance(custom.get("sigma"), (list, tuple)):
                out += [filters.log(image, ["case_id"], **{**custom, "sigma": sigma}).withColumn("image_type", F.lit(f"log-sigma-{sigma}".replace(".", "-") + "-mm-3D")) for sigma in custom["sigma"]]
            else:
                out.append(filters.IMAGE_TYPES[name](image, ["case_id"], **custom).withColumn("image_type", F.lit(name)))
        return reduce(DataFrame.unionByName, [o.select("case_id", "image_type", *V.AXES, "val") for o in out])

    def _levels(self, v: DataFrame, keys, minimum=True) -> DataFrame:
        s = self.config.settings
        if s.binCount:
            return V.fixed_count(v, keys, s.binCount)
        return V.fixed_width(v, keys, s.binWidth, s.binMinimum if minimum else None)

    def _chosen(self, wide: DataFrame, keys, family: str, names) -> DataFrame:
        features = [c for c in wide.columns if c not in keys]
        for n in names or ():
            if n not in features:
                raise ValueError(f"{family}: no such feature: {n}")
        return wide.select(*keys, *(f"`{n}`" for n in names)) if names else wide

    def scalar(self, images: DataFrame, masks: DataFrame) -> DataFrame:
        """case_id, roi_id, image_type, family, feature, value."""
        s = self.config.settings
        image, of_shape, of_features = self.prepare(images, masks)
        v = self._levels(self._typed(image).join(of_features, ["case_id", *V.AXES]).select(*KEYS, *V.AXES, "val"), KEYS).persist()
        out = []
        for family, names in (self.config.scalar or {}).items():
            if family in ("shape", "shape2D"):
                w = image.join(of_shape, ["case_id", *V.AXES]).select(*REGION, F.lit("original").alias("image_type"), *V.AXES, "val")
                wide = shape.shape(w, KEYS, self.grid_spacing) if family == "shape" else shape.shape2d(w, KEYS, self.grid_spacing[1:], "SphericalDisproportion" in (names or ()))
            else:
                wide = FAMILIES[family](v, KEYS, s)
                if family == "firstorder":
                    volume = math.prod(self.grid_spacing)
                    wide = wide.withColumn("TotalEnergy", F.col("TotalEnergy") * volume)
            out.append(V.to_long(self._chosen(wide, KEYS, family, names), KEYS, family))
        return reduce(DataFrame.unionByName, out)

    def spatial(self, images: DataFrame, masks: DataFrame) -> DataFrame:
        """case_id, roi_id, image_type, z, y, x and a column <family>_<feature> for each map, a row for each voxel of a region."""
        s = self.config.settings
        image, _, of_features = self.prepare(images, masks)
        typed = self._typed(image)
        inside = typed.join(of_features, ["case_id", *V.AXES]).select(*KEYS, *V.AXES, "val")
        if s.maskedKernel:
            near = self._levels(inside, KEYS, False)
        else:  # the whole crop is the kernel's mask
            crop = preprocess.crop(typed.join(of_features.select(*REGION).distinct(), "case_id"), of_features, REGION, (s.kernelRadius,) * 3)
            near = self._levels(crop.select(*KEYS, *V.AXES, "val"), KEYS, False)
        w = V.windows(near, KEYS, s.kernelRadius, centres=inside, flat_axis=_flat(s)).persist()  # read by every family
        keys, parts, names_of = (*KEYS, *V.CENTRE), [], []
        for family, names in (self.config.spatial or {}).items():
            wide = zones.glszm(w, keys, flat_axis=_flat(s), batches=256) if family == "glszm" else FAMILIES[family](w, keys, s)
            if family == "firstorder" and not names:
                wide = wide.drop("StandardDeviation")
            wide = self._chosen(wide, keys, family, names)
            features = [c for c in wide.columns if c not in keys]
            names_of.append([f"{family}_{c}" for c in features])
            parts.append(wide.select(*keys, F.lit(len(parts)).alias("part"), F.array(*(F.col(f"`{c}`").cast("double") for c in features)).alias("values")))
        # One shuffle brings the families of a centre together; a chain of joins would take one for each.
        init = F.lit(float(s.initValue))
        rows = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(F.first(F.when(F.col("part") == n, F.col("values")), ignorenulls=True).alias(f"part{n}") for n in range(len(parts))))
        centres = inside.select(*KEYS, *(F.col(a).alias(f"c{a}") for a in V.AXES))
        rows = centres.join(rows, list(keys), "left")
        return rows.select(*KEYS, *(F.col(f"c{a}").alias(a) for a in V.AXES), *(F.coalesce(F.get(f"part{n}", i), init).alias(c) for n, names in enumerate(names_of) for i, c in enumerate(names)))

    def execute(self, images: DataFrame, masks: DataFrame) -> dict[str, DataFrame]:
        """The modes that the config has, each a lazy table."""
        out = {}
        if self.config.scalar:
            out["scalar"] = self.scalar(images, masks)
        if self.config.spatial:
            out["spatial"] = self.spatial(images, masks)
        return out


def named(features: DataFrame) -> DataFrame:
    """(case_id, roi_id, features): a map of <image_type>_<family>_<feature> to value for each region."""
    name = F.concat_ws("_", "image_type", "family", "feature")
    return features.groupBy(*REGION).agg(F.map_from_entries(F.collect_list(F.struct(name, "value"))).alias("features"))
