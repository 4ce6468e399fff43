"""Settings of an extraction, from YAML, JSON or a dict, checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

SCALAR = ("firstorder", "ih", "ivh", "glcm", "glrlm", "glszm", "gldzm", "gldm", "ngtdm", "shape", "shape2D")
SPATIAL = ("firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")
#: Families that a scalar run has unless it names its own.
DEFAULT_SCALAR = tuple(f for f in SCALAR if f not in ("shape2D", "gldzm", "ih", "ivh"))
#: Accepted for the sake of existing files; execution here is Spark's.
IGNORED = ("symmetricalGLCM", "weightingNorm", "glcmPythonMCC", "voxelBatch", "segmentClassWorkers", "additionalInfo", "geometryTolerance", "backend", "num_threads", "cudaGlszmTieBreakLowestLabel", "cudaGlszmDeterministicReduction", "cudaGlszmAllowEarlyExit", "cudaGlszmCclSyncInterval", "cudaGlszmCclFlattenInterval")


#: Names of interpolators in settings files, and ours.
INTERPOLATORS = {"sitkBSpline": "bspline", "sitkLinear": "linear", "sitkNearestNeighbor": "nearest"}


@dataclass
class Settings:
    minimumROIDimensions: int = 2
    minimumROISize: int | None = None
    correctMask: bool = False
    label: int = 1
    label_channel: int = 0
    normalize: bool = False
    normalizeScale: float = 1.0
    removeOutliers: float | None = None
    resegmentRange: list | None = None
    resegmentMode: str = "absolute"
    resegmentShape: bool = False
    voxelArrayShift: float = 0.0
    resampledPixelSpacing: list | None = None
    interpolator: str = "bspline"
    preCrop: bool = False
    padDistance: int = 5
    force2D: bool = False
    force2Ddimension: int = 0
    binWidth: float = 25.0
    binCount: int | None = None
    binMinimum: float | None = None
    distances: list = field(default_factory=lambda: [1])
    gldm_a: float = 0.0
    ivhDiscretizationMethod: str | None = None
    ivhBinCount: int = 1000
    ivhBinWidth: float = 1.0
    kernelRadius: int = 1
    maskedKernel: bool = True
    initValue: float = 0.0
    outputPath: str | None = None
    outputDirectory: str | None = None

    def __post_init__(self):
        if self.resegmentMode not in ("absolute", "relative", "sigma"):
            raise ValueError(f"resegmentMode: {self.resegmentMode}")
        if self.resegmentRange is not None and not 1 <= len(self.resegmentRange) <= 2:
            raise ValueError("resegmentRange needs one or two values")
        self.interpolator = INTERPOLATORS.get(self.interpolator, self.interpolator)
        if self.interpolator not in INTERPOLATORS.values():
            raise ValueError(f"interpolator: {self.interpolator}; {', '.join(sorted(INTERPOLATORS.values()))} are offered")
        if self.binWidth <= 0 or (self.binCount is not None and self.binCount <= 0):
            raise ValueError("bins need a positive width or count")
        if self.force2Ddimension not in (0, 1, 2) or self.minimumROIDimensions not in (1, 2, 3):
            raise ValueError("an axis is 0, 1 or 2, and a region has 1 to 3 dimensions")
        if self.kernelRadius < 1 or any(d < 1 for d in self.distances):
            raise ValueError("kernelRadius and distances are at least 1")


@dataclass
class Config:
    """imageTypes: name to settings of the filter. scalar, spatial: family to features (empty: all); None: not run."""

    settings: Settings = field(default_factory=Settings)
    imageTypes: dict = field(default_factory=lambda: {"original": {}})
    scalar: dict | None = field(default_factory=lambda: {f: [] for f in DEFAULT_SCALAR})
    spatial: dict | None = None

    def __post_init__(self):
        from gridlore.operators.filters import IMAGE_TYPES

        for name, known in (("scalar", SCALAR), ("spatial", SPATIAL)):
            for f in getattr(self, name) or ():
                if f not in known:
                    raise ValueError(f"{name}: no such family: {f}")
        for t in self.imageTypes:
            if t not in IMAGE_TYPES:
                raise ValueError(f"no such image type: {t}")

    def enable_image_type(self, name: str, **custom) -> Config:
        self.imageTypes[name] = custom
        self.__post_init__()
        return self

    def disable_all_image_types(self) -> Config:
        self.imageTypes = {}
        return self

    def enable_features(self, mode: str = "scalar", **features) -> Config:
        setattr(self, mode, {**(getattr(self, mode) or {}), **{f: list(n or []) for f, n in features.items()}})
        self.__post_init__()
        return self

    def enable_all(self, mode: str = "scalar") -> Config:
        setattr(self, mode, {f: [] for f in (SCALAR if mode == "scalar" else SPATIAL)})
        return self

    def disable_all(self, mode: str = "scalar") -> Config:
        setattr(self, mode, {})
        return self


_SECTIONS = {"scalarFeatureClass": "scalar", "featureClass": "scalar", "scalar": "scalar", "spatialFeatureClass": "spatial", "spatial": "spatial"}


def load(source=None, **overrides) -> Config:
    """A Config from a path to YAML or JSON, a dict or nothing; overrides are settings. In a section null turns a mode off, {} means all
    families, and [] or null for a family all of its features."""
    if source is None:
        raw = {}
    elif isinstance(source, dict):
        raw = source
    else:
        text = Path(source).read_text()
        if str(source).endswith(".json"):
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text) or {}
    known = {f.name for f in fields(Settings)}
    given = {**(raw.get("setting") or raw.get("settings") or {}), **overrides}
    for k in given:
        if k not in known and k not in IGNORED:
            raise ValueError(f"no such setting: {k}")
    parts: dict = {"settings": Settings(**{k: v for k, v in given.items() if k in known})}
    if "imageType" in raw:
        parts["imageTypes"] = {k[0].lower() + k[1:] if k == "Original" else k.lower(): v or {} for k, v in (raw["imageType"] or {}).items()}
    for key, name in _SECTIONS.items():
        if key in raw:
            section, every = raw[key], SCALAR if name == "scalar" else SPATIAL
            parts[name] = None if section is None else {f: [] for f in every} if not section else {f: list(n or []) for f, n in section.items()}
    return Config(**parts)
