"""Queries of resampling, sources, sinks and whole runs, each with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import voxels as V
from gridlore.operators import filters, morphology, phenotype, preprocess, shape
from gridlore.plans import queries as Q
from gridlore.plans import sql
from gridlore.sources import container

ORDER = ("z", "y", "x")


def convolutions(prefix: str, steps, boundary: str, source: str = "d") -> tuple[list[str], str]:
    """CTEs of (axis, {offset: weight}) one after the other, and the last one's name."""
    parts = []
    for n, (axis, taps) in enumerate(steps):
        i, m = "(a.i + t.o)", "a.n"
        turn = {"reflect": f"((({i} % (2 * {m})) + 2 * {m}) % (2 * {m}))", "mirror": f"((({i} % (2 * {m} - 2)) + 2 * {m} - 2) % (2 * {m} - 2))"}[boundary]
        at = f"CASE WHEN {turn} >= {m} THEN 2 * {m} - {1 if boundary == 'reflect' else 2} - {turn} ELSE {turn} END"
        rest = [a for a in ORDER if a != axis]
        rows = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in taps.items())
        parts.append(f"{prefix}i{n} AS (SELECT *, {axis} - min({axis}) OVER (PARTITION BY roi) AS i, max({axis}) OVER (PARTITION BY roi) - min({axis}) OVER (PARTITION BY roi) + 1 AS n FROM {source})")
        parts.append(f"{prefix}c{n} AS (SELECT a.roi, a.z, a.y, a.x, sum(t.w * b.val) AS val FROM {prefix}i{n} a CROSS JOIN (VALUES {rows}) AS t(o, w) JOIN {prefix}i{n} b ON b.roi = a.roi AND b.{rest[0]} = a.{rest[0]} AND b.{rest[1]} = a.{rest[1]} AND b.i = {at} GROUP BY a.roi, a.z, a.y, a.x)")
        source = f"{prefix}c{n}"
    return parts, source


def taps(kernel) -> dict[int, float]:
    half = len(kernel) // 2
    return {half - i: float(w) for i, w in enumerate(kernel)}


def pooled(sets, boundary: str, how: str, prefix: str = "p") -> tuple[list[str], str]:
    """CTEs of several convolutions (kernels for z, y, x) and of their values put together."""
    parts, ends = [], []
    for k, kernels in enumerate(sets):
        more, end = convolutions(f"{prefix}{k}", [(a, taps(w)) for a, w in zip(ORDER, kernels) if w is not None], boundary)
        parts += more
        ends.append(f"SELECT * FROM {end}")
    return [*parts, f"{prefix}all AS (SELECT roi, z, y, x, {how}(val) AS val FROM ({' UNION ALL '.join(ends)}) GROUP BY roi, z, y, x)"], f"{prefix}all"


def resampled(source: str, places, interpolator: str, prefix: str = "r") -> tuple[list[str], str]:
    """CTEs of a resampling, axis by axis. places: for each axis SQL of (roi, k, p, lo, hi) from the table b with lo and hi."""
    parts = []
    for n, (a, place) in enumerate(zip(ORDER, places)):
        rest = [c for c in ORDER if c != a]
        f, g = "(p - floor(p))", "(1 - (p - floor(p)))"
        if interpolator == "nearest":
            ends = [("floor(p + 0.5)", "1.0")]
        elif interpolator == "linear":
            ends = [("floor(p)", g), ("floor(p) + 1", f)]
        else:
            weights = [f"pow({g}, 3) / 6", f"2 / 3.0 - {f} * {f} * (2 - {f}) / 2", f"2 / 3.0 - {g} * {g} * (2 - {g}) / 2", f"pow({f}, 3) / 6"]
            m = "(hi - lo + 1)"
            turn = lambda c: f"((({c} - lo) % (2 * {m} - 2)) + 2 * {m} - 2) % (2 * {m} - 2)"  # noqa: B023, E731
            ends = [(f"lo + CASE WHEN {turn(f'floor(p) + {k - 1}')} >= {m} THEN 2 * {m} - 2 - {turn(f'floor(p) + {k - 1}')} ELSE {turn(f'floor(p) + {k - 1}')} END", w) for k, w in enumerate(weights)]
        parts.append(f"{prefix}b{n} AS (SELECT roi, min({a}) AS lo, max({a}) AS hi FROM {source} GROUP BY roi), {prefix}g{n} AS ({place.replace('FROM b', f'FROM {prefix}b{n}')})")
        parts.append(f"{prefix}t{n} AS ({' UNION ALL '.join(f'SELECT roi, k, CAST({c} AS BIGINT) AS c, {w} AS w FROM {prefix}g{n}' for c, w in ends)})")
        parts.append(f"{prefix}s{n} AS (SELECT s.roi, {', '.join(f's.{c}' if c != a else f't.k AS {a}' for c in ORDER)}, sum(t.w * s.val) / sum(t.w) AS val FROM {prefix}t{n} t JOIN {source} s ON s.roi = t.roi AND s.{a} = t.c AND t.w <> 0 GROUP BY s.roi, s.{rest[0]}, s.{rest[1]}, t.k)")
        source = f"{prefix}s{n}"
    return parts, source


def spacing_places(spacing, to):
    out = []
    for s, t in zip(spacing, to):
        m = f"greatest(1, CAST(ceil((hi - lo + 1) * {s} / {t}) AS BIGINT))"
        out.append(f"SELECT roi, lo, hi, k, greatest(CAST(lo AS DOUBLE), least(CAST(hi AS DOUBLE), lo + (hi - lo) / 2.0 - ({m} - 1) * ({t} / {s}) / 2.0 + k * ({t} / {s}))) AS p FROM (SELECT *, unnest(range(0, {m})) AS k FROM b)")
    return out


def with_all(*parts, end: str) -> str:
    return f"WITH {Q.DENSE}, {', '.join(parts)} {Q._val(end)}"


def _voxel(name, f, text):
    Q.voxel(name, f, text)


_TO = (2.0, 1.5, 2.0)
for _how in ("linear", "nearest"):
    _parts, _end = resampled("d", spacing_places((1.0, 1.0, 1.0), _TO), _how)
    _voxel(f"resample_{_how}", lambda s, d, how=_how: preprocess.resample(Q.filled(s, d), to=_TO, interpolator=how), with_all(*_parts, end=_end))
_spline = {k: -6 * preprocess.POLE / (1 - preprocess.POLE**2) * preprocess.POLE ** abs(k) for k in range(-preprocess.REACH, preprocess.REACH + 1)}
_pre, _coefficients = convolutions("s", [(a, _spline) for a in ORDER], "mirror")
_parts, _end = resampled(_coefficients, spacing_places((1.0, 1.0, 1.0), _TO), "bspline")
_voxel("resample_bspline", lambda s, d: preprocess.resample(Q.filled(s, d), to=_TO, interpolator="bspline"), with_all(*_pre, *_parts, end=_end))


def _reference(spark, sf_dir) -> DataFrame:
    g = Q.filled(spark, sf_dir).select("roi").distinct()
    for a, n in zip(ORDER, (5, 20, 15)):
        g = g.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return g


_STEP, _START = (1.25, 1.0, 1.5), (0.5, 0.25, -0.25)
_outside = " AND ".join(f"p BETWEEN lo - 0.5 AND hi + 0.5" for _ in "1")
_places = [f"SELECT roi, lo, hi, k, greatest(CAST(lo AS DOUBLE), least(CAST(hi AS DOUBLE), p)) AS p FROM (SELECT *, {o} + k * {s} AS p FROM (SELECT *, unnest(range(0, {n})) AS k FROM b)) WHERE {_outside}" for n, s, o in zip((5, 20, 15), _STEP, _START)]
_parts, _end = resampled("d", _places, "linear")
_grid = "q AS (SELECT roi, z, y, x FROM (SELECT DISTINCT roi FROM d), (SELECT unnest(range(0, 5)) AS z), (SELECT unnest(range(0, 20)) AS y), (SELECT unnest(range(0, 15)) AS x))"
_voxel("resample_to_reference", lambda s, d: preprocess.resample_to(Q.filled(s, d), _reference(s, d), reference_spacing=_STEP, reference_origin=_START, outside=-99.0), f"WITH {Q.DENSE}, {', '.join(_parts)}, {_grid}, f AS (SELECT q.*, coalesce(e.val, -99) AS val FROM q LEFT JOIN {_end} e USING (roi, z, y, x)) {Q._val('f')}")

# Image types that pool several separable responses.
_parts, _end = pooled([[filters.gaussian(1.0, 2 if n == second else 0) for n in range(3)] for second in range(3)], "reflect", "sum")
_voxel("filter_log", lambda s, d: filters.log(Q.filled(s, d), sigma=1.0), with_all(*_parts, end=_end))
_odd = lambda k: [*k, 0.0] if len(k) % 2 == 0 else list(k)
_parts, _end = pooled([[_odd(filters.wavelet_taps("db3", c)) for c in "HHL"]], "mirror", "max")
_voxel("filter_ibsiwavelet", lambda s, d: filters.ibsi_wavelet(Q.filled(s, d), combination="LHH"), with_all(*_parts, end=_end))
_unit = [tuple(w / sum(x * x for x in filters.LAWS[k]) ** 0.5 for w in filters.LAWS[k]) for k in ("l3", "e3")]
_parts, _end = pooled(filters.rotations((None, *reversed(_unit))), "mirror", "max")
_more, _last = convolutions("e", [(a, taps([0.2] * 5)) for a in "yx"], "mirror", "magnitude")
_voxel("filter_laws_rotational", lambda s, d: filters.laws(Q.filled(s, d), kernels="l3e3", rotational=True, energy=2), with_all(*_parts, f"magnitude AS (SELECT roi, z, y, x, abs(val) AS val FROM {_end})", *_more, end=_last))
_voxel("filter_lbp3d", lambda s, d: filters.lbp3d(Q.filled(s, d)), None)

# Masks and controls.
_voxel("isolate_label", lambda s, d: preprocess.isolate_label(V.vox3d(s, d).withColumn("label", (F.col("val") % 3).cast("int")), 2, 7).select("roi", *ORDER, "label"), f"SELECT roi, z, y, x, 7.0::DOUBLE AS label FROM ({sql.VOX3D}) WHERE val % 3 = 2")
_voxel("crop_margin", lambda s, d: preprocess.crop_margin(V.vox3d(s, d), Q._MASK(s, d), margin_mm=3.0, spacing=(2.0, 1.0, 1.5)), f"WITH v AS ({sql.VOX3D}), {Q._MSQL}, b AS (SELECT roi, min(z) - 2 AS z0, max(z) + 2 AS z1, min(y) - 3 AS y0, max(y) + 3 AS y1, min(x) - 2 AS x0, max(x) + 2 AS x1 FROM m GROUP BY roi) {Q._val('v JOIN b USING (roi) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1')}")
_six = ", ".join(str(o) for o in morphology.diamond())
_voxel(
    "phenotype_distance_core", lambda s, d: phenotype.distance_core(V.vox3d(s, d).filter("val >= 5"), 50),
    f"WITH m AS (SELECT roi, z, y, x FROM ({sql.VOX3D}) WHERE val >= 5), near AS (SELECT DISTINCT roi, z + dz AS z, y + dy AS y, x + dx AS x FROM m CROSS JOIN (VALUES {_six}) AS o(dz, dy, dx)), rim AS (SELECT * FROM near ANTI JOIN m USING (roi, z, y, x)), "
    "s AS (SELECT m.roi, m.z, m.y, m.x, min(pow(m.z - rim.z, 2) + pow(m.y - rim.y, 2) + pow(m.x - rim.x, 2)) AS q FROM m JOIN rim USING (roi) GROUP BY ALL) "
    "SELECT roi, z, y, x, round(sqrt(q) + 1e-9, 6) AS depth FROM s QUALIFY row_number() OVER (PARTITION BY roi ORDER BY q DESC, z, y, x) <= 50",
)
Q.add("shape_voxel_volume", lambda s, d: shape.shape(V.vox3d(s, d).filter("val >= 10"), spacing=(2.0, 1.0, 1.0)).select("roi", "VoxelVolume"), f"SELECT roi, count(*) * 2.0::DOUBLE AS \"VoxelVolume\" FROM ({sql.VOX3D}) WHERE val >= 10 GROUP BY roi")


# Axes of a symmetric matrix in closed form: of three, by the cosines of a third of an angle.
_cov = lambda a, b: f"covar_pop({Q._SPACE[a]}, {Q._SPACE[b]})"
_SPREAD = f"c AS (SELECT roi, {', '.join(f'{_cov(a, b)} AS {a}{b}' for a, b in ('zz', 'yy', 'xx', 'zy', 'zx', 'yx'))}, count(*) AS n, {', '.join(f'avg({Q._SPACE[a]}) - sum({Q._SPACE[a]} * val) / sum(val) AS s{a}' for a in ORDER)} FROM ({sql.VOX3D}) WHERE val >= 10 GROUP BY roi)"
Q.add(
    "shape_axes_3d", lambda s, d: shape.shape(V.vox3d(s, d).filter("val >= 10"), spacing=(2.0, 1.0, 1.0)).select("roi", "VoxelVolume", "MajorAxisLength", "MinorAxisLength", "LeastAxisLength", "Elongation", "Flatness", "CentreOfMassShift"),
    f"WITH {_SPREAD}, q AS (SELECT *, (zz + yy + xx) / 3 AS m, sqrt((pow(zz - (zz + yy + xx) / 3, 2) + pow(yy - (zz + yy + xx) / 3, 2) + pow(xx - (zz + yy + xx) / 3, 2) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM c), "
    "r AS (SELECT *, ((zz - m) * ((yy - m) * (xx - m) - yx * yx) - zy * (zy * (xx - m) - yx * zx) + zx * (zy * yx - (yy - m) * zx)) / (2 * p * p * p) AS det FROM q), f AS (SELECT *, acos(greatest(-1, least(1, det))) / 3 AS phi FROM r), "
    "e AS (SELECT *, m + 2 * p * cos(phi) AS e1, m + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f), g AS (SELECT *, 3 * m - e1 - e3 AS e2 FROM e) "
    'SELECT roi, n * 2.0::DOUBLE AS "VoxelVolume", round(4 * sqrt(e1) + 1e-9, 6) AS "MajorAxisLength", round(4 * sqrt(e2) + 1e-9, 6) AS "MinorAxisLength", round(4 * sqrt(e3) + 1e-9, 6) AS "LeastAxisLength", round(sqrt(e2 / e1) + 1e-9, 6) AS "Elongation", round(sqrt(e3 / e1) + 1e-9, 6) AS "Flatness", round(sqrt(sz * sz + sy * sy + sx * sx) + 1e-9, 6) AS "CentreOfMassShift" FROM g',
)
Q.add(
    "shape_axes_2d", lambda s, d: shape.shape2d(V.vox3d(s, d).filter("val >= 10"), ("roi", "z")).select("roi", "z", "PixelSurface", "MajorAxisLength", "MinorAxisLength", "Elongation"),
    f"WITH c AS (SELECT roi, z, count(*) AS n, var_pop(y) AS yy, var_pop(x) AS xx, covar_pop(y, x) AS yx FROM ({sql.VOX3D}) WHERE val >= 10 GROUP BY roi, z), e AS (SELECT *, (yy + xx) / 2 + sqrt(pow((yy - xx) / 2, 2) + yx * yx) AS e1, greatest(0, (yy + xx) / 2 - sqrt(pow((yy - xx) / 2, 2) + yx * yx)) AS e2 FROM c) "
    'SELECT roi, z, CAST(n AS DOUBLE) AS "PixelSurface", round(4 * sqrt(e1) + 1e-9, 6) AS "MajorAxisLength", round(4 * sqrt(e2) + 1e-9, 6) AS "MinorAxisLength", round(sqrt(e2 / e1) + 1e-9, 6) AS "Elongation" FROM e', ("roi", "z"),
)


Q.add("phenotype_both_children", lambda s, d: phenotype.both_children(phenotype.drop_constant(m := Q.maps(s, d)), phenotype.tiers(phenotype.drop_constant(m))).groupBy("roi", "tier", "child").agg(F.count("*").alias("voxels")), None, ("roi", "tier", "child"))


# Sources and sinks, through files in the shared folder.
def _image_files(spark, sf_dir) -> DataFrame:
    from gridlore.sources.volumes import VolumeSource

    spark.dataSource.register(VolumeSource)
    path = f"{container.shared_dir(spark)}/volumes-{uuid.uuid4().hex}"
    v = V.vox3d(spark, sf_dir).select(F.col("roi").alias("case_id"), *(F.col(a).cast("int").alias(a) for a in ORDER), "val")
    v.repartition("case_id").write.format("volume").mode("append").save(path)
    return spark.read.format("volume").load(path).select(F.col("case_id").alias("roi"), *ORDER, "val")


_voxel("source_volume_files", _image_files, f"WITH v AS ({sql.VOX3D}), b AS (SELECT roi, max(z) AS mz, max(y) AS my, max(x) AS mx FROM v GROUP BY roi), bz AS (SELECT *, unnest(range(0, mz + 1)) AS z FROM b), bw AS (SELECT *, unnest(range(0, my + 1)) AS y FROM bz), bx AS (SELECT roi, z, y, unnest(range(0, mx + 1)) AS x FROM bw), f AS (SELECT bx.*, coalesce(val, 0) AS val FROM bx LEFT JOIN v USING (roi, z, y, x)) {Q._val('f')}")


def _case(spark, sf_dir):
    v = V.vox3d(spark, sf_dir).select(F.col("roi").alias("case_id"), *ORDER, "val")
    return v, v.select("case_id", F.lit("whole").alias("roi_id"), *ORDER, F.lit(1).alias("label"))


_FAMILIES = {"firstorder": sql.firstorder(Q.SQL3, Q.FIRST), "glcm": sql.glcm(Q.SQL3, Q.GLCM), "glrlm": sql.glrlm(Q.SQL3, Q.texture.TEMPLATE["glrlm"]), "gldm": sql.gldm(Q.SQL3, Q.GLDM), "ngtdm": sql.ngtdm(Q.SQL3, Q.NGTDM)}
_NAMES = {"firstorder": Q.FIRST, "glcm": Q.GLCM, "glrlm": Q.texture.TEMPLATE["glrlm"], "gldm": Q.GLDM, "ngtdm": Q.NGTDM}
_LONG = " UNION ALL ".join(f"SELECT roi AS case_id, '{f}' AS family, feature, value FROM (UNPIVOT ({t}) ON COLUMNS(* EXCLUDE (roi)) INTO NAME feature VALUE value)" for f, t in _FAMILIES.items())
_BY = ("case_id", "family", "feature")


def _scalar(spark, sf_dir) -> DataFrame:
    from gridlore.plans.engine import Engine

    e = Engine({"setting": {"binWidth": Q.WIDTH3}, "scalar": {f: list(n) for f, n in _NAMES.items()}})
    return e.scalar(*_case(spark, sf_dir))


def _stored(spark, sf_dir) -> DataFrame:
    path = f"{container.shared_dir(spark)}/features-{uuid.uuid4().hex}"
    container.write_features(_scalar(spark, sf_dir), path, "scalar")
    return container.read_features(spark, path).select(*_BY, "value")


Q.add("engine_scalar", lambda s, d: _scalar(s, d).select(*_BY, "value"), _LONG, _BY)
Q.add("container_scalar", _stored, _LONG, _BY)


def _spatial(spark, sf_dir) -> DataFrame:
    from gridlore.plans.engine import Engine

    e = Engine({"setting": {"binWidth": Q.WIDTH3}, "scalar": None, "spatial": {"firstorder": ["Mean", "Variance"], "ngtdm": ["Contrast"]}})
    return _at(e.spatial(*_case(spark, sf_dir)).withColumnRenamed("case_id", "roi").drop("roi_id", "image_type"))


_at = Q._at
Q.add("engine_spatial", _spatial, f'WITH v AS ({sql.VOX3D}), f AS ({sql.firstorder(Q.SQLW, ["Mean", "Variance"], Q.MAP)}), n AS ({sql.ngtdm(Q.SQLW, ["Contrast"], Q.MAP)}) SELECT v.roi, v.z, v.y, v.x, coalesce(f."Mean", 0) AS "firstorder_Mean", coalesce(f."Variance", 0) AS "firstorder_Variance", coalesce(n."Contrast", 0) AS "ngtdm_Contrast" FROM v LEFT JOIN f ON f.roi = v.roi AND f.cz = v.z AND f.cy = v.y AND f.cx = v.x LEFT JOIN n ON n.roi = v.roi AND n.cz = v.z AND n.cy = v.y AND n.cx = v.x', ("roi", *ORDER))


# Comparison of results.
def _two_maps(spark, sf_dir):
    a = V.vox3d(spark, sf_dir).select("roi", *ORDER, F.concat(F.lit("z"), (F.col("z") % 3).cast("string")).alias("feature"), F.col("val").alias("value"))
    return a, a.withColumn("value", F.col("value") + F.when(F.col("z") % 3 == 1, 1e-7).when(F.col("z") % 3 == 2, 0.5).otherwise(0.0))


Q._Q["compare_maps"] = (
    lambda s, d: container.compare_maps(*_two_maps(s, d), keys=["roi", *ORDER]).select("feature", "voxels", "nonfinite_alike", F.round("max_absolute", 9).alias("max_absolute"), "concordant"),
    f"SELECT 'z' || (z % 3) AS feature, count(*) AS voxels, true AS nonfinite_alike, round(max(CASE z % 3 WHEN 1 THEN 1e-7 WHEN 2 THEN 0.5 ELSE 0 END), 9) AS max_absolute, z % 3 <> 2 AS concordant FROM ({sql.VOX3D}) GROUP BY z % 3",
)


def _judged(spark, sf_dir) -> DataFrame:
    tag = F.concat_ws("/", "roi", F.col("z").cast("string"))
    mean = V.vox3d(spark, sf_dir).groupBy("roi", "z").agg(F.avg("val").alias("value"))
    return container.evaluate(mean.filter("z < 6").select(tag.alias("tag"), "value"), mean.select(tag.alias("tag"), F.floor("value").cast("double").alias("reference_value"), F.lit(0.5).alias("tolerance")))


_JUDGED = f"SELECT CASE WHEN z >= 6 THEN 'unsupported' WHEN m - floor(m) <= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT roi, z, avg(val) AS m FROM ({sql.VOX3D}) GROUP BY roi, z)"
Q._Q["pass_rate"] = (lambda s, d: container.pass_rate(_judged(s, d), ["status"]), f"SELECT status, count(*) AS checked, count(*) FILTER (status = 'pass') AS passed, (count(*) FILTER (status = 'pass')) / count(*) AS rate FROM ({_JUDGED}) GROUP BY status")
