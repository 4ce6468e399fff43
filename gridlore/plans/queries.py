"""Queries over the driver's tables for every feature family and operator, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import voxels as V
from gridlore.operators import filters, intensity, morphology, phenotype, preprocess, shape, texture, zones
from gridlore.plans import sql

WIDTH3, WIDTH2 = 5.0, 50.0


def g3(spark, sf_dir) -> DataFrame:
    return V.fixed_width(V.vox3d(spark, sf_dir), ["roi"], WIDTH3)


def g2(spark, sf_dir) -> DataFrame:
    return V.fixed_width(V.vox2d(spark, sf_dir), ["roi"], WIDTH2)


SQL3, SQL2 = sql.levels(sql.VOX3D, WIDTH3), sql.levels(sql.VOX2D, WIDTH2)


def rounded(df: DataFrame, keys=("roi",)) -> DataFrame:
    """Six digits; a value in the middle between two goes up in either engine."""
    return df.select(*keys, *(F.round(F.col(f"`{c}`").cast("double") + 1e-9, 6).alias(c) for c in df.columns if c not in keys))


def glcm_core(spark, sf_dir) -> DataFrame:
    """The flagship: co-occurrence features of a volume over 13 directions."""
    return rounded(texture.glcm(g3(spark, sf_dir), mcc=False).select("roi", *CORE))


CORE = ("Contrast", "JointEnergy", "JointEntropy", "Idm")
#: Names of features.
FIRST = (
    "Mean", "Variance", "Skewness", "Kurtosis", "Minimum", "Maximum", "Range", "Median", "10Percentile", "90Percentile", "InterquartileRange", "MeanAbsoluteDeviation", "RobustMeanAbsoluteDeviation", "MedianAbsoluteDeviation",
    "CoefficientOfVariation", "QuartileCoefficientOfDispersion", "StandardDeviation", "Energy", "TotalEnergy", "RootMeanSquared", "Entropy", "Uniformity",
)
IH = [n for n in FIRST if n not in ("StandardDeviation", "Energy", "TotalEnergy", "RootMeanSquared")] + list(sql.IH_OWN)
IVH = ("VolumeFractionAt10Intensity", "VolumeFractionAt90Intensity", "IntensityAt10Volume", "IntensityAt90Volume", "VolumeFractionDifferenceBetween10And90Intensity", "IntensityDifferenceBetween10And90Volume")
GLCM = [n for n in texture.GLCM_FEATURES if n != "MCC"]
NGTDM = ("Coarseness", "Contrast", "Busyness", "Complexity", "Strength")
GLDM = [*texture.TEMPLATE["gldm"], "DependenceCountEnergy"]

#: name: (query, SQL or None)
_Q: dict[str, tuple] = {"glcm_core": (glcm_core, sql.glcm(SQL3, CORE))}


def add(name, f, text=None, keys=("roi",)):
    _Q[name] = (lambda spark, sf_dir: rounded(f(spark, sf_dir), keys), text)


for _dim, _v, _s, _n in (("3d", g3, SQL3, 3), ("2d", g2, SQL2, 2)):
    add(f"firstorder_{_dim}", lambda s, d, v=_v: intensity.firstorder(v(s, d)), sql.firstorder(_s, FIRST))
    add(f"ih_{_dim}", lambda s, d, v=_v: intensity.ih(v(s, d)), sql.ih(_s, IH))
    add(f"ivh_levels_{_dim}", lambda s, d, v=_v: intensity.ivh(v(s, d)), sql.ivh(_s, IVH))
    for _m in ("none", "fixed_bin_size", "fixed_bin_number"):
        add(f"ivh_{_m}_{_dim}", lambda s, d, v=_v, m=_m: intensity.ivh(v(s, d), method=m, bins=100, width=2.5), sql.ivh(_s, IVH, method=_m))
    add(f"glcm_{_dim}", lambda s, d, v=_v, n=_n: texture.glcm(v(s, d), ndim=n, mcc=False), sql.glcm(_s, GLCM, ndim=_n))
    add(f"glcm_mcc_{_dim}", lambda s, d, v=_v, n=_n: texture.glcm(v(s, d), ndim=n).select("roi", "MCC"))
    add(f"glrlm_{_dim}", lambda s, d, v=_v, n=_n: texture.glrlm(v(s, d), ndim=n), sql.glrlm(_s, texture.TEMPLATE["glrlm"], ndim=_n))
    add(f"gldm_{_dim}", lambda s, d, v=_v, n=_n: texture.gldm(v(s, d), ndim=n), sql.gldm(_s, GLDM, ndim=_n))
    add(f"ngtdm_{_dim}", lambda s, d, v=_v, n=_n: texture.ngtdm(v(s, d), ndim=n), sql.ngtdm(_s, NGTDM, ndim=_n))
    add(f"glszm_{_dim}", lambda s, d, v=_v, n=_n: zones.glszm(v(s, d), ndim=n), sql.glszm(_s, texture.TEMPLATE["glszm"], ndim=_n))
    add(f"gldzm_{_dim}", lambda s, d, v=_v, n=_n: zones.gldzm(v(s, d), ndim=n), sql.gldzm(_s, texture.TEMPLATE["gldzm"], ndim=_n))
add("gldm_alpha1_3d", lambda s, d: texture.gldm(g3(s, d), alpha=1), sql.gldm(SQL3, GLDM, alpha=1))
# Slice by slice: pairs and runs of all slices meet in one matrix for each in-plane direction.
add("glcm_force2d", lambda s, d: texture.glcm(g3(s, d), flat_axis=0, mcc=False, flat_correlation=0.0), sql.glcm(SQL3, GLCM, flat_axis=0, flat_correlation=0.0))
add("glrlm_force2d", lambda s, d: texture.glrlm(g3(s, d), flat_axis=0), sql.glrlm(SQL3, texture.TEMPLATE["glrlm"], flat_axis=0))
add("gldm_force2d", lambda s, d: texture.gldm(g3(s, d), flat_axis=0), sql.gldm(SQL3, GLDM, flat_axis=0))
add("ngtdm_force2d", lambda s, d: texture.ngtdm(g3(s, d), flat_axis=0), sql.ngtdm(SQL3, NGTDM, flat_axis=0))
add("glszm_force2d", lambda s, d: zones.glszm(g3(s, d), flat_axis=0), sql.glszm(SQL3, texture.TEMPLATE["glszm"], flat_axis=0))


# Feature maps: the same families, keyed by the window's centre.
MAP = ("roi", *V.CENTRE)


def windowed(spark, sf_dir) -> DataFrame:
    return V.windows(g3(spark, sf_dir), ["roi"], 1)


SQLW = sql.window(SQL3)
add("map_firstorder", lambda s, d: intensity.firstorder(windowed(s, d), MAP), sql.firstorder(SQLW, FIRST, MAP), MAP)
add("map_glcm", lambda s, d: texture.glcm(windowed(s, d), MAP, mcc=False), sql.glcm(SQLW, GLCM, MAP), MAP)
add("map_glrlm", lambda s, d: texture.glrlm(windowed(s, d), MAP), sql.glrlm(SQLW, texture.TEMPLATE["glrlm"], MAP), MAP)
add("map_gldm", lambda s, d: texture.gldm(windowed(s, d), MAP), sql.gldm(SQLW, GLDM, MAP), MAP)
add("map_ngtdm", lambda s, d: texture.ngtdm(windowed(s, d), MAP), sql.ngtdm(SQLW, NGTDM, MAP), MAP)
add("map_glszm", lambda s, d: zones.glszm(windowed(s, d), MAP, batches=64), sql.glszm(SQLW, texture.TEMPLATE["glszm"], MAP), MAP)

# Preprocessing.
AT = ("roi", "z", "y", "x")
_at = lambda df: df.select("roi", *(F.col(a).cast("long").alias(a) for a in V.AXES), *(c for c in df.columns if c not in AT))


def voxel(name, f, text):
    add(name, lambda s, d: _at(f(s, d)), text, AT)


def _val(source: str, expr: str = "val") -> str:
    return f"SELECT roi, z, y, x, round({expr} + 1e-9, 6) AS val FROM {source}"


_S = "SELECT roi, avg(val) AS m, stddev_pop(val) AS sp, stddev_samp(val) AS ss, max(val) AS hi, min(val) AS lo FROM v GROUP BY roi"
voxel("discretize_width", lambda s, d: g2(s, d).drop("val"), f"SELECT roi, z, y, x, CAST(g AS DOUBLE) AS g FROM ({SQL2})")
voxel("discretize_minimum", lambda s, d: V.fixed_width(V.vox2d(s, d), ["roi"], WIDTH2, -100.0).drop("val"), f"SELECT roi, z, y, x, floor((val + 100) / 50.0) + 1 AS g FROM ({sql.VOX2D}) WHERE val >= -100")
voxel("discretize_count", lambda s, d: V.fixed_count(V.vox2d(s, d), ["roi"], 32).drop("val"), f"WITH v AS ({sql.VOX2D}), s AS ({_S}) SELECT roi, z, y, x, CAST(CASE WHEN hi > lo THEN least(32, floor(32 * (val - lo) / (hi - lo)) + 1) ELSE 17 END AS DOUBLE) AS g FROM v JOIN s USING (roi)")
voxel("discretize_compact", lambda s, d: V.compacted(g2(s, d), ["roi"]).drop("val"), f"WITH v AS ({SQL2}) SELECT roi, z, y, x, CAST(dense_rank() OVER (PARTITION BY roi ORDER BY g) AS DOUBLE) AS g FROM v")
voxel("normalize", lambda s, d: preprocess.normalize(V.vox2d(s, d), scale=100, outliers=2), f"WITH v AS ({sql.VOX2D}), s AS ({_S}) {_val('v JOIN s USING (roi)', '100 * greatest(least((val - m) / ss, 2), -2)')}")
voxel("clip_intensity", lambda s, d: preprocess.clip_intensity(V.vox2d(s, d), -200, 100), f"WITH v AS ({sql.VOX2D}) {_val('v', 'greatest(least(val, 100), -200)')}")
voxel("resegment_absolute", lambda s, d: preprocess.resegment(V.vox3d(s, d), limits=[10, 40]), f"WITH v AS ({sql.VOX3D}) {_val('v WHERE val BETWEEN 10 AND 40')}")
voxel("resegment_relative", lambda s, d: preprocess.resegment(V.vox3d(s, d), limits=[0.5], mode="relative"), f"WITH v AS ({sql.VOX3D}), s AS ({_S}) {_val('v JOIN s USING (roi) WHERE val >= hi * 0.5')}")
voxel("resegment_sigma", lambda s, d: preprocess.resegment(V.vox3d(s, d), limits=[-1, 1], mode="sigma"), f"WITH v AS ({sql.VOX3D}), s AS ({_S}) {_val('v JOIN s USING (roi) WHERE val BETWEEN m - sp AND m + sp')}")
_MASK = lambda s, d: V.vox3d(s, d).filter((F.col("val") >= 45) & F.col("z").between(2, 4) & F.col("y").between(5, 15))
_MSQL = "m AS (SELECT * FROM v WHERE val >= 45 AND z BETWEEN 2 AND 4 AND y BETWEEN 5 AND 15)"
voxel("crop_to_mask", lambda s, d: preprocess.crop(V.vox3d(s, d), _MASK(s, d), pad=(1, 2, 3)), f"WITH v AS ({sql.VOX3D}), {_MSQL}, b AS (SELECT roi, min(z) - 1 AS z0, max(z) + 1 AS z1, min(y) - 2 AS y0, max(y) + 2 AS y1, min(x) - 3 AS x0, max(x) + 3 AS x1 FROM m GROUP BY roi) {_val('v JOIN b USING (roi) WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1')}")
voxel("roi_select", lambda s, d: V.select_roi(V.vox3d(s, d), _MASK(s, d), AT), f"WITH v AS ({sql.VOX3D}), {_MSQL} {_val('v SEMI JOIN m USING (roi, z, y, x)')}")
voxel("zscore_roi", lambda s, d: preprocess.zscore_roi(V.vox3d(s, d), _MASK(s, d)), f"WITH v AS ({sql.VOX3D}), {_MSQL}, s AS (SELECT roi, avg(val) AS m, stddev_pop(val) AS sp FROM m GROUP BY roi) {_val('v JOIN s USING (roi)', '100 * greatest(least((val - m) / CASE WHEN sp > 0 THEN sp ELSE 1 END, 3), -3) + 300')}")
voxel("mr_normalize", lambda s, d: preprocess.mr_normalize(V.vox3d(s, d), _MASK(s, d), target=100), f"WITH v AS ({sql.VOX3D}), {_MSQL}, r AS (SELECT roi, median(val) AS r FROM m GROUP BY roi) {_val('v JOIN r USING (roi)', 'val * (100 / r)')}")
add("check_mask", lambda s, d: preprocess.check_mask(_MASK(s, d)).select("roi", "voxels", "dimensions", "min_z", "max_z", "min_y", "max_y", "min_x", "max_x"), f"WITH v AS ({sql.VOX3D}), {_MSQL} SELECT roi, count(*)::DOUBLE AS voxels, ((max(z) > min(z))::INT + (max(y) > min(y))::INT + (max(x) > min(x))::INT)::DOUBLE AS dimensions, min(z)::DOUBLE AS min_z, max(z)::DOUBLE AS max_z, min(y)::DOUBLE AS min_y, max(y)::DOUBLE AS max_y, min(x)::DOUBLE AS min_x, max(x)::DOUBLE AS max_x FROM m GROUP BY roi")
add("diagnostics", lambda s, d: preprocess.diagnostics(V.vox3d(s, d)).drop("hash"), f"WITH v AS ({sql.VOX3D}) SELECT roi, count(*)::DOUBLE AS voxels, round(avg(val) + 1e-9, 6) AS mean, round(min(val) + 1e-9, 6) AS minimum, round(max(val) + 1e-9, 6) AS maximum, {', '.join(f'{f}({a})::DOUBLE AS {f}_{a}' for a in 'zyx' for f in ('min', 'max'))}, {', '.join(f'round(avg({a}) + 1e-9, 6) AS centre_{a}' for a in 'zyx')} FROM v GROUP BY roi")

# Image types, over the filled volume.
DENSE = f"v AS ({sql.VOX3D}), b AS (SELECT roi, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v GROUP BY roi), bz AS (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM b), bw AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM bz), bx AS (SELECT roi, z, y, unnest(range(x0, x1 + 1)) AS x FROM bw), d AS (SELECT roi, z, y, x, coalesce(val, 0) - 20 AS val FROM bx LEFT JOIN v USING (roi, z, y, x))"


def filled(spark, sf_dir) -> DataFrame:
    return filters.dense(V.vox3d(spark, sf_dir), ["roi"]).withColumn("val", F.col("val") - 20)


_PEAK = "p AS (SELECT roi, max(abs(val)) AS m FROM d GROUP BY roi)"
for _n, _e in (("square", "val * val / m"), ("squareroot", "sign(val) * sqrt(abs(val) * m)"), ("logarithm", "sign(val) * ln(abs(val) + 1) * m / ln(m + 1)"), ("exponential", "exp(val * ln(m) / m)")):
    voxel(f"filter_{_n}", lambda s, d, n=_n: filters.IMAGE_TYPES[n](filled(s, d)), f"WITH {DENSE}, {_PEAK} {_val('d JOIN p USING (roi)', _e)}")


def conv_sql(steps, boundary: str, final: str = "val") -> str:
    """steps: (axis, {offset: weight}) one after the other."""
    parts, source = [], "d"
    for n, (axis, taps) in enumerate(steps):
        size = f"(max({axis}) OVER (PARTITION BY roi) - min({axis}) OVER (PARTITION BY roi) + 1)"
        i, m = "(a.i + t.o)", "a.n"
        at = {
            "wrap": f"(({i} % {m}) + {m}) % {m}", "nearest": f"greatest(0, least({i}, {m} - 1))",
            "reflect": f"CASE WHEN ((({i} % (2 * {m})) + 2 * {m}) % (2 * {m})) >= {m} THEN 2 * {m} - 1 - ((({i} % (2 * {m})) + 2 * {m}) % (2 * {m})) ELSE ((({i} % (2 * {m})) + 2 * {m}) % (2 * {m})) END",
            "mirror": f"CASE WHEN ((({i} % (2 * {m} - 2)) + 2 * {m} - 2) % (2 * {m} - 2)) >= {m} THEN 2 * {m} - 2 - ((({i} % (2 * {m} - 2)) + 2 * {m} - 2) % (2 * {m} - 2)) ELSE ((({i} % (2 * {m} - 2)) + 2 * {m} - 2) % (2 * {m} - 2)) END",
        }[boundary]
        rest = [a for a in V.AXES if a != axis]
        rows = ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in taps.items())
        parts.append(f"i{n} AS (SELECT *, {axis} - min({axis}) OVER (PARTITION BY roi) AS i, {size} AS n FROM {source}), c{n} AS (SELECT a.roi, a.z, a.y, a.x, sum(t.w * b.val) AS val FROM i{n} a CROSS JOIN (VALUES {rows}) AS t(o, w) JOIN i{n} b ON b.roi = a.roi AND b.{rest[0]} = a.{rest[0]} AND b.{rest[1]} = a.{rest[1]} AND b.i = {at} GROUP BY a.roi, a.z, a.y, a.x)")
        source = f"c{n}"
    return f"WITH {DENSE}, {', '.join(parts)} {_val(source, final)}"


voxel("filter_mean", lambda s, d: filters.mean(filled(s, d)), conv_sql([(a, {-1: 1 / 3, 0: 1 / 3, 1: 1 / 3}) for a in V.AXES], "reflect"))
_laws = [[w / sum(x * x for x in filters.LAWS[k]) ** 0.5 for w in filters.LAWS[k]] for k in ("s5", "e5", "l5")]
voxel("filter_laws", lambda s, d: filters.laws(filled(s, d)), conv_sql([(a, {2 - i: w for i, w in enumerate(k)}) for a, k in zip(V.AXES, _laws)], "mirror"))
_wave = [filters.wavelet_taps("coif1", p) for p in "LHL"]
voxel("filter_wavelet", lambda s, d: filters.wavelet(filled(s, d), combination="LHL"), conv_sql([(a, {3 - i: w for i, w in enumerate(k)}) for a, k in zip(V.AXES, _wave)], "wrap"))
for _n, _kw in (("gradient", {}), ("gabor", {"axes": (0,), "sigma": 2.0, "wavelength": 4.0}), ("simoncelli", {}), ("riesz", {"order": (1, 0, 0)}), ("lbp2d", {})):
    voxel(f"filter_{_n}", lambda s, d, n=_n, kw=_kw: filters.IMAGE_TYPES[n](filled(s, d), **kw), None)
voxel("filter_riesz_steered", lambda s, d: filters.riesz(filled(s, d), order=(0, 2, 0), steering=True), None)

_grad = lambda a: f"(coalesce(lead(val) OVER (PARTITION BY roi, {', '.join(c for c in 'zyx' if c != a)} ORDER BY {a}), val) - coalesce(lag(val) OVER (PARTITION BY roi, {', '.join(c for c in 'zyx' if c != a)} ORDER BY {a}), val)) / 2"
_Q["filter_gradient"] = (_Q["filter_gradient"][0], f"WITH {DENSE}, q AS (SELECT roi, z, y, x, {', '.join(f'{_grad(a)} AS d{a}' for a in 'zyx')} FROM d) {_val('q', 'sqrt(dz * dz + dy * dy + dx * dx)')}")

# Morphology.
add("shape_3d", lambda s, d: shape.shape(V.vox3d(s, d).filter("val >= 10"), spacing=(2.0, 1.0, 1.0)))
add("shape_2d", lambda s, d: shape.shape2d(V.vox3d(s, d).filter("val >= 10"), ("roi", "z")), None, ("roi", "z"))
_SPACE = {"z": "z * 2.0", "y": "y", "x": "x"}
add(
    "shape_moments", lambda s, d: shape.moments(V.vox3d(s, d), spacing=(2.0, 1.0, 1.0)),
    f"WITH v AS ({sql.VOX3D}) SELECT roi, count(*)::DOUBLE AS n, {', '.join(f'round(avg({_SPACE[a]}) + 1e-9, 6) AS m{a}, round(sum({_SPACE[a]} * val) / sum(val) + 1e-9, 6) AS w{a}' for a in 'zyx')}, "
    + ", ".join(f"round(covar_pop({_SPACE[V.AXES[i]]}, {_SPACE[V.AXES[j]]}) + 1e-9, 6) AS c{V.AXES[i]}{V.AXES[j]}" for i in range(3) for j in range(i, 3)) + ", round(avg(val) + 1e-9, 6) AS mean FROM v GROUP BY roi",
)
_high = lambda s, d: V.vox3d(s, d).filter("val >= 2")
_HIGH = f"m AS (SELECT roi, z, y, x FROM ({sql.VOX3D}) WHERE val >= 2)"
_six = [o for o in morphology.diamond() if any(o)]
_STEP = f"(VALUES (0, 0, 0), {', '.join(map(str, _six))}) AS o(dz, dy, dx)"
_DIL = f"dil AS (SELECT DISTINCT roi, z + dz AS z, y + dy AS y, x + dx AS x FROM m CROSS JOIN {_STEP})"
_ERO = f"ero AS (SELECT roi, z + dz AS z, y + dy AS y, x + dx AS x FROM m CROSS JOIN {_STEP} GROUP BY ALL HAVING count(*) = 7)"
for _n, _f, _t in (("dilate", morphology.dilate, f"WITH {_HIGH}, {_DIL} SELECT * FROM dil"), ("erode", morphology.erode, f"WITH {_HIGH}, {_ERO} SELECT * FROM ero"), ("shell", morphology.shell, f"WITH {_HIGH}, {_DIL} SELECT * FROM dil ANTI JOIN m USING (roi, z, y, x)"), ("surface", morphology.surface, f"WITH {_HIGH}, {_ERO} SELECT * FROM m ANTI JOIN ero USING (roi, z, y, x)")):
    voxel(f"morphology_{_n}", lambda s, d, f=_f: f(_high(s, d)), _t)


# Phenotyping, over a few maps.
def maps(spark, sf_dir) -> DataFrame:
    v = windowed(spark, sf_dir)
    first = intensity.firstorder(v, MAP).select(*MAP, *(F.col(n).alias(f"firstorder_{n}") for n in ("Mean", "Variance", "Maximum")))
    tone = texture.ngtdm(v, MAP).select(*MAP, *(F.col(n).alias(f"ngtdm_{n}") for n in ("Contrast", "Complexity")))
    m = first.join(tone, list(MAP), "left").withColumn("firstorder_Constant", F.lit(1.0))
    m = m.select("roi", *(F.col(f"c{a}").cast("int").alias(a) for a in V.AXES), *(c for c in m.columns if c not in MAP))
    return m.persist()  # features are tested before they are clustered


_tiers = lambda s, d: phenotype.tiers(phenotype.drop_constant(maps(s, d)))
_fused = lambda s, d: phenotype.fused(phenotype.drop_constant(maps(s, d)), _tiers(s, d))
add("phenotype_tiers", lambda s, d: _tiers(s, d).groupBy("roi", "tier").agg(F.count("*").alias("voxels"), F.avg("score").alias("score")), None, ("roi", "tier"))
add("phenotype_fused_pes", lambda s, d: _fused(s, d).groupBy("roi", "tier", "status").agg(F.count("*").alias("voxels"), F.count_if("pes").alias("pes")), None, ("roi", "tier", "status"))
add("phenotype_interaction", lambda s, d: phenotype.interaction(_fused(s, d)))
add("phenotype_habitats", lambda s, d: phenotype.habitats(V.vox3d(s, d)).groupBy("roi", "habitat").agg(F.count("*").alias("voxels")), None, ("roi", "habitat"))
add("phenotype_global_top", lambda s, d: phenotype.global_top(phenotype.drop_constant(maps(s, d))).groupBy("roi", "chosen").agg(F.count("*").alias("voxels")), None, ("roi", "chosen"))
voxel("phenotype_top_voxels", lambda s, d: phenotype.top_voxels(V.vox3d(s, d), 100), f"WITH v AS ({sql.VOX3D}) SELECT roi, z, y, x, round(val + 1e-9, 6) AS val, row_number() OVER (PARTITION BY roi ORDER BY val DESC, z, y, x)::DOUBLE AS rank FROM v QUALIFY rank <= 100")
add("phenotype_summary", lambda s, d: phenotype.summarize(V.vox3d(s, d)), f"WITH v AS ({sql.VOX3D}) SELECT roi, 'val' AS feature, round(avg(val) + 1e-9, 6) AS mean, round(stddev_pop(val) + 1e-9, 6) AS std, round(quantile_cont(val, 0.1) + 1e-9, 6) AS p10, round(quantile_cont(val, 0.9) + 1e-9, 6) AS p90 FROM v GROUP BY roi", ("roi", "feature"))
_Q["phenotype_random_children"] = (
    lambda s, d: phenotype.random_children(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("case_id"))).select("case_id", F.col("draw").cast("long").alias("draw"), "tier", F.col("child").cast("long").alias("child")),
    "SELECT s_suppkey AS case_id, draw, tier, (strpos('0123456789abcdef', substr(sha256(s_suppkey || '|42|' || draw || '|' || tier), 2, 1)) - 1) % 2 AS child FROM supplier CROSS JOIN range(50) r(draw) CROSS JOIN (VALUES ('H'), ('M'), ('L')) AS t(tier)",
)


# PET: administered dose decayed to the acquisition, and the factor to uptake, for each order as if it were a scan.
def pet(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("dose"), F.col("o_orderdate").alias("t"), (60 + F.col("o_custkey") % 40).cast("double").alias("kg"))
    later, half, frame = F.col("t") + F.expr("INTERVAL 45 MINUTES"), F.lit(6586.2), F.lit(120.0)
    doses = {m: preprocess.decayed_dose(F.col("dose") / 1000 + 1, m, half, F.col("t"), later, frame, F.lit(30.0)) for m in ("ADMIN", "NONE", "START")}
    return o.select("id", *(d.alias(f"dose_{m.lower()}") for m, d in doses.items()), preprocess.suv_scale("CNTS", F.col("kg"), doses["START"], F.lit(3.5)).alias("scale_counts"), preprocess.suv_scale("BQML", F.col("kg"), doses["NONE"]).alias("scale_activity"))


_MID = "ln((ln(2) / 6586.2 * 120) / (1 - exp(-(ln(2) / 6586.2 * 120)))) / (ln(2) / 6586.2)"
add(
    "pet_uptake", pet,
    f"WITH o AS (SELECT o_orderkey AS id, o_totalprice / 1000 + 1 AS dose, CAST(60 + o_custkey % 40 AS DOUBLE) AS kg FROM orders), d AS (SELECT id, kg, dose AS a, dose / pow(2, (2700 + 60) / 6586.2) AS n, dose / pow(2, (2700 + {_MID} - 30) / 6586.2) AS s FROM o) "
    "SELECT id, round(a + 1e-9, 6) AS dose_admin, round(n + 1e-9, 6) AS dose_none, round(s + 1e-9, 6) AS dose_start, round(3.5 * kg * 1000 / s + 1e-9, 6) AS scale_counts, round(kg * 1000 / n + 1e-9, 6) AS scale_activity FROM d", ("id",),
)


def queries():
    from gridlore.plans import more_queries  # noqa: F401  adds its own

    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql():
    from gridlore.plans import more_queries  # noqa: F401

    return {k: s for k, (_, s) in _Q.items() if s}
