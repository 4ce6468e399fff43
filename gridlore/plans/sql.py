"""SQL forms of the feature families, for the tables of the driver.

Text is put together from the same parts for regions and for windows: `keys` are the columns that name a region.
"""

from __future__ import annotations

from itertools import product

VOX3D = "SELECT l_returnflag AS roi, CAST(l_linenumber - 1 AS BIGINT) AS z, CAST(l_orderkey % 24 AS BIGINT) AS y, CAST(l_partkey % 24 AS BIGINT) AS x, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) % 50 AS DOUBLE) AS val FROM lineitem GROUP BY 1, 2, 3, 4"
VOX2D = "SELECT label AS roi, CAST(0 AS BIGINT) AS z, CAST(vec_id AS BIGINT) AS y, CAST(p - 1 AS BIGINT) AS x, floor(CAST(embedding[p] AS DOUBLE) * 1000) AS val FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)"


def levels(view: str, width: float) -> str:
    return f"SELECT *, CAST(floor(val / {width}) - min(floor(val / {width})) OVER (PARTITION BY roi) + 1 AS BIGINT) AS g FROM ({view})"


def offsets(ndim: int = 3, flat_axis: int | None = None):
    still = 0 if ndim == 2 else flat_axis
    return [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and (still is None or o[still] == 0)]


def offset_rows(os) -> str:
    return "(VALUES " + ", ".join(f"({n}, {z}, {y}, {x})" for n, (z, y, x) in enumerate(os)) + ") AS o(dir, dz, dy, dx)"


def pair_sql(keys, os) -> str:
    """Neighbouring voxels of the table v, each pair once."""
    k = ", ".join(f"a.{c}" for c in keys)
    on = " AND ".join(f"b.{c} = a.{c}" for c in keys)
    return f"SELECT {k}, o.dir, a.z AS z1, a.y AS y1, a.x AS x1, a.g AS g1, b.z, b.y, b.x, b.g AS g2 FROM v a CROSS JOIN {offset_rows(os)} JOIN v b ON {on} AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx"


def rounded(names, keys, source: str, digits: int = 6) -> str:
    return "SELECT " + ", ".join(keys) + ", " + ", ".join(f'round(CAST("{n}" AS DOUBLE) + 1e-9, {digits}) AS "{n}"' for n in names) + f" FROM {source}"


def firstorder(v: str, names, keys=("roi",), shift: float = 0.0, volume: float = 1.0) -> str:
    k = ", ".join(keys)
    j = " AND ".join(f"v.{c} = s.{c}" for c in keys)
    return f"""WITH v AS ({v}),
s AS (SELECT {k}, avg(val) AS mu, CASE WHEN min(val) = max(val) THEN 0 ELSE var_pop(val) END AS va, min(val) AS lo, max(val) AS hi, quantile_cont(val, 0.1) AS p10, quantile_cont(val, 0.25) AS p25,
  quantile_cont(val, 0.5) AS p50, quantile_cont(val, 0.75) AS p75, quantile_cont(val, 0.9) AS p90, sum((val + {shift}) * (val + {shift})) AS en, avg((val + {shift}) * (val + {shift})) AS ms FROM v GROUP BY {k}),
d AS (SELECT {", ".join("v." + c for c in keys)}, avg(abs(val - mu)) AS mad, avg(abs(val - p50)) AS med, avg(pow(val - mu, 3)) AS m3, avg(pow(val - mu, 4)) AS m4, avg(val) FILTER (val BETWEEN p10 AND p90) AS rm FROM v JOIN s ON {j} GROUP BY {", ".join("v." + c for c in keys)}),
r AS (SELECT {", ".join("v." + c for c in keys)}, avg(abs(val - rm)) AS rmad FROM v JOIN s ON {j} JOIN d ON {" AND ".join(f"d.{c} = s.{c}" for c in keys)} WHERE val BETWEEN p10 AND p90 GROUP BY {", ".join("v." + c for c in keys)}),
h AS (SELECT {k}, -sum(p * log2(p)) AS ent, sum(p * p) AS uni FROM (SELECT {k}, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {k}) AS p FROM v GROUP BY {k}, g) GROUP BY {k}),
f AS (SELECT {", ".join("s." + c for c in keys)}, mu AS "Mean", va AS "Variance", CASE WHEN va = 0 THEN 0 ELSE m3 / pow(va, 1.5) END AS "Skewness", CASE WHEN va = 0 THEN 0 ELSE m4 / (va * va) - 3 END AS "Kurtosis",
  lo AS "Minimum", hi AS "Maximum", hi - lo AS "Range", p50 AS "Median", p10 AS "10Percentile", p90 AS "90Percentile", p75 - p25 AS "InterquartileRange", mad AS "MeanAbsoluteDeviation", coalesce(rmad, 0) AS "RobustMeanAbsoluteDeviation", med AS "MedianAbsoluteDeviation",
  CASE WHEN va = 0 THEN 0 WHEN mu = 0 THEN 'Infinity'::DOUBLE ELSE sqrt(va) / mu END AS "CoefficientOfVariation", CASE WHEN p75 + p25 = 0 THEN 1 ELSE (p75 - p25) / (p75 + p25) END AS "QuartileCoefficientOfDispersion",
  sqrt(va) AS "StandardDeviation", en AS "Energy", en * {volume} AS "TotalEnergy", sqrt(ms) AS "RootMeanSquared", ent AS "Entropy", uni AS "Uniformity"
  FROM s JOIN d USING ({k}) LEFT JOIN r USING ({k}) JOIN h USING ({k}))
{rounded(names, keys, "f")}"""


def ih(v: str, names, keys=("roi",)) -> str:
    k = ", ".join(keys)
    base = firstorder("SELECT * EXCLUDE (val), CAST(g AS DOUBLE) AS val FROM (" + v + ")", [n for n in names if n not in IH_OWN], keys)
    return f"""WITH base AS ({base}), c AS (SELECT {k}, g, count(*) AS c FROM ({v}) GROUP BY {k}, g),
m AS (SELECT {k}, sum(g * c) / sum(c) AS mu, max(g) AS ng FROM c GROUP BY {k}),
d AS (SELECT {k}, mu, g, coalesce(c.c, 0) AS c FROM (SELECT {k}, mu, unnest(range(1, ng + 1)) AS g FROM m) LEFT JOIN c USING ({k}, g)),
e AS (SELECT {k}, mu, g, c, lag(c) OVER w AS b, lead(c) OVER w AS a FROM d WINDOW w AS (PARTITION BY {k} ORDER BY g)),
q AS (SELECT {k}, mu, g, c, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a - c WHEN a IS NULL THEN c - b ELSE (a - b) / 2.0 END AS dc FROM e),
t AS (SELECT {k}, max(dc) AS "MaximumHistogramGradient", arg_max(g, dc * 1e6 - g) AS "MaximumHistogramGradientIntensity", min(dc) AS "MinimumHistogramGradient", arg_min(g, dc * 1e6 + g) AS "MinimumHistogramGradientIntensity",
  first(g ORDER BY c DESC, abs(g - mu), g) AS "Mode" FROM q GROUP BY {k})
{rounded(names, keys, f"base JOIN t USING ({k})")}"""


IH_OWN = ("Mode", "MaximumHistogramGradient", "MaximumHistogramGradientIntensity", "MinimumHistogramGradient", "MinimumHistogramGradientIntensity")


def ivh(v: str, names, keys=("roi",), method: str | None = None, bins: int = 100, width: float = 2.5) -> str:
    k = ", ".join(keys)
    x = "CAST(g AS DOUBLE)" if method is None else "val"
    if method in (None, "none"):
        lo = "CAST(1 AS DOUBLE)" if method is None else "min(x)"
        ends = f"SELECT {k}, {lo} AS lo, max(x) AS hi, count(*) AS n, CAST(trunc({lo}) AS BIGINT) AS f, CAST(trunc(max(x)) - trunc({lo}) + 1 AS BIGINT) AS m, 1.0 AS step, trunc({lo}) AS base, max(x) + 1.0 AS nxt FROM d GROUP BY {k}"
        slot, gamma = "CAST(round_even(x, 0) AS BIGINT) - f + 1", "CASE WHEN m <= 1 OR hi = lo THEN 0 ELSE (level - lo) / (hi - lo) END"
    elif method == "fixed_bin_size":
        ends = f"SELECT {k}, min(x) AS lo, max(x) AS hi, count(*) AS n, CAST(ceil((max(x) - min(x)) / {width}) + 1 AS BIGINT) AS m, {width} AS step, min(x) + 0.5 * {width} AS base, min(x) + 0.5 * {width} + ceil((max(x) - min(x)) / {width}) * {width} + {width} AS nxt FROM d GROUP BY {k}"
        slot, gamma = f"greatest(1, least(m, CAST(floor((x - lo) / {width}) + 1 AS BIGINT)))", "CASE WHEN m <= 1 THEN 0 ELSE (slot - 1.0) / (m - 1) END"
    else:
        ends = f"SELECT {k}, min(x) AS lo, max(x) AS hi, count(*) AS n, CAST({bins} AS BIGINT) AS m, 1.0 AS step, 1.0 AS base, {bins} + 1.0 AS nxt FROM d GROUP BY {k}"
        slot, gamma = f"greatest(1, least(m, CAST(floor({bins} * (x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) + 1 AS BIGINT)))", "(slot - 1.0) / (m - 1)"
    return f"""WITH d AS (SELECT {k}, {x} AS x FROM ({v})), e AS ({ends}),
c AS (SELECT {k}, slot, count(*) AS c FROM (SELECT d.*, {slot} AS slot FROM d JOIN e USING ({k})) GROUP BY {k}, slot),
s AS (SELECT e.*, unnest(range(1, m + 1)) AS slot FROM e),
t AS (SELECT s.*, base + (slot - 1) * step AS level, 1.0 - coalesce(sum(c.c) OVER (PARTITION BY {k} ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / n AS nu FROM s LEFT JOIN c USING ({k}, slot)),
u AS (SELECT *, {gamma} AS gam FROM t),
w AS (SELECT {k}, coalesce(max(nu) FILTER (gam >= 0.1), 'NaN'::DOUBLE) AS v10, coalesce(max(nu) FILTER (gam >= 0.9), 'NaN'::DOUBLE) AS v90, coalesce(min(level) FILTER (nu <= 0.1), any_value(nxt)) AS i10, coalesce(min(level) FILTER (nu <= 0.9), any_value(nxt)) AS i90 FROM u GROUP BY {k}),
f AS (SELECT {k}, v10 AS "VolumeFractionAt10Intensity", v90 AS "VolumeFractionAt90Intensity", i10 AS "IntensityAt10Volume", i90 AS "IntensityAt90Volume", v10 - v90 AS "VolumeFractionDifferenceBetween10And90Intensity", i10 - i90 AS "IntensityDifferenceBetween10And90Volume" FROM w)
{rounded(names, keys, "f")}"""


def glcm(v: str, names, keys=("roi",), ndim: int = 3, flat_axis=None, flat_correlation: float = 1.0) -> str:
    k = ", ".join(keys)
    kd = k + ", dir"
    return f"""WITH v AS ({v}), pr AS ({pair_sql(keys, offsets(ndim, flat_axis))}),
b AS (SELECT {kd}, g1 AS i, g2 AS j FROM pr UNION ALL SELECT {kd}, g2, g1 FROM pr),
m AS (SELECT {kd}, i, j, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {kd}) AS p FROM b GROUP BY {kd}, i, j),
l AS (SELECT {k}, max(g) AS ng FROM v GROUP BY {k}), u AS (SELECT {kd}, sum(i * p) AS mu FROM m GROUP BY {kd}),
a AS (SELECT {kd}, sum(i * j * p) AS "Autocorrelation", any_value(mu) AS "JointAverage", sum(pow(i + j - 2 * mu, 4) * p) AS "ClusterProminence", sum(pow(i + j - 2 * mu, 3) * p) AS "ClusterShade", sum(pow(i + j - 2 * mu, 2) * p) AS "ClusterTendency",
  sum((i - j) * (i - j) * p) AS "Contrast", sum(p * p) AS "JointEnergy", -sum(p * log2(p)) AS "JointEntropy", sum(p / (1 + (i - j) * (i - j))) AS "Idm", sum(p / (1 + (i - j) * (i - j) / CAST(ng * ng AS DOUBLE))) AS "Idmn", sum(p / (1 + abs(i - j))) AS "Id", sum(p / (1 + abs(i - j) / CAST(ng AS DOUBLE))) AS "Idn",
  sum(CASE WHEN i <> j THEN p / ((i - j) * (i - j)) ELSE 0 END) AS "InverseVariance", max(p) AS "MaximumProbability", sum((i - mu) * (i - mu) * p) AS "SumSquares", sum(abs(i - j) * p) AS "Dissimilarity", sum((i - mu) * (j - mu) * p) AS cov, count(DISTINCT i) AS kinds
  FROM m JOIN u USING ({kd}) JOIN l USING ({k}) GROUP BY {kd}),
s AS (SELECT {kd}, sum(q * p) AS "SumAverage", -sum(p * log2(p)) AS "SumEntropy", sum(q * q * p) - pow(sum(q * p), 2) AS "SumVariance" FROM (SELECT {kd}, i + j AS q, sum(p) AS p FROM m GROUP BY {kd}, i + j) GROUP BY {kd}),
t AS (SELECT {kd}, sum(q * p) AS "DifferenceAverage", -sum(p * log2(p)) AS "DifferenceEntropy", sum(q * q * p) - pow(sum(q * p), 2) AS "DifferenceVariance" FROM (SELECT {kd}, abs(i - j) AS q, sum(p) AS p FROM m GROUP BY {kd}, abs(i - j)) GROUP BY {kd}),
x AS (SELECT {kd}, i, sum(p) AS px FROM m GROUP BY {kd}, i), h AS (SELECT {kd}, -sum(px * log2(px)) AS hx FROM x GROUP BY {kd}),
h1 AS (SELECT {kd}, -sum(p * log2(x.px * y.px)) AS hxy1 FROM m JOIN x USING ({kd}, i) JOIN (SELECT {kd}, i AS j, px FROM x) y USING ({kd}, j) GROUP BY {kd}),
h2 AS (SELECT {kd}, -sum(x.px * y.px * log2(x.px * y.px)) AS hxy2 FROM x JOIN (SELECT {kd}, i AS j, px FROM x) y USING ({kd}) GROUP BY {kd}),
f AS (SELECT *, CASE WHEN kinds < 2 THEN {flat_correlation} ELSE cov / "SumSquares" END AS "Correlation", CASE WHEN kinds < 2 THEN 0 ELSE ("JointEntropy" - hxy1) / hx END AS "Imc1", CASE WHEN kinds < 2 OR hxy2 <= "JointEntropy" THEN 0 ELSE sqrt(1 - exp(-2 * (hxy2 - "JointEntropy"))) END AS "Imc2"
  FROM a JOIN s USING ({kd}) JOIN t USING ({kd}) JOIN h USING ({kd}) JOIN h1 USING ({kd}) JOIN h2 USING ({kd}))
SELECT {k}, {", ".join(f'round(avg("{n}") + 1e-9, 6) AS "{n}"' for n in names)} FROM f GROUP BY {k}"""


def matrix(m: str, names, keys, count: str | None = None, mean_over: str | None = None, digits: int = 6) -> str:
    """m: SQL of (keys, i, j, n); count: SQL of (keys, nv). mean_over: a key to average over at the end."""
    k = ", ".join(keys)
    nv = "nv" if count else "nj"
    cols = [f"sum({x}) / any_value(t.ns)" for x in ("n / (j * j)", "n * j * j", "n / (i * i)", "n * i * i", "n / (i * i * j * j)", "n * i * i / (j * j)", "n * j * j / (i * i)", "n * i * i * j * j")]
    out = [f"f{x}" for x in range(8)] + ["gi / ns", "gi / (ns * ns)", "gj / ns", "gj / (ns * ns)", f"ns / {nv}", "f3 - mi * mi", "f1 - mj * mj", "ent", "en"]
    chosen = ", ".join(f'{e} AS "{n}"' for e, n in zip(out, names))
    ends = [c for c in keys if c != mean_over]
    final = f"SELECT {', '.join(ends)}, " + ", ".join((f'round(avg("{n}") + 1e-9, {digits})' if mean_over else f'round("{n}" + 1e-9, {digits})') + f' AS "{n}"' for n in names) + " FROM f" + (f" GROUP BY {', '.join(ends)}" if mean_over else "")
    return f"""m AS (SELECT {k}, CAST(i AS DOUBLE) AS i, CAST(j AS DOUBLE) AS j, CAST(n AS DOUBLE) AS n FROM ({m})),
a AS (SELECT {k}, any_value(t.ns) AS ns, any_value(t.nj) AS nj, {", ".join(f"{c} AS f{x}" for x, c in enumerate(cols))}, sum(n * i) / any_value(t.ns) AS mi, sum(n * j) / any_value(t.ns) AS mj, -sum(q * log2(q)) AS ent, sum(n * n) / pow(any_value(t.ns), 2) AS en
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY {k}) AS q FROM m) JOIN (SELECT {k}, sum(n) AS ns, sum(j * n) AS nj FROM m GROUP BY {k}) t USING ({k}) GROUP BY {k}),
gi AS (SELECT {k}, sum(s * s) AS gi FROM (SELECT {k}, i, sum(n) AS s FROM m GROUP BY {k}, i) GROUP BY {k}), gj AS (SELECT {k}, sum(s * s) AS gj FROM (SELECT {k}, j, sum(n) AS s FROM m GROUP BY {k}, j) GROUP BY {k}),
f AS (SELECT {k}, {chosen} FROM a JOIN gi USING ({k}) JOIN gj USING ({k}){f" JOIN ({count}) cnt USING ({k})" if count else ""})
{final}"""


def count_sql(keys) -> str:
    return f"SELECT {', '.join(keys)}, count(*) AS nv FROM v GROUP BY {', '.join(keys)}"


def glrlm(v: str, names, keys=("roi",), ndim: int = 3, flat_axis=None) -> str:
    parts = []
    for n, o in enumerate(offsets(ndim, flat_axis)):
        a = next(i for i in range(3) if o[i])
        t = "zyx"[a]
        parts.append(f"SELECT {', '.join(keys)}, {n} AS dir, g, {t} AS t, " + ", ".join(f"{c} - {t} * {o[i]} AS l{c}" for i, c in enumerate("zyx")) + " FROM v")
    line = f"{', '.join(keys)}, dir, lz, ly, lx"
    return f"""WITH v AS ({v}), d AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, t - row_number() OVER (PARTITION BY {line}, g ORDER BY t) AS island FROM d), r AS (SELECT {line}, g AS i, island, count(*) AS j FROM e GROUP BY {line}, g, island),
{matrix(f"SELECT {', '.join(keys)}, dir, i, j, count(*) AS n FROM r GROUP BY ALL", names, [*keys, "dir"], mean_over="dir")}"""


def gldm(v: str, names, keys=("roi",), alpha: float = 0, ndim: int = 3, flat_axis=None) -> str:
    k = ", ".join(keys)
    return f"""WITH v AS ({v}), pr AS ({pair_sql(keys, offsets(ndim, flat_axis))}), nb AS (SELECT * FROM pr WHERE abs(g1 - g2) <= {alpha}),
en AS (SELECT {k}, z1 AS z, y1 AS y, x1 AS x FROM nb UNION ALL SELECT {k}, z, y, x FROM nb), dep AS (SELECT {k}, z, y, x, count(*) AS k FROM en GROUP BY ALL),
{matrix(f"SELECT {k}, g AS i, coalesce(dep.k, 0) + 1 AS j, count(*) AS n FROM v LEFT JOIN dep USING ({k}, z, y, x) GROUP BY ALL", names, keys, count_sql(keys))}"""


def ngtdm(v: str, names, keys=("roi",), ndim: int = 3, flat_axis=None) -> str:
    k = ", ".join(keys)
    return f"""WITH v AS ({v}), pr AS ({pair_sql(keys, offsets(ndim, flat_axis))}),
en AS (SELECT {k}, z1 AS z, y1 AS y, x1 AS x, g1 AS g, g2 AS o FROM pr UNION ALL SELECT {k}, z, y, x, g2, g1 FROM pr),
w AS (SELECT {k}, z, y, x, g, abs(g - avg(o)) AS d FROM en GROUP BY {k}, z, y, x, g), l AS (SELECT {k}, g, count(*) AS n, sum(d) AS s FROM w GROUP BY {k}, g),
t AS (SELECT {k}, CAST(sum(n) AS DOUBLE) AS nv, count(*) AS ng, sum(s) AS ss FROM l GROUP BY {k}), q AS (SELECT {k}, g, s, n / nv AS p, nv, ng, ss FROM l JOIN t USING ({k})),
z AS (SELECT {", ".join("a." + c for c in keys)}, sum(a.p * b.p * pow(a.g - b.g, 2)) AS c, sum(abs(a.g * a.p - b.g * b.p)) AS bu, sum(abs(a.g - b.g) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS co, sum((a.p + b.p) * pow(a.g - b.g, 2)) AS st
  FROM q a JOIN q b ON {" AND ".join(f"a.{c} = b.{c}" for c in keys)} GROUP BY {", ".join("a." + c for c in keys)}),
ps AS (SELECT {k}, sum(p * s) AS ps, any_value(nv) AS nv, any_value(ng) AS ng, any_value(ss) AS ss FROM q GROUP BY {k}),
f AS (SELECT {k}, CASE WHEN ps = 0 THEN 1e6 ELSE 1 / ps END AS "Coarseness", CASE WHEN ng > 1 THEN c / (ng * (ng - 1)) * ss / nv ELSE 0 END AS "Contrast", CASE WHEN ng > 1 AND bu > 0 THEN ps / bu ELSE 0 END AS "Busyness", co / nv AS "Complexity", CASE WHEN ss > 0 THEN st / ss ELSE 0 END AS "Strength" FROM z JOIN ps USING ({k}))
{rounded(names, keys, "f")}"""


def zones_cte(keys, os) -> str:
    """Zones by transitive closure: only fit for small zones."""
    k = ", ".join(keys)
    on = " AND ".join(f"e.{c} = r.{c}" for c in keys)
    return f"""pr AS ({pair_sql(keys, os)}), vid AS (SELECT {k}, z, y, x, g, (z * 100000 + y) * 100000 + x AS id FROM v),
e AS (SELECT {k}, (z1 * 100000 + y1) * 100000 + x1 AS a, (z * 100000 + y) * 100000 + x AS b FROM pr WHERE g1 = g2), ee AS (SELECT * FROM e UNION ALL SELECT {k}, b, a FROM e),
reach AS (SELECT {k}, id AS a, id AS b FROM vid UNION SELECT {", ".join("r." + c for c in keys)}, r.a, e.b FROM reach r JOIN ee e ON {on} AND e.a = r.b),
root AS (SELECT {k}, a AS id, min(b) AS zone FROM reach GROUP BY {k}, a)"""


def glszm(v: str, names, keys=("roi",), ndim: int = 3, flat_axis=None) -> str:
    k = ", ".join(keys)
    return f"""WITH RECURSIVE v AS ({v}), {zones_cte(keys, offsets(ndim, flat_axis))}, zn AS (SELECT {k}, zone, any_value(g) AS i, count(*) AS j FROM root JOIN vid USING ({k}, id) GROUP BY {k}, zone),
{matrix(f"SELECT {k}, i, j, count(*) AS n FROM zn GROUP BY ALL", names, keys, count_sql(keys))}"""


def gldzm(v: str, names, keys=("roi",), ndim: int = 3) -> str:
    k = ", ".join(keys)
    pad = 0 if ndim == 2 else 1
    on = " AND ".join(f"o.{c} = v.{c}" for c in keys)
    return f"""WITH RECURSIVE v AS ({v}), {zones_cte(keys, offsets(ndim))},
box AS (SELECT {k}, min(z) - {pad} AS z0, max(z) + {pad} AS z1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM v GROUP BY {k}),
bz AS (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM box), by_ AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM bz), bx AS (SELECT {k}, z, y, unnest(range(x0, x1 + 1)) AS x FROM by_),
o AS (SELECT * FROM bx ANTI JOIN v USING ({k}, z, y, x)), dist AS (SELECT {", ".join("v." + c for c in keys)}, v.z, v.y, v.x, min(abs(o.z - v.z) + abs(o.y - v.y) + abs(o.x - v.x)) AS d FROM v JOIN o ON {on} GROUP BY ALL),
zn AS (SELECT {k}, zone, any_value(g) AS i, min(d) AS j FROM root JOIN vid USING ({k}, id) JOIN dist USING ({k}, z, y, x) GROUP BY {k}, zone),
{matrix(f"SELECT {k}, i, j, count(*) AS n FROM zn GROUP BY ALL", names, keys, count_sql(keys))}"""


def window(v: str, radius: int = 1, ndim: int = 3) -> str:
    """Windows of the voxels of v, keyed by roi and the centre."""
    r = range(-radius, radius + 1)
    os = list(product((0,) if ndim == 2 else r, r, r))
    return f"SELECT c.roi, c.z AS cz, c.y AS cy, c.x AS cx, n.z, n.y, n.x, n.val, n.g FROM ({v}) c CROSS JOIN {offset_rows(os)} JOIN ({v}) n ON n.roi = c.roi AND n.z = c.z + o.dz AND n.y = c.y + o.dy AND n.x = c.x + o.dx"
