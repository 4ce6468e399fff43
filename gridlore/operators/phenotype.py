"""Subregions by clustering of feature maps: tiers, enriched subregions, habitats, controls and how they lie to each other.

Maps are wide voxel tables (keys, z, y, x, a column for each feature). A region is clustered where its voxels meet in one
task; its table of voxels x features is what bounds a task, and fits are on at most `max_fit` of its voxels.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.functions.voxels import AXES
from gridlore.operators.morphology import diamond, distance_to, grid_components, grid_dilate, grid_erode, keep_components, smooth
from gridlore.operators.shape import hull


def feature_columns(maps: DataFrame, keys) -> list[str]:
    return [c for c in maps.columns if c not in (*keys, *AXES)]


def family_of(name: str, families=("firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")) -> str:
    return next((f for f in families if f in name.lower().split("_")), "other")


def drop_constant(maps: DataFrame, keys=("roi",), least: float = 1e-6) -> DataFrame:
    """Without features that are constant, or not finite somewhere, in any region. One aggregation decides."""
    names = feature_columns(maps, keys)
    bad = lambda c: F.max((F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int"))
    s = maps.groupBy(*keys).agg(*(F.when(bad(n) == 1, 0.0).otherwise(F.stddev_pop(n)).alias(n) for n in names))
    low = s.agg(*(F.min(n).alias(n) for n in names)).first()
    keep = [n for n in names if low[n] is not None and low[n] >= least]
    return maps.select(*keys, *AXES, *keep)


def zscore(x: np.ndarray) -> np.ndarray:
    """Columns with spread, standardised by population deviation."""
    sd = x.std(0)
    ok = np.isfinite(sd) & (sd > 1e-8)
    return np.nan_to_num((x[:, ok] - x[:, ok].mean(0)) / sd[ok], nan=0.0, posinf=0.0, neginf=0.0)


def _sampled(x: np.ndarray, most: int | None, seed: int) -> np.ndarray:
    if most is None or len(x) <= most:
        return x
    return x[np.sort(np.random.default_rng(seed).choice(len(x), most, replace=False))]


def pca(x: np.ndarray, percent: float = 95.0, most: int | None = 50_000, seed: int = 42) -> np.ndarray:
    """Scores of the components that together explain `percent` of the variance; the largest loading of each is positive."""
    z = zscore(x)
    fit = _sampled(z, most, seed)
    centre = fit.mean(0)
    _, s, axes = np.linalg.svd(fit - centre, full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    axes = axes[: int(np.searchsorted(share, percent / 100 - 1e-12) + 1)]
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return (z - centre) @ (axes * sign[:, None]).T


def kmeans(x: np.ndarray, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300, most: int | None = 50_000) -> np.ndarray:
    """Labels of the best of n_init runs, each begun by distance-weighted drawing."""
    fit, rng, best = _sampled(x, most, seed), np.random.default_rng(seed), None
    for _ in range(n_init):
        c = fit[rng.integers(len(fit))][None]
        while len(c) < k:
            d = ((fit[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.concatenate([c, fit[rng.choice(len(fit), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(fit))][None]])
        for _ in range(max_iter):
            label = ((fit[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.stack([fit[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c, rtol=0, atol=1e-10):
                break
            c = new
        cost = ((fit[:, None] - c[None]) ** 2).sum(-1).min(1).sum()
        if best is None or cost < best[0] - 1e-12:
            best = cost, c
    return np.concatenate([((x[i : i + 65536, None] - best[1][None]) ** 2).sum(-1).argmin(1) for i in range(0, len(x), 65536)])


def gaussian_mixture(x: np.ndarray, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300, most: int | None = 50_000) -> np.ndarray:
    """Labels of a mixture of Gaussians with diagonal covariances; the variance floor rises until a fit holds."""
    fit = _sampled(x, most, seed)
    first = kmeans(fit, k, seed, n_init, max_iter, None)
    for floor in (1e-6, 1e-5, 1e-4, 1e-3, 1e-2):
        r = np.eye(k)[first]
        for _ in range(max_iter):
            n = r.sum(0) + 1e-10
            mu = r.T @ fit / n[:, None]
            var = r.T @ fit**2 / n[:, None] - mu**2 + floor
            log = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((fit[:, None] - mu) ** 2 / var).sum(-1))
            new = np.exp(log - log.max(1, keepdims=True))
            new /= new.sum(1, keepdims=True)
            done = np.abs(new - r).max() < 1e-6
            r = new
            if done:
                break
        if np.isfinite(r).all() and (var > 0).all():
            break
    log = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mu) ** 2 / var).sum(-1))
    return log.argmax(1)


CLUSTERERS = {"kmeans": kmeans, "gmm": gaussian_mixture}


def correlation_blocks(z: np.ndarray, columns: list[int], threshold: float) -> list[list[int]]:
    """Columns joined where their correlation is at least threshold in size, chains included."""
    left, out = list(columns), []
    r = np.abs(np.atleast_2d(np.corrcoef(z[:, columns].T))) if len(columns) > 1 else np.ones((1, 1))
    place = {c: n for n, c in enumerate(columns)}
    while left:
        block, ahead = [], [left.pop(0)]
        while ahead:
            c = ahead.pop()
            block.append(c)
            near = [o for o in left if r[place[c], place[o]] >= threshold]
            left = [o for o in left if o not in near]
            ahead += near
        out.append(sorted(block))
    return out


def deviation_scores(x: np.ndarray, names: list[str], mode: str = "weighted_deviation", threshold: float = 0.9, family_weights: dict | None = None) -> np.ndarray:
    """How far each voxel lies from the region's mean: root of the weighted squares of z-scores. Families weigh alike (or as given),
    in a family its blocks of correlated features, in a block its features."""
    sd = x.std(0)
    ok = np.isfinite(sd) & (sd > 1e-8)
    if not ok.any():
        raise ValueError("no feature with spread")
    z = np.nan_to_num((x[:, ok] - x[:, ok].mean(0)) / sd[ok], nan=0.0, posinf=0.0, neginf=0.0)
    names = [n for n, k in zip(names, ok) if k]
    if mode == "legacy_signed_mean":
        return z.mean(1)
    if mode == "unweighted_deviation":
        return np.sqrt((z**2).mean(1))
    families: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        families.setdefault(family_of(n), []).append(i)
    weight = {f: 1.0 if family_weights is None else max(0.0, family_weights.get(f, 0.0)) for f in families}
    total, w = sum(weight.values()), np.zeros(len(names))
    if total <= 0:
        raise ValueError("no family has a positive weight")
    for f, columns in families.items():
        blocks = correlation_blocks(z, columns, threshold)
        for b in blocks:
            w[b] = weight[f] / total / len(blocks) / len(b)
    return np.sqrt((z**2 * w).sum(1))


def _space(x, space: str, percent: float, seed: int, max_fit: int | None):
    return pca(x, percent, max_fit, seed) if space == "pca" else zscore(x)


def _by_region(maps: DataFrame, keys, f, out: str) -> DataFrame:
    keys = list(keys)
    schema = StructType([maps.schema[k] for k in keys])
    for field in StructType.fromDDL(out).fields:
        schema = schema.add(field)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(AXES)).reset_index(drop=True)
        r = f(pdf)
        return pd.concat([pdf[keys].iloc[:1].loc[[0] * len(r)].reset_index(drop=True), r.reset_index(drop=True)], axis=1)

    return maps.groupBy(*keys).applyInPandas(run, schema)


def tiers(maps: DataFrame, keys=("roi",), space: str = "pca", clusterer: str = "kmeans", percent: float = 95.0, seed: int = 42, score: str = "weighted_deviation", threshold: float = 0.9, max_fit: int | None = 50_000) -> DataFrame:
    """(keys, z, y, x, cluster, score, tier): three clusters, H, M and L by falling mean score. max_fit: voxels of a region that the
    components and clusters are fitted to (None: all); all voxels are projected and labelled."""
    names = feature_columns(maps, keys)

    def run(pdf):
        x = pdf[names].to_numpy(float)
        label = CLUSTERERS[clusterer](_space(x, space, percent, seed, max_fit), 3, seed, most=max_fit)
        s = deviation_scores(x, names, score, threshold)
        mean = [s[label == j].mean() if (label == j).any() else -np.inf for j in range(3)]
        rank = np.argsort(np.argsort(-np.array(mean), kind="stable"))
        return pdf[list(AXES)].assign(cluster=label.astype(np.int32), score=s, tier=np.array(list("HML"))[rank[label]])

    return _by_region(maps, keys, run, "z int, y int, x int, cluster int, score double, tier string")


#: When an enriched subregion is not reported, and how its mask is tidied.
RULES = {"min_parent_voxels": 32, "min_voxels": 16, "min_fraction": 0.01, "max_fraction": 0.95, "min_features": 1}
TIDY = {"closing": 2, "opening": 1, "dilation": 0, "fill": True, "in_plane": False}


def _grid(at: np.ndarray):
    low = at.min(0)
    g = np.zeros(at.max(0) - low + 1, bool)
    return low, g


def tidied(raw: np.ndarray, parent: np.ndarray, least: int = 8, fraction: float = 0.002, most: int = 0, min_voxels: int = 16, **how) -> np.ndarray:
    """The mask smoothed, without small components, within its parent; if too little is left, as it was."""
    m = smooth(raw, **(TIDY | how)) & parent
    m = keep_components(m, max(least, int(np.ceil(parent.sum() * fraction))), most) & parent
    return raw & parent if m.sum() < min_voxels else m


def enriched(maps: DataFrame, keys=("roi",), space: str = "pca", clusterer: str = "kmeans", percent: float = 95.0, seed: int = 42, score: str = "weighted_deviation", rules: dict | None = None, postprocess: bool = True, max_fit: int | None = 50_000) -> DataFrame:
    """The enriched subregion of each region of keys (a tier may be one of them): of two clusters the one with the higher mean score,
    tidied. (keys, z, y, x, cluster, score, pes, status): status is `completed`, or why there is none."""
    names, rules = feature_columns(maps, keys), RULES | (rules or {})

    def run(pdf):
        out = pdf[list(AXES)].assign(cluster=np.int32(-1), score=np.nan, pes=False, status="completed")
        x = pdf[names].to_numpy(float)
        ok = np.isfinite(x).all(0) & (np.nan_to_num(x).std(0) >= 1e-6)
        if ok.sum() < rules["min_features"]:
            return out.assign(status="no_valid_feature_channels")
        if len(x) < rules["min_parent_voxels"]:
            return out.assign(status="parent_too_small")
        x, kept = x[:, ok], [n for n, k in zip(names, ok) if k]
        label = CLUSTERERS[clusterer](_space(x, space, percent, seed, max_fit), 2, seed, most=max_fit)
        s = deviation_scores(x, kept, score)
        mean = [s[label == j].mean() if (label == j).any() else -np.inf for j in range(2)]
        chosen = label == int(np.argmax(mean))
        at = pdf[list(AXES)].to_numpy(np.int64)
        low, parent = _grid(at)
        spot = tuple((at - low).T)
        parent[spot] = True
        raw = np.zeros_like(parent)
        raw[spot] = chosen
        m = tidied(raw, parent, min_voxels=rules["min_voxels"]) if postprocess else raw
        n, share = m.sum(), m.sum() / len(x)
        status = "completed"
        if len(np.unique(label)) < 2:
            status = "single_nonempty_cluster"
        elif n < rules["min_voxels"] or share < rules["min_fraction"]:
            status = "pes_too_small"
        elif share > rules["max_fraction"]:
            status = "pes_too_large"
        return out.assign(cluster=label.astype(np.int32), score=s, pes=m[spot] & (status == "completed"), status=status)

    return _by_region(maps, keys, run, "z int, y int, x int, cluster int, score double, pes boolean, status string")


def fused(maps: DataFrame, tier: DataFrame, keys=("roi",), **how) -> DataFrame:
    """Tiers with the union of their enriched subregions: (keys, z, y, x, tier, cluster, score, pes, status)."""
    keys = list(keys)
    within = maps.join(tier.select(*keys, *AXES, "tier"), [*keys, *AXES])
    return enriched(within, [*keys, "tier"], **how)


def habitats(v: DataFrame, keys=("roi",), k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters of raw intensity, numbered by rising mean; a region of fewer than 4k voxels is one."""

    def run(pdf):
        x = np.nan_to_num(pdf["val"].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        if len(x) < 4 * k:
            return pdf[list(AXES)].assign(habitat=np.int32(0))
        label = kmeans(x[:, None], k, seed)
        mean = [x[label == j].mean() if (label == j).any() else np.inf for j in range(k)]
        return pdf[list(AXES)].assign(habitat=np.argsort(np.argsort(mean)).astype(np.int32)[label])

    return _by_region(v, keys, run, "z int, y int, x int, habitat int")


#: Names of the features, in their order.
INTERACTION = (
    "tier_h_volume_fraction", "tier_m_volume_fraction", "tier_l_volume_fraction", "tier_h_tier_l_interface", "tier_h_tier_m_interface", "tier_m_distance_to_h_mean", "tier_m_distance_to_h_std",
    "tier_h_solidity", "spatial_entropy", "pes_volume_fraction", "pes_fragmentation", "pes_eccentricity", "pes_tier_m_adjacency", "pes_sphericity",
)


def interaction(t: DataFrame, keys=("roi",)) -> DataFrame:
    """14 features of how tiers (column tier) and the enriched subregion (column pes) lie to each other."""

    def run(pdf):
        at = pdf[list(AXES)].to_numpy(np.int64)
        low = at.min(0) - 1
        empty = np.zeros(at.max(0) - low + 2, bool)

        def mask(which):
            m = empty.copy()
            m[tuple((at[which] - low).T)] = True
            return m

        tier = pdf["tier"].to_numpy()
        h, m, lo = (mask(tier == x) for x in "HML")
        pes = mask(pdf["pes"].to_numpy(bool)) if "pes" in pdf else empty
        n, nh, nm, npes = len(at), h.sum(), m.sum(), pes.sum()
        rim = grid_dilate(h, diamond()) & ~h
        d = distance_to(h, np.argwhere(m)) if nh and nm else np.zeros(1)
        solid = 0.0 if not nh else 1.0
        if nh >= 4:
            volume = hull(np.argwhere(h).astype(float))[0] if np.linalg.matrix_rank(np.argwhere(h) - np.argwhere(h)[0]) == 3 else None
            solid = 1.0 if volume is None else nh / max(volume, 1.0)
        slices = [g["tier"].value_counts(normalize=True).to_numpy() for _, g in pdf.groupby("z")]
        entropy = float(np.mean([-(p * np.log2(p + 1e-12)).sum() if len(p) > 1 else 0.0 for p in slices]))
        parts = [0.0] * 5
        if npes:
            outer = grid_dilate(pes, diamond()) & ~pes
            far = np.linalg.norm(np.argwhere(pes).mean(0) - np.argwhere(h).mean(0)) / max((3 * nh / (4 * np.pi)) ** (1 / 3), 1.0) if nh else 0.0
            skin = (pes & ~grid_erode(pes, diamond())).sum()
            parts = [npes / n, float(grid_components(pes, False).max()), far, (outer & m).sum() / max(outer.sum(), 1), (36 * np.pi * npes**2) ** (1 / 3) / max(skin, 1) if npes >= 4 else 0.0]
        r = max(rim.sum(), 1)
        values = [nh / n, nm / n, lo.sum() / n, (rim & lo).sum() / r, (rim & m).sum() / r, d.mean(), d.std(), solid, entropy, *parts]
        return pd.DataFrame([dict(zip(INTERACTION, map(float, values)))])

    return _by_region(t, keys, run, ", ".join(f"{n} double" for n in INTERACTION))


def summarize(maps: DataFrame, keys=("roi",)) -> DataFrame:
    """(keys, feature, mean, std, p10, p90)."""
    names = feature_columns(maps, keys)
    long = maps.select(*keys, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("double"))])).alias("feature", "v"))
    return long.groupBy(*keys, "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"))


def top_voxels(v: DataFrame, n: int, keys=("roi",), value: str = "val") -> DataFrame:
    """Exactly the n highest voxels of each region; ties go to the first in order of z, y, x."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *AXES)
    return v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def global_top(maps: DataFrame, keys=("roi",), k: int = 6, best: int = 3, least_region: int = 96, least: int = 16, seed: int = 42, max_fit: int | None = 50_000) -> DataFrame:
    """Control: of k clusters over a region, the `best` with the highest mean scores, if each is large enough."""
    names = feature_columns(maps, keys)

    def run(pdf):
        x, out = pdf[names].to_numpy(float), pdf[list(AXES)].assign(cluster=np.int32(-1), chosen=False)
        if len(x) < least_region:
            return out
        label, s = kmeans(pca(x, most=max_fit, seed=seed), k, seed, most=max_fit), deviation_scores(x, names)
        ranked = sorted((j for j in range(k) if (label == j).any()), key=lambda j: -s[label == j].mean())[:best]
        fit = len(ranked) == best and all((label == j).sum() >= least for j in ranked)
        return out.assign(cluster=label.astype(np.int32), chosen=np.isin(label, ranked) & fit)

    return _by_region(maps, keys, run, "z int, y int, x int, cluster int, chosen boolean")


def distance_core(mask: DataFrame, n: int, keys=("roi",)) -> DataFrame:
    """Control: the n voxels deepest inside a region."""

    def run(pdf):
        at = pdf[list(AXES)].to_numpy(np.int64)
        low = at.min(0) - 1
        g = np.zeros(at.max(0) - low + 2, bool)
        g[tuple((at - low).T)] = True
        d = distance_to(~g, at - low)
        order = np.lexsort((*at.T[::-1], -d))[:n]
        return pdf[list(AXES)].iloc[order].assign(depth=d[order])

    return _by_region(mask, keys, run, "z int, y int, x int, depth double")


def both_children(maps: DataFrame, tier: DataFrame, keys=("roi",), least: int = 16, **how) -> DataFrame:
    """Control: of each tier both clusters, not tidied: (keys, z, y, x, tier, child: selected or other). It fails when read if a tier has no
    enriched subregion or a child of fewer than `least` voxels."""
    keys = list(keys)
    child = F.when(F.col("pes"), "selected").otherwise("other")
    e = fused(maps, tier, keys, postprocess=False, **how).withColumn("child", child)
    by = lambda *c: Window.partitionBy(*keys, "tier", *c)
    few = (F.count("*").over(by("child")) < least) | (F.count("*").over(by("child")) == F.count("*").over(by()))
    fail = F.raise_error(F.concat(F.lit("no two children of enough voxels in tier "), "tier")).cast("string")
    return e.withColumn("few", few).select(*keys, *AXES, "tier", F.when(F.col("few") | (F.col("status") != "completed"), fail).otherwise(F.col("child")).alias("child"))


def random_children(names: DataFrame, draws: int = 50, case: str = "case_id", seed: int = 42) -> DataFrame:
    """Control: for each draw and tier which child is taken, 0 for the selected and 1 for the other one: the parity of the first byte of
    a SHA-256 of case, seed, draw and tier."""
    d = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.array(*map(F.lit, "HML"))).alias("tier"))
    first = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(case).cast("string"), F.lit(str(seed)), F.col("draw").cast("string"), "tier"), 256), 1, 2), 16, 10).cast("int")
    return d.withColumn("child", first % 2)


def settings_json(**settings) -> str:
    return json.dumps(settings, sort_keys=True)
