"""Results as Parquet tables partitioned by case, region and mode (scalar, spatial), and their settings as JSON.

A run replaces just the partitions (case, region, mode) it writes; others stay. The committer makes that atomic.
"""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("case_id", "roi_id", "mode")
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Only where all is one
    process (a local master) one of its own will do."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridlore-"))
    return f"file://{_own[0]}"


def safe_name(case: str, roi: str) -> str:
    """`<case>_<roi>` with everything but letters, digits, dot, dash and underscore replaced."""
    return "_".join(re.sub(r"[^A-Za-z0-9._-]+", "_", str(s)).strip("._") or "unnamed" for s in (case, roi))


def output_path(explicit: str | None = None, settings: dict | None = None, environment: dict | None = None, default: str = "gridlore-output") -> str:
    """The first given of: argument, outputPath, outputDirectory, the environment's GRIDLORE_OUTPUT, the default."""
    s, e = settings or {}, environment or {}
    return explicit or s.get("outputPath") or s.get("outputDirectory") or e.get("GRIDLORE_OUTPUT") or default


def write_features(features: DataFrame, path: str, mode: str, settings: dict | None = None, compression: str = "snappy", only_case: str | None = None) -> None:
    """features: case_id, roi_id and either image_type, family, feature, value (scalar) or a row for each voxel (spatial)."""
    if only_case is not None and not features.filter(F.col("case_id") != only_case).limit(1).isEmpty():
        raise ValueError(f"the features hold other cases than {only_case}")
    rows = features.withColumn("mode", F.lit(mode)).withColumn("settings_json", F.lit(json.dumps(settings or {}, sort_keys=True, default=str)))
    rows = rows.filter(~F.col("feature").startswith("diagnostics_")) if "feature" in rows.columns else rows
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*PARTS).parquet(f"{path}/{'features' if mode == 'scalar' else 'maps'}"))


def read_features(spark: SparkSession, path: str, mode: str = "scalar") -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{'features' if mode == 'scalar' else 'maps'}").filter(F.col("mode") == mode)


def stored_modes(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, roi_id, mode) found, off partition values."""
    out = None
    for kind in ("scalar", "spatial"):
        try:
            found = read_features(spark, path, kind).select(*PARTS).distinct()
        except Exception as e:  # a mode that was never written has no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "case_id string, roi_id string, mode string")


def write_phenotypes(tiers: DataFrame, path: str, summary: dict | None = None) -> None:
    """Tiers and enriched subregions: (case_id, roi_id, z, y, x, tier, ...)."""
    tiers.withColumn("summary_json", F.lit(json.dumps(summary or {}, sort_keys=True, default=str))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "roi_id").parquet(f"{path}/phenotypes")


def write_metadata(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(f"{path}/metadata")


def stack(features: DataFrame, keys=("case_id", "roi_id", "z", "y", "x"), names: list[str] | None = None) -> DataFrame:
    """Long (keys, feature, value) to wide; given names save the pass that finds them."""
    return features.groupBy(*keys).pivot("feature", names).agg(F.first("value"))


def same_geometry(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """case_id and whether both geometry tables agree."""
    near = lambda c: F.forall(F.zip_with(F.col(f"a.{c}"), F.col(f"b.{c}"), lambda x, y: F.abs(x - y) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
    return a.alias("a").join(b.alias("b"), "case_id").select("case_id", ((F.col("a.size") == F.col("b.size")) & near("spacing") & near("origin")).alias("same"))


def compare_maps(a: DataFrame, b: DataFrame, keys, absolute: float = 1e-6, relative: float = 1e-11) -> DataFrame:
    """Long maps (keys, feature, value): per feature whether all values agree (either bound) and NaN and infinity lie alike."""
    j = a.withColumnRenamed("value", "u").join(b.withColumnRenamed("value", "w"), [*keys, "feature"], "full")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    d = F.abs(F.col("u") - F.col("w"))
    alike = F.when(odd("u") | odd("w"), F.col("u").eqNullSafe(F.col("w")))
    fine = F.when(~odd("u") & ~odd("w"), (d <= absolute) | (d <= relative * F.greatest(F.abs("u"), F.abs("w"))))
    return j.groupBy("feature").agg(
        F.count("*").alias("voxels"), F.coalesce(F.bool_and(alike), F.lit(True)).alias("nonfinite_alike"), F.max(F.when(~odd("u") & ~odd("w"), d)).alias("max_absolute"), (F.coalesce(F.bool_and(fine), F.lit(True)) & F.coalesce(F.bool_and(alike), F.lit(True))).alias("concordant")
    )


def evaluate(values: DataFrame, reference: DataFrame, noise: float = 1e-4) -> DataFrame:
    """values (tag, value) against reference (tag, reference_value, tolerance): difference and status."""
    d = F.abs(F.col("value") - F.col("reference_value"))
    status = F.when(F.col("value").isNull(), "unsupported").when(F.isnan("value"), "error").when(d <= F.greatest("tolerance", F.lit(noise)), "pass").otherwise("fail")
    return reference.join(values, "tag", "left").withColumn("absolute_difference", d).withColumn("status", status)


def pass_rate(rows: DataFrame, by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "pass").alias("passed")).withColumn("rate", F.col("passed") / F.col("checked"))
