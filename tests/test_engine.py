"""Runs from files to features, the container, configuration, phenotyping and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore.operators import phenotype, preprocess
from gridlore.plans import config
from gridlore.plans.engine import Engine, named
from gridlore.sources import container, volumes
from gridlore.streaming.ingest import IMAGE, stream_features


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(0)
    rows = [("c1", z, y, x, float(rng.integers(-40, 60))) for z in range(4) for y in range(5) for x in range(6)]
    images = spark.createDataFrame(rows, "case_id string, z int, y int, x int, val double").cache()
    masks = images.filter("x between 1 and 4 and y > 0").select("case_id", F.lit("tumour").alias("roi_id"), "z", "y", "x", F.lit(1).alias("label")).cache()
    return images, masks


def test_scalar_run(spark, case):
    images, masks = case
    e = Engine({"setting": {"binWidth": 10}, "scalarFeatureClass": {}}, spacing=(2.0, 1.0, 1.0))
    del e.config.scalar["shape2D"]
    rows = e.scalar(images, masks).toPandas()
    counts = rows.groupby(["image_type", "family"]).size()
    assert counts.loc["original"].to_dict() == {"firstorder": 22, "ih": 23, "ivh": 6, "glcm": 26, "glrlm": 16, "glszm": 16, "gldzm": 16, "gldm": 17, "ngtdm": 5, "shape": 26}
    inside = [r["val"] for r in images.filter("x between 1 and 4 and y > 0").collect()]
    get = lambda t, f, n: rows[(rows.image_type == t) & (rows.family == f) & (rows.feature == n)].value.item()
    assert get("original", "firstorder", "Mean") == pytest.approx(np.mean(inside), rel=1e-12)
    assert get("original", "firstorder", "TotalEnergy") == pytest.approx(2 * np.square(inside).sum())


def test_image_types_are_keys(spark, case):
    images, masks = case
    e = Engine({"setting": {"binWidth": 10}, "scalar": {"firstorder": ["Mean"]}, "imageType": {"Original": {}, "Square": {}}})
    m = named(e.scalar(images, masks)).first()["features"]
    assert set(m) == {"original_firstorder_Mean", "square_firstorder_Mean"}


def test_partial_selection_and_resegmentation(spark, case):
    images, masks = case
    e = Engine({"setting": {"binWidth": 10, "resegmentRange": [0, 50]}, "scalar": {"firstorder": ["Mean", "Minimum"], "glcm": ["Contrast"]}})
    rows = {(r["family"], r["feature"]): r["value"] for r in e.scalar(images, masks).collect()}
    assert set(rows) == {("firstorder", "Mean"), ("firstorder", "Minimum"), ("glcm", "Contrast")} and rows["firstorder", "Minimum"] >= 0
    with pytest.raises(ValueError, match="no such feature"):
        Engine({"scalar": {"glcm": ["Contast"]}}).scalar(images, masks)


def test_spatial_run(spark, case):
    images, masks = case
    e = Engine({"setting": {"binWidth": 10}, "scalar": None, "spatial": {}})
    maps = e.execute(images, masks)["spatial"].cache()
    assert len(maps.columns) == 6 + 21 + 26 + 16 + 16 + 17 + 5 and maps.count() == masks.count()
    at = {(r["z"], r["y"], r["x"]): r["val"] for r in images.collect() if 1 <= r["x"] <= 4 and r["y"] > 0}
    r = maps.filter("z = 2 and y = 3 and x = 2").first()
    window = [v for (z, y, x), v in at.items() if abs(z - 2) <= 1 and abs(y - 3) <= 1 and abs(x - 2) <= 1]
    assert r["firstorder_Mean"] == pytest.approx(np.mean(window)) and r["firstorder_10Percentile"] == pytest.approx(np.percentile(window, 10))


def test_resampled_run(spark, case):
    images, masks = case
    e = Engine({"setting": {"resampledPixelSpacing": [2, 2, 0]}, "scalar": {"firstorder": ["Mean", "Minimum", "Maximum"]}})
    r = {x["feature"]: x["value"] for x in e.scalar(images, masks).collect()}
    assert e.grid_spacing == (1.0, 2.0, 2.0) and e.spacing == (1.0, 1.0, 1.0) and -60 <= r["Minimum"] <= r["Mean"] <= r["Maximum"] < 80


def test_unfit_regions_fail(spark, case):
    images, masks = case
    with pytest.raises(Exception, match="region not usable"):
        Engine({"scalar": {"firstorder": ["Mean"]}}).scalar(images, masks.filter("z = 1 and y = 1 and x = 1")).collect()


def test_container_replaces_only_its_mode(spark, case, tmp_path):
    images, masks = case
    e = Engine({"scalar": {"firstorder": ["Mean"]}, "spatial": {"firstorder": ["Mean"]}})
    for mode, df in e.execute(images, masks).items():
        container.write_features(df, str(tmp_path), mode, {"binWidth": 25}, only_case="c1")
    again = e.scalar(images, masks).withColumn("value", F.lit(1.5))
    container.write_features(again, str(tmp_path), "scalar")
    assert container.read_features(spark, str(tmp_path)).first()["value"] == 1.5
    assert {r["mode"] for r in container.stored_modes(spark, str(tmp_path)).collect()} == {"scalar", "spatial"}
    assert container.read_features(spark, str(tmp_path), "spatial").count() == masks.count()
    with pytest.raises(ValueError):
        container.write_features(again, str(tmp_path), "scalar", only_case="other")
    assert container.safe_name("a b/c", "r:1") == "a_b_c_r_1"
    assert container.output_path(None, {"outputDirectory": "d"}, {"GRIDLORE_OUTPUT": "e"}) == "d" and container.output_path(environment={"GRIDLORE_OUTPUT": "e"}) == "e"


def test_files(spark, tmp_path):
    spark.dataSource.register(volumes.VolumeSource)
    a = np.arange(24, dtype=float).reshape(2, 3, 4) - 5
    (tmp_path / "one.nii.gz").write_bytes(volumes.write_nifti(a, (1.5, 1, 2)))
    head = "ObjectType = Image\nNDims = 3\nDimSize = 4 3 2\nElementType = MET_SHORT\nElementSpacing = 1 2 3\nElementDataFile = LOCAL\n"
    (tmp_path / "two.mha").write_bytes(head.encode() + a.astype("<i2").tobytes())
    (tmp_path / "three.nrrd").write_bytes(b"NRRD0004\ntype: float\ndimension: 3\nsizes: 4 3 2\nspacings: 1 1 1\nencoding: raw\nendian: little\n\n" + a.astype("<f4").tobytes())
    rows = spark.read.format("volume").load(str(tmp_path)).toPandas()
    for case in ("one", "two", "three"):
        got = rows[rows.case_id == case].sort_values(["z", "y", "x"]).val.to_numpy()
        assert (got == a.ravel()).all(), case
    g = {r["case_id"]: r for r in spark.read.format("volume").option("geometry", "true").load(str(tmp_path)).collect()}
    assert g["one"]["size"] == [4, 3, 2] and g["one"]["spacing"] == [1.5, 1.0, 2.0] and g["two"]["spacing"] == [1.0, 2.0, 3.0]
    spark.read.format("volume").load(str(tmp_path / "two.mha")).repartition(1, "case_id").write.format("volume").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("volume").load(str(tmp_path / "out")).orderBy("z", "y", "x").toPandas()
    assert (back.val.to_numpy() == a.ravel()).all()


def test_config(tmp_path):
    text = "setting:\n  binWidth: 1\n  distances: [1, 2]\n  voxelBatch: 64\nscalarFeatureClass:\n  firstorder: [Mean]\n  glcm:\nspatialFeatureClass: null\nimageType:\n  Original: {}\n"
    (tmp_path / "c.yaml").write_text(text)
    (tmp_path / "c.json").write_text(json.dumps({"setting": {"binWidth": 3}}))
    c = config.load(tmp_path / "c.yaml")
    assert c.settings.distances == [1, 2] and c.scalar == {"firstorder": ["Mean"], "glcm": []} and c.spatial is None
    assert config.load(tmp_path / "c.json", binWidth=7).settings.binWidth == 7
    assert set(config.load({"scalar": {}}).scalar) == set(config.SCALAR)
    for bad in ({"setting": {"bins": 1}}, {"scalar": {"wavelets": []}}, {"imageType": {"Fourier": {}}}, {"setting": {"binWidth": -1}}, {"setting": {"resegmentMode": "odd"}}):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.load().enable_image_type("square").enable_features("spatial", glcm=["Contrast"]).spatial == {"glcm": ["Contrast"]}


def test_resampling(spark):
    a = np.arange(4 * 4, dtype=float).reshape(1, 4, 4)
    v = spark.createDataFrame([(0, 0, y, x, float(a[0, y, x])) for y in range(4) for x in range(4)], "roi int, z int, y int, x int, val double")
    got = preprocess.resample(v, to=(0, 2.0, 2.0)).orderBy("y", "x").collect()
    assert [r["val"] for r in got] == [a[0, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in (0, 1) for j in (0, 1)]
    same = preprocess.resample(v, to=(1.0, 1.0, 1.0)).orderBy("y", "x").collect()
    assert [r["val"] for r in same] == a.ravel().tolist()


def test_phenotype(spark):
    rng = np.random.default_rng(0)
    rows = []
    for z in range(3):
        for y in range(9):
            for x in range(9):
                level = (x // 3) * 3.0
                rows.append((0, z, y, x, level + rng.normal(0, 0.1), level * level + rng.normal(0, 0.1), 1.0))
    m = spark.createDataFrame(rows, "roi int, z int, y int, x int, firstorder_A double, glcm_B double, glcm_C double")
    kept = phenotype.drop_constant(m)
    assert "glcm_C" not in kept.columns
    t = phenotype.tiers(kept, space="zscore").toPandas()
    assert t.groupby("tier").x.apply(lambda s: set(s // 3)).map(len).eq(1).all()
    assert t.groupby("tier").score.mean().loc[list("HML")].is_monotonic_decreasing
    pes = phenotype.fused(kept, phenotype.tiers(kept))
    assert set(pes.toPandas().status) <= {"completed", "pes_too_small", "pes_too_large"}
    f = phenotype.interaction(pes).first()
    assert f["tier_h_volume_fraction"] == pytest.approx(1 / 3) and 0 <= f["spatial_entropy"] <= np.log2(3) + 1e-6
    assert phenotype.tiers(kept, clusterer="gmm").toPandas().groupby("tier").size().tolist() == [81, 81, 81]
    children = phenotype.both_children(kept, phenotype.tiers(kept)).groupBy("tier", "child").count().collect()
    assert {(r["tier"], r["child"]) for r in children} == {(t, c) for t in "HML" for c in ("selected", "other")} and sum(r["count"] for r in children) == 243
    with pytest.raises(Exception, match="no two children"):
        phenotype.both_children(kept, phenotype.tiers(kept), least=80).collect()
    h = phenotype.habitats(m.withColumnRenamed("firstorder_A", "val")).toPandas()
    assert (h.habitat == h.x // 3).all()
    small = phenotype.enriched(kept.filter("x = 0 and z = 0"))
    assert {r["status"] for r in small.collect()} == {"parent_too_small"}


def test_scores_balance_families_and_blocks():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 500))
    x = np.stack([a, a, a, b], 1)
    names = ["glcm_1", "glcm_2", "glcm_3", "ngtdm_1"]
    s = phenotype.deviation_scores(x, names)
    z = lambda v: (v - v.mean()) / v.std()
    assert np.allclose(s, np.sqrt(0.5 * z(a) ** 2 + 0.5 * z(b) ** 2))
    assert np.allclose(phenotype.deviation_scores(-x, names), s)


def test_pca_share():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 2))
    x = np.concatenate([base, base @ rng.normal(size=(2, 3))], 1)
    assert phenotype.pca(x, 99.9).shape[1] == 2


def test_controls(spark):
    v = spark.createDataFrame([(0, z, y, x, 1.0) for z in range(5) for y in range(5) for x in range(5)], "roi int, z int, y int, x int, val double")
    core = phenotype.distance_core(v, 1).first()
    assert (core["z"], core["y"], core["x"], core["depth"]) == (2, 2, 2, 3.0)
    assert [(r["z"], r["y"], r["x"]) for r in phenotype.top_voxels(v, 2).orderBy("rank").collect()] == [(0, 0, 0), (0, 0, 1)]


def test_comparison_of_maps(spark):
    a = spark.createDataFrame([(0, "f", 1.0), (1, "f", float("nan")), (0, "g", 1.0)], "v int, feature string, value double")
    b = spark.createDataFrame([(0, "f", 1.0 + 1e-9), (1, "f", float("nan")), (0, "g", 2.0)], "v int, feature string, value double")
    r = {x["feature"]: x["concordant"] for x in container.compare_maps(a, b, ["v"]).collect()}
    assert r == {"f": True, "g": False}
    ref = spark.createDataFrame([("t", 1.0, 0.0), ("u", 2.0, 0.5), ("w", 0.0, 0.0)], "tag string, reference_value double, tolerance double")
    got = container.evaluate(spark.createDataFrame([("t", 1.00005), ("u", 3.0)], "tag string, value double"), ref)
    assert {x["tag"]: x["status"] for x in got.collect()} == {"t": "pass", "u": "fail", "w": "unsupported"}
    assert container.pass_rate(got.withColumn("k", F.lit(1)), ["k"]).first()["passed"] == 1


def test_stream(spark, case, tmp_path):
    images, masks = case
    rows = images.join(masks, ["case_id", "z", "y", "x"], "left").select(*[c.split()[0] for c in IMAGE.split(", ")])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    e = Engine({"scalar": {"firstorder": ["Mean"]}})
    stream_features(spark, str(tmp_path / "in"), str(tmp_path / "out"), e, str(tmp_path / "cp")).awaitTermination()
    assert container.read_features(spark, str(tmp_path / "out")).first()["value"] == pytest.approx(e.scalar(images, masks).first()["value"])
