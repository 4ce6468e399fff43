"""DICOM slices as volumes."""

import struct

import numpy as np
import pytest

from gridlore.sources import dicom, volumes


def _slice(plane, place, series="1.2.3", typed=True, syntax=None, slope=2, intercept=-1000):
    def element(group, number, kind, body):
        body += b" " * (len(body) % 2) if kind != "OW" else b""
        if group != 2 and not typed:
            return struct.pack("<HHI", group, number, len(body)) + body
        if kind in ("OW", "SQ", "OB"):
            return struct.pack("<HH2sHI", group, number, kind.encode(), 0, len(body)) + body
        return struct.pack("<HH2sH", group, number, kind.encode(), len(body)) + body

    us = lambda n: struct.pack("<H", n)
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(8, 0x1150, "UI", b"1.2") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    opened = struct.pack("<HH2sHI", 8, 0x1140, b"SQ", 0, 0xFFFFFFFF) if typed else struct.pack("<HHI", 8, 0x1140, 0xFFFFFFFF)
    body = element(2, 0x10, "UI", (syntax or ("1.2.840.10008.1.2.1" if typed else "1.2.840.10008.1.2")).encode()) + element(8, 0x60, "CS", b"CT") + opened + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body += element(0x20, 0xE, "UI", series.encode()) + element(0x20, 0x32, "DS", f"1\\\\2\\\\{place}".replace("\\\\", "\\").encode()) + element(0x28, 2, "US", us(1)) + element(0x28, 0x10, "US", us(plane.shape[0])) + element(0x28, 0x11, "US", us(plane.shape[1]))
    body += element(0x28, 0x30, "DS", b"0.5\\0.75") + element(0x28, 0x100, "US", us(16)) + element(0x28, 0x103, "US", us(1)) + element(0x28, 0x1052, "DS", str(intercept).encode()) + element(0x28, 0x1053, "DS", str(slope).encode())
    return b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, "OW", plane.astype("<i2").tobytes())


@pytest.mark.parametrize("typed", [True, False])
def test_series(spark, tmp_path, typed):
    spark.dataSource.register(volumes.VolumeSource)
    cube = np.arange(60).reshape(3, 4, 5) - 7
    (tmp_path / "scan").mkdir()
    for k, place in ((2, 6.0), (0, 1.0), (1, 3.5)):  # files are not in the order of places
        (tmp_path / "scan" / f"{9 - k}.dcm").write_bytes(_slice(cube[k], place, typed=typed))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.dcm").write_bytes(_slice(cube[0], 0, "1.9", typed))
    (tmp_path / "other" / "b.dcm").write_bytes(_slice(cube[1], 0, "1.8", typed))
    rows = spark.read.format("volume").load(str(tmp_path)).toPandas()
    assert set(rows.case_id) == {"scan", "other-1.9", "other-1.8"}
    got = rows[rows.case_id == "scan"].sort_values(["z", "y", "x"])
    assert (got.val.to_numpy() == (2 * cube - 1000).ravel()).all()
    g = {r["case_id"]: r for r in spark.read.format("volume").option("geometry", "true").load(str(tmp_path)).collect()}["scan"]
    assert (g["size"], g["spacing"], g["origin"]) == ([5, 4, 3], [0.75, 0.5, 2.5], [1.0, 2.0, 1.0])
    spark.read.format("volume").load(str(tmp_path / "scan")).repartition(1, "case_id").write.format("volume").mode("append").save(str(tmp_path / "nifti"))
    back = spark.read.format("volume").load(str(tmp_path / "nifti")).orderBy("z", "y", "x").toPandas()
    assert (back.val.to_numpy() == got.val.to_numpy()).all() and set(back.case_id) == {"scan"}


def test_what_is_not_read():
    with pytest.raises(ValueError, match="not a DICOM"):
        dicom.attributes(b"x" * 200)
    with pytest.raises(ValueError, match="transfer syntax"):
        dicom.attributes(_slice(np.zeros((2, 2)), 0, syntax="1.2.840.10008.1.2.4.70"))


def test_equal_names_in_two_folders_are_two_cases(spark, tmp_path):
    spark.dataSource.register(volumes.VolumeSource)
    for k, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "image.nii.gz").write_bytes(volumes.write_nifti(np.full((1, 2, 2), float(k))))
    rows = spark.read.format("volume").load(str(tmp_path)).groupBy("case_id").avg("val").collect()
    assert {tuple(r) for r in rows} == {("a/image", 0.0), ("b/image", 1.0)}
