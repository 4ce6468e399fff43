"""Slices in DICOM files (little endian, implicit or explicit, not compressed), put together to volumes."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Attributes that are read, by tag.
TAGS = {
    (0x0002, 0x0010): "syntax", (0x0008, 0x0060): "modality", (0x0018, 0x0050): "thickness", (0x0018, 0x0088): "between", (0x0020, 0x000E): "series", (0x0020, 0x0013): "instance", (0x0020, 0x0032): "position",
    (0x0020, 0x0037): "orientation", (0x0028, 0x0002): "samples", (0x0028, 0x0008): "frames", (0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0030): "spacing", (0x0028, 0x0100): "bits",
    (0x0028, 0x0103): "signed", (0x0028, 0x1052): "intercept", (0x0028, 0x1053): "slope", (0x7FE0, 0x0010): "pixels",
}
#: Value types with a length of four bytes, and transfer syntaxes that are read (whether types are written).
LONG = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
SYNTAXES = {"1.2.840.10008.1.2": False, "1.2.840.10008.1.2.1": True}
ITEM, ITEM_END, SEQUENCE_END, OPEN = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF
SHORTS = ("samples", "rows", "columns", "bits", "signed")


def is_dicom(raw: bytes) -> bool:
    return raw[128:132] == b"DICM"


def _element(raw: bytes, at: int, typed: bool):
    """(tag, length, where the value begins)."""
    tag = struct.unpack_from("<HH", raw, at)
    if tag[0] == 0xFFFE or not typed:
        return tag, struct.unpack_from("<I", raw, at + 4)[0], at + 8
    if raw[at + 4 : at + 6] in LONG:
        return tag, struct.unpack_from("<I", raw, at + 8)[0], at + 12
    return tag, struct.unpack_from("<H", raw, at + 6)[0], at + 8


def _past(raw: bytes, at: int, typed: bool, end) -> int:
    """The place behind a sequence or an item of open length, which ends with the tag `end`."""
    while at < len(raw):
        tag, length, value = _element(raw, at, typed)
        if tag == end:
            return value
        if length == OPEN:
            at = _past(raw, value, typed, ITEM_END if tag == ITEM else SEQUENCE_END)
        else:
            at = value + length
    return at


def attributes(raw: bytes, voxels: bool = True) -> dict:
    """The attributes of TAGS. Numbers are floats, or lists of them."""
    if not is_dicom(raw):
        raise ValueError("not a DICOM file")
    out, at, typed = {}, 132, True
    while at + 8 <= len(raw):
        if raw[at : at + 2] != b"\x02\x00" and "told" not in out:
            out["told"] = True
            if out.get("syntax") not in SYNTAXES:
                raise ValueError(f"transfer syntax {out.get('syntax')} is not read")
            typed = SYNTAXES[out["syntax"]]
        tag, length, value = _element(raw, at, typed)
        name = TAGS.get(tag)
        if name == "pixels":
            if length == OPEN:
                raise ValueError("compressed pixels are not read")
            if voxels:
                out[name] = raw[value : value + length]
            break
        if length == OPEN:
            at = _past(raw, value, typed, SEQUENCE_END)
            continue
        body = raw[value : value + length]
        if name in SHORTS:
            out[name] = struct.unpack_from("<H", body)[0]
        elif name in ("syntax", "series", "modality"):
            out[name] = body.rstrip(b"\0 ").decode("ascii", "replace")
        elif name:
            numbers = [float(x) for x in body.rstrip(b"\0 ").decode("ascii").split("\\") if x.strip()]
            if numbers:
                out[name] = numbers
        at = value + length
    return out


@dataclass
class Series:
    data: np.ndarray | None
    size: list
    spacing: list
    origin: list


def read_series(files: list[bytes], voxels: bool = True) -> dict[str, Series]:
    """Volumes by series. Slices stand in the order of their places along the slices' normal, or of their numbers."""
    by_series: dict[str, list] = {}
    for raw in files:
        a = attributes(raw, voxels)
        by_series.setdefault(a.get("series", ""), []).append(a)
    return {name: _volume(slices, voxels) for name, slices in sorted(by_series.items())}


def _volume(slices: list[dict], voxels: bool) -> Series:
    one = slices[0]
    if any((s["rows"], s["columns"]) != (one["rows"], one["columns"]) for s in slices) or one.get("samples", 1) != 1:
        raise ValueError("slices of one series differ in size, or have colours")
    along = np.array(one.get("orientation", [1, 0, 0, 0, 1, 0]))
    normal = np.cross(along[:3], along[3:])
    placed = all("position" in s for s in slices)
    place = lambda s: float(normal @ s["position"]) if placed else s.get("instance", [0.0])[0]
    slices = sorted(slices, key=place)
    frames = int(one.get("frames", [1])[0])
    step = one.get("between", one.get("thickness", [1.0]))[0]
    if placed and len(slices) > 1:
        step = (place(slices[-1]) - place(slices[0])) / (len(slices) - 1)
    apart = one.get("spacing", [1.0, 1.0])
    data = None
    if voxels:
        kind = f"<{'i' if one.get('signed') else 'u'}{one['bits'] // 8}"
        parts = [np.frombuffer(s["pixels"], kind, frames * s["rows"] * s["columns"]).reshape(frames, s["rows"], s["columns"]) * s.get("slope", [1.0])[0] + s.get("intercept", [0.0])[0] for s in slices]
        data = np.concatenate(parts).astype(float)
    size = [one["columns"], one["rows"], frames * len(slices)]
    return Series(data, size, [apart[1], apart[0], float(step) or 1.0], list(slices[0].get("position", [0.0, 0.0, 0.0])))
