"""Image files as tables: a Python data source for NIfTI, MetaImage, NRRD and series of DICOM slices, and a NIfTI writer.

    spark.dataSource.register(VolumeSource)
    spark.read.format("volume").load("folder or file")      # case_id, z, y, x, val
    df.write.format("volume").mode("append").save("folder")  # a .nii.gz for each case

A partition is a file, or a folder of DICOM slices (.dcm), of which each series is a case. The format is told by name and
header; option format=nifti|metaimage|nrrd|dicom forces it (dicom: all files of a folder are slices). Option geometry=true
gives a row for each case (size, spacing, origin) and yields no voxels. A case is named by its file or folder; where names
repeat, by the path below the folder that is read.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

VOXELS = "case_id string, z int, y int, x int, val double"
GEOMETRY = "case_id string, ndim int, size array<int>, spacing array<double>, origin array<double>"
ENDINGS = (".nii", ".nii.gz", ".hdr", ".mha", ".mhd", ".nrrd")
SLICE = ".dcm"
#: NIfTI's data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD_TYPES = {
    "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8",
}


@dataclass
class Volume:
    """data: z, y, x (a plane has one z); size, spacing, origin: x, y, z."""

    data: np.ndarray | None
    size: list
    spacing: list
    origin: list


def read_nifti(raw: bytes, voxels: bool = True, beside: bytes | None = None) -> Volume:
    """beside: the data of a header in a file of its own."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = next((o for o in "<>" if struct.unpack_from(o + "i", raw)[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    start, slope, shift = struct.unpack_from(order + "3f", raw, 108)
    if code not in NIFTI_TYPES:
        raise ValueError(f"data type {code} is not read")
    n = min(dim[0], 3)
    size = [max(1, d) for d in dim[1 : n + 1]]
    origin = list(struct.unpack_from(order + "3f", raw, 268)) if struct.unpack_from(order + "h", raw, 252)[0] > 0 else [0.0] * 3
    data = None
    if voxels:
        body = beside if beside is not None else raw[int(start) :]
        body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
        data = np.frombuffer(body, order + NIFTI_TYPES[code], int(np.prod(size))).astype(float).reshape(size[::-1])
        data = data * slope + shift if slope else data
        data = data.reshape((1,) * (3 - n) + data.shape)
    return Volume(data, size, [abs(float(p)) or 1.0 for p in pixdim[1 : n + 1]], origin[:n])


def read_metaimage(raw: bytes, voxels: bool = True, beside=None) -> Volume:
    head, place = {}, 0
    while True:
        end = raw.index(b"\n", place)
        k, _, v = raw[place:end].decode("latin-1").partition("=")
        head[k.strip()] = v.strip()
        place = end + 1
        if k.strip() == "ElementDataFile":
            break
    size = [int(x) for x in head["DimSize"].split()]
    spacing = [float(x) for x in head.get("ElementSpacing", head.get("ElementSize", "1 " * len(size))).split()]
    origin = [float(x) for x in head.get("Offset", head.get("Position", "0 " * len(size))).split()]
    data = None
    if voxels:
        body = raw[place:] if head["ElementDataFile"] == "LOCAL" else beside(head["ElementDataFile"])
        body = zlib.decompress(body) if head.get("CompressedData", "False") == "True" else body
        big = head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True"
        data = _grid(body, ("<", ">")[big] + META_TYPES[head["ElementType"]], size)
    return Volume(data, size, spacing, origin)


def read_nrrd(raw: bytes, voxels: bool = True, beside=None) -> Volume:
    text, _, body = raw.partition(b"\n\n")
    head = {}
    for line in text.decode("latin-1").splitlines()[1:]:
        if not line.startswith("#") and ":" in line:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.lstrip("=").strip()
    size = [int(x) for x in head["sizes"].split()]
    vector = lambda s: [float(x) for x in s.strip("() ").split(",")]
    if "spacings" in head:
        spacing = [float(x) for x in head["spacings"].split()]
    elif "space directions" in head:
        spacing = [float(np.linalg.norm(vector(v))) for v in head["space directions"].replace(") (", ")|(").split("|") if v != "none"]
    else:
        spacing = [1.0] * len(size)
    origin = vector(head["space origin"]) if "space origin" in head else [0.0] * len(size)
    data = None
    if voxels:
        if "data file" in head:
            body = beside(head["data file"])
        kind = head.get("encoding", "raw")
        if kind in ("gzip", "gz"):
            body = gzip.decompress(body)
        elif kind != "raw":
            raise ValueError(f"encoding {kind} is not read")
        data = _grid(body, (">" if head.get("endian") == "big" else "<") + NRRD_TYPES[head["type"]], size)
    return Volume(data, size, spacing, origin)


def _grid(body: bytes, kind: str, size) -> np.ndarray:
    data = np.frombuffer(body, kind, int(np.prod(size))).astype(float).reshape(size[::-1])
    return data.reshape((1,) * (3 - data.ndim) + data.shape)


def write_nifti(data: np.ndarray, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> bytes:
    """A gzipped NIfTI-1 file of doubles. data: z, y, x; spacing and origin: x, y, z."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *data.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<hh", head, 252, 1, 0)
    struct.pack_into("<3f", head, 268, *origin)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.ascontiguousarray(data, "<f8").tobytes())


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def case_of(name: str) -> str:
    """A file's name without its ending."""
    base = name.rsplit("/", 1)[-1]
    end = max((e for e in ENDINGS if base.lower().endswith(e)), key=len, default="")
    return base[: len(base) - len(end)]


@dataclass
class File(InputPartition):
    """A file, or the slices of a folder."""

    path: str
    case: str
    slices: tuple = ()

    def __post_init__(self):
        self.value = self.path


class VolumeSource(DataSource):
    @classmethod
    def name(cls):
        return "volume"

    def schema(self):
        return GEOMETRY if self.options.get("geometry") == "true" else VOXELS

    def reader(self, schema):
        return VolumeReader(self.options)

    def writer(self, schema, overwrite):
        return VolumeWriter(self.options)


class VolumeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.geometry, self.format = options["path"], options.get("geometry") == "true", options.get("format", "auto")

    def partitions(self):
        from pyarrow import fs

        store, top = _open(self.path)
        info = store.get_file_info(top)
        names = [top] if info.is_file else [i.path for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file]
        is_slice = (lambda n: True) if self.format == "dicom" else lambda n: n.lower().endswith(SLICE)
        folders: dict[str, list] = {}
        for n in sorted(n for n in names if is_slice(n)):
            folders.setdefault(n.rsplit("/", 1)[0], []).append(n)
        out = [File(n, case_of(n)) for n in sorted(names) if n.lower().endswith(ENDINGS) and not is_slice(n)]
        out += [File(f, f.rsplit("/", 1)[-1], tuple(own)) for f, own in folders.items()]
        seen = Counter(f.case for f in out)
        for f in out:
            if seen[f.case] > 1:
                f.case = f.path[len(top) :].strip("/")[: -len(f.path.rsplit("/", 1)[-1]) or None] + f.case if not f.slices else f.path[len(top) :].strip("/") or f.case
        return out

    def read(self, file):
        store, _ = _open(self.path)
        get = lambda n: store.open_input_file(n).read()
        if file.slices:
            from gridlore.sources.dicom import read_series

            found = read_series([get(n) for n in file.slices], not self.geometry)
            for name, v in found.items():
                yield from self._rows(file.case if len(found) == 1 else f"{file.case}-{name}", v)
            return
        folder, low = file.path.rsplit("/", 1)[0], file.path.lower()
        raw, near = get(file.path), lambda n: get(f"{folder}/{n}")
        kind = self.format if self.format != "auto" else "metaimage" if low.endswith((".mha", ".mhd")) else "nrrd" if raw[:4] == b"NRRD" else "nifti"
        if kind == "metaimage":
            v = read_metaimage(raw, not self.geometry, near)
        elif kind == "nrrd":
            v = read_nrrd(raw, not self.geometry, near)
        else:
            v = read_nifti(raw, not self.geometry, get(file.path[:-4] + ".img") if low.endswith(".hdr") and not self.geometry else None)
        yield from self._rows(file.case, v)

    def _rows(self, case, v):
        if self.geometry:
            yield case, len(v.size), v.size, v.spacing, v.origin
            return
        import pyarrow as pa

        step = max(1, 1_000_000 // max(1, v.data[0].size))
        for z in range(0, len(v.data), step):
            part = v.data[z : z + step]
            at = np.indices(part.shape, np.int32)
            n = part.size
            yield pa.RecordBatch.from_arrays([pa.array([case] * n), pa.array((at[0] + z).ravel().astype(np.int32)), pa.array(at[1].ravel()), pa.array(at[2].ravel()), pa.array(part.ravel())], names=["case_id", "z", "y", "x", "val"])


@dataclass
class Wrote(WriterCommitMessage):
    names: list


class VolumeWriter(DataSourceWriter):
    """Rows of VOXELS, a task having whole cases: repartition by case_id before. Missing places are 0."""

    def __init__(self, options):
        self.path, self.spacing = options["path"], [float(x) for x in options.get("spacing", "1,1,1").split(",")]

    def write(self, rows):
        cases: dict[str, list] = {}
        for r in rows:
            cases.setdefault(r["case_id"], []).append((r["z"], r["y"], r["x"], r["val"]))
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        names = []
        for case, at in cases.items():
            a = np.array(at, float)
            spot = a[:, :3].astype(int)
            grid = np.zeros(spot.max(0) + 1)
            grid[tuple(spot.T)] = a[:, 3]
            names.append((f"{top}/.{case}-{uuid.uuid4().hex}", f"{top}/{case}.nii.gz"))
            with store.open_output_stream(names[-1][0], compression=None) as f:
                f.write(write_nifti(grid, self.spacing))
        return Wrote(names)

    def commit(self, messages):
        """Files get their names when all have been written."""
        store, _ = _open(self.path)
        for m in messages:
            for hidden, name in m.names if m else ():
                store.move(hidden, name)

    def abort(self, messages):
        store, _ = _open(self.path)
        for m in messages:
            for hidden, _name in m.names if m else ():
                store.delete_file(hidden)
