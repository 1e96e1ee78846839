"""Spark data sources for mesh files (`nmsh`) and for the converter's input (`re2`).

Both are files of fixed-width records in sections. The driver reads the counts that frame a section;
tasks read runs of records at their byte offsets, so a scan is as parallel as the file is long. The option
`section` names the table; others are not read. Comparisons of the record's place with constants
become offsets. Files are opened by path, so they lie
where all executors see them."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..schema import CURVE, CURVES, ELEMENT, ELEMENTS, ENDIAN_TAG, RE2_ELEMENT, RE2_SIDE, ZONE, ZONES, Mesh, MeshError

CHUNK = 1 << 18


@dataclass
class Section:
    offset: int
    count: int
    dtype: np.dtype


def _read(f, kind: str, n: int, path: str, what: str) -> np.ndarray:
    got = np.fromfile(f, kind, n)
    if len(got) != n:
        raise MeshError(f"{path}: truncated file (missing {what})")
    return got


def _open(path: str):
    try:
        return open(path, "rb")
    except OSError as e:
        raise MeshError(f"cannot open {path} ({e.strerror})") from None


def frame_nmsh(path: str) -> tuple[dict[str, Section], int, int]:
    """(sections, number of elements, trailing bytes)."""
    with _open(path) as f:
        size = os.path.getsize(path)
        head = np.fromfile(f, "<i4", 2)
        if len(head) != 2:
            raise MeshError(f"{path} is not a mesh file (short header)")
        nelv, dim = map(int, head)
        if dim != 3:
            raise MeshError(f"{path}: only three-dimensional meshes are supported (dimension {dim})")
        if nelv < 1:
            raise MeshError(f"{path}: non-positive element count ({nelv})")
        out, at = {}, 8
        for name, dtype in (("elements", ELEMENT), ("zones", ZONE), ("curves", CURVE)):
            n = nelv
            if name != "elements":
                f.seek(at)
                n = int(_read(f, "<i4", 1, path, f"count of {name}")[0])
                at += 4
                if n < 0:
                    raise MeshError(f"{path}: negative count of {name} ({n})")
            if at + n * dtype.itemsize > size:
                raise MeshError(f"{path}: truncated section of {name} ({max(0, size - at) // dtype.itemsize} of {n} records)")
            out[name] = Section(at, n, dtype)
            at += n * dtype.itemsize
    return out, nelv, size - at


def frame_re2(path: str) -> tuple[dict[str, Section], int, str]:
    """(sections, number of elements, version). Element records beyond the three-dimensional ones and empty
    meshes are refused."""
    with _open(path) as f:
        size, head = os.path.getsize(path), f.read(80)
        if len(head) != 80:
            raise MeshError(f"{path} is not a re2 file (short header)")
        version = head[:5].decode("latin-1")
        cuts = {"#v004": (5, 21, 24, 40)}.get(version, (5, 14, 17, 26))
        if version not in ("#v001", "#v002", "#v003", "#v004"):
            raise MeshError(f"unknown re2 version {version!r}")
        try:
            nel, dim, nelv = (int(head[a:b]) for a, b in zip(cuts, cuts[1:]))
        except ValueError:
            raise MeshError(f"cannot parse the re2 header of {path}") from None
        tag = np.fromfile(f, "<f4", 1)
        if len(tag) != 1 or abs(float(tag[0]) - ENDIAN_TAG) > 1e-4:
            raise MeshError(f"{path}: byte-swapped or corrupt re2 (endian tag)")
        if dim != 3:
            raise MeshError(f"{path}: only three-dimensional meshes are supported (dimension {dim})")
        if nel != nelv or nelv < 1:
            raise MeshError(f"{path}: {nel} element records for {nelv} elements")
        w = 4 if version == "#v001" else 8
        at, out = 84, {}
        for name, dtype in (("elements", RE2_ELEMENT[w]), ("curves", RE2_SIDE[w]), ("bcs", RE2_SIDE[w])):
            n = nelv
            if name != "elements":
                f.seek(at)
                n = int(_read(f, "<f8" if w == 8 else "<i4", 1, path, f"count of {name}")[0])
                at += w
                if n < 0:
                    raise MeshError(f"{path}: negative count of {name}")
            if at + n * dtype.itemsize > size:
                raise MeshError(f"truncated or corrupt re2 file {path} (section of {name})")
            out[name] = Section(at, n, dtype)
            at += n * dtype.itemsize
    return out, nelv, version


@dataclass
class Run(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    place = "rec"

    def __init__(self, path: str, section: Section, chunk: int, batch, name: str):
        self.path, self.section, self.chunk, self.batch, self.name = path, section, chunk, batch, name
        self.low, self.high = 0, section.count
        self.place = "pos" if name == "elements" else "rec"

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.place,):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            yield f  # Spark checks them again

    def partitions(self):
        return [Run(a, min(self.chunk, self.high - a)) for a in range(self.low, self.high, self.chunk)] or [Run(0, 0)]

    def read(self, run: Run):
        if run.count:
            got = np.fromfile(self.path, self.section.dtype, run.count, offset=self.section.offset + run.first * self.section.dtype.itemsize)
            if len(got) != run.count:
                raise MeshError(f"{self.path}: truncated section of {self.name}")
            yield self.batch(run.first, got)


def _lists(values: pa.Array, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), values)


def _flat(x: np.ndarray, kind: str | None = None) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, kind).ravel())


def element_batch(first: int, r: np.ndarray) -> pa.RecordBatch:
    v = pa.StructArray.from_arrays([_flat(r["v"]["idx"], "i4"), *(_flat(r["v"][a], "f8") for a in "xyz")], ["idx", "x", "y", "z"])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(r))), _flat(r["elid"], "i4"), _lists(v, 8)], ["pos", "elid", "v"])


def zone_batch(first: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(r))), *(_flat(r[c], "i4") for c in ("e", "f", "p_e", "p_f")), _lists(_flat(r["g"], "i4"), 4), _flat(r["t"], "i4")], ["rec", "e", "f", "p_e", "p_f", "g", "t"])


def curve_batch(first: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(r))), _flat(r["e"], "i4"), _lists(_lists(_flat(r["data"], "f8"), 5), 12), _lists(_flat(r["type"], "i4"), 12)], ["rec", "e", "data", "type"])


def re2_element_batch(first: int, r: np.ndarray) -> pa.RecordBatch:
    """Corners with their coordinates, and the raw bits of these as longs: 0.0 and -0.0 differ."""
    xyz = [np.ascontiguousarray(r[a], "f8") for a in "xyz"]
    v = pa.StructArray.from_arrays([pa.array(x.ravel()) for x in xyz] + [pa.array(x.view("i8").ravel()) for x in xyz], ["x", "y", "z", "bx", "by", "bz"])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(r))), _lists(v, 8)], ["pos", "v"])


def side_batch(first: int, r: np.ndarray) -> pa.RecordBatch:
    raw = [bytes(x).ljust(r.dtype["t"].itemsize, b"\0") for x in r["t"]]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(r))), _flat(r["e"].astype("i8")), _flat(r["side"].astype("i8")), _lists(_flat(r["d"], "f8"), 5), pa.array(raw, pa.binary())], ["rec", "e", "side", "d", "t"])


class NmshSource(DataSource):
    """spark.read.format("nmsh").option("section", "elements" | "zones" | "curves").load(path)"""

    @classmethod
    def name(cls):
        return "nmsh"

    def schema(self):
        return {"elements": ELEMENTS, "zones": ZONES, "curves": CURVES}[self.options.get("section", "elements")]

    def reader(self, schema):
        name, path = self.options.get("section", "elements"), self.options["path"]
        batch = {"elements": element_batch, "zones": zone_batch, "curves": curve_batch}[name]
        return _Reader(path, frame_nmsh(path)[0][name], int(self.options.get("chunk", CHUNK)), batch, name)


class Re2Source(DataSource):
    """spark.read.format("re2").option("section", "elements" | "curves" | "bcs").load(path)"""

    @classmethod
    def name(cls):
        return "re2"

    def schema(self):
        if self.options.get("section", "elements") == "elements":
            return "pos long, v array<struct<x:double,y:double,z:double,bx:long,by:long,bz:long>>"
        return "rec long, e long, side long, d array<double>, t binary"

    def reader(self, schema):
        name, path = self.options.get("section", "elements"), self.options["path"]
        return _Reader(path, frame_re2(path)[0][name], int(self.options.get("chunk", CHUNK)), re2_element_batch if name == "elements" else side_batch, name)


def register(spark: SparkSession) -> None:
    """Make both sources known; their readers take filters, which Spark asks to be switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NmshSource)
    spark.dataSource.register(Re2Source)


def read_nmsh(spark: SparkSession, path: str, chunk: int = CHUNK) -> Mesh:
    """A mesh file as tables; truncated and foreign files are refused before any scan."""
    register(spark)
    _, nelv, trailing = frame_nmsh(path)
    tables = (spark.read.format("nmsh").option("section", s).option("chunk", chunk).load(path) for s in ("elements", "zones", "curves"))
    return Mesh(nelv, *tables, trailing)


def read_grid_lines(path: str, n: int) -> list[float]:
    """n + 1 coordinates of a text file: its first line is a header if it has more than one; commas, blanks
    and line ends separate; numbers beyond those needed are ignored. As many as one grid axis, so the
    driver reads them."""
    with _open(path) as f:
        lines = f.read().decode().splitlines()
    words = " ".join(lines[1:] if len(lines) > 1 else lines).replace(",", " ").split()
    if len(words) < n + 1:
        raise MeshError(f"expected {n + 1} grid values in {path}, found {len(words)}")
    try:
        return [float(w) for w in words[: n + 1]]
    except ValueError:
        raise MeshError(f"cannot parse the grid values in {path}") from None
