"""Writers of mesh, field and surface files.

Records have fixed widths, so every task writes its rows at their own offsets of one temporary file, in any
order; a task that runs twice writes the same bytes again. The driver writes the frame and renames the file
when all tasks are done. No writer replaces one of its inputs."""

from __future__ import annotations

import base64
import contextlib
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CURVE, ELEMENT, ENDIAN_TAG, ZONE, Mesh, MeshError


@contextlib.contextmanager
def whole_file(path: str, inputs: tuple[str, ...] = ()):
    """The name of a temporary file beside path, which takes path's place if all goes well and else goes."""
    real = os.path.realpath(path)
    if any(os.path.exists(i) and os.path.realpath(i) == real for i in inputs):
        raise MeshError(f"output {path} would overwrite an input file")
    temp = f"{real}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temp, "wb"):
            pass
        yield temp
        os.replace(temp, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temp)


def _list(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _element_records(b: pa.RecordBatch) -> np.ndarray:
    out, v = np.zeros(b.num_rows, ELEMENT), b.column("v").flatten()
    out["elid"] = b.column("elid").to_numpy()
    for a in ("idx", "x", "y", "z"):
        out["v"][a] = v.field(a).to_numpy().reshape(-1, 8)
    return out


def _zone_records(b: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(b.num_rows, ZONE)
    for c in ("e", "f", "p_e", "p_f", "t"):
        out[c] = b.column(c).to_numpy()
    out["g"] = _list(b.column("g")).reshape(-1, 4)
    return out


def _curve_records(b: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(b.num_rows, CURVE)
    out["e"] = b.column("e").to_numpy()
    out["data"] = b.column("data").flatten().flatten().to_numpy().reshape(-1, 12, 5)
    out["type"] = _list(b.column("type")).reshape(-1, 12)
    return out


def _place(df: DataFrame, at: str, n: int, temp: str, blocks) -> None:
    """Write each row's records. blocks(batch) gives (offset of the block, array of a record per row);
    the column `at` is the place of a row in every block."""

    def run(batches):
        done = 0
        for b in batches:
            if b.num_rows:
                where = b.column(at).to_numpy()
                if where.min() < 0 or where.max() >= n:
                    raise MeshError(f"record place out of [0,{n})")
                for offset, records in blocks(b):
                    whole = np.memmap(temp, records.dtype, "r+", offset, (n, *records.shape[1:]))
                    whole[where] = records
                    whole.flush()
                    del whole
                done += b.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    total = df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if total != n:
        raise MeshError(f"{total} records for {n} places")


def write_nmsh(mesh: Mesh, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Write a mesh; pos and rec must be the places 0, 1, 2, ... of each table."""
    nz, nc = mesh.zones.count(), mesh.curves.count()
    zones_at = 8 + mesh.nelv * ELEMENT.itemsize
    curves_at = zones_at + 4 + nz * ZONE.itemsize
    with whole_file(path, inputs) as temp:
        with open(temp, "r+b") as f:
            f.truncate(curves_at + 4 + nc * CURVE.itemsize)
            for at, numbers in ((0, (mesh.nelv, 3)), (zones_at, (nz,)), (curves_at, (nc,))):
                f.seek(at)
                f.write(np.array(numbers, "<i4").tobytes())
        _place(mesh.elements.select("pos", "elid", "v"), "pos", mesh.nelv, temp, lambda b: [(8, _element_records(b))])
        if nz:
            _place(mesh.zones.select("rec", "e", "f", "p_e", "p_f", "g", "t"), "rec", nz, temp, lambda b: [(zones_at + 4, _zone_records(b))])
        if nc:
            _place(mesh.curves.select("rec", "e", "data", "type"), "rec", nc, temp, lambda b: [(curves_at + 4, _curve_records(b))])


def write_zone_field(elements: DataFrame, nelv: int, base: str, inputs: tuple[str, ...] = ()) -> None:
    """Write base.fld and base.nek5000 from (pos, elid, nodes, scalar): nodes are 27 points of x, y, z in
    order t, s, r with r inner, scalar has a value for each. Geometry, values and their bounds are single
    precision; ids stand in record order."""
    ids, xyz = 136, 136 + 4 * nelv
    scal = xyz + 4 * 81 * nelv
    box = scal + 4 * 27 * nelv
    ends = box + 4 * 6 * nelv
    head = f"#std {4:1d} {3:2d} {3:2d} {3:2d} {nelv:10d} {nelv:10d} {0.0:20.13E} {1:9d} {1:6d} {1:6d} {'XS01':<10s}".ljust(132)

    def blocks(b: pa.RecordBatch):
        node = b.column("nodes").flatten()
        g = np.stack([node.field(a).to_numpy().reshape(-1, 27) for a in "xyz"], 1).astype("<f4")
        s = _list(b.column("scalar")).reshape(-1, 27).astype("<f4")
        bounds = np.stack([g.min(2), g.max(2)], 2).reshape(-1, 6)
        return [(ids, b.column("elid").to_numpy().astype("<i4")), (xyz, g), (scal, s), (box, bounds), (ends, np.stack([s.min(1), s.max(1)], 1))]

    with whole_file(base + ".fld", inputs) as temp:
        with open(temp, "r+b") as f:
            f.truncate(ends + 8 * nelv)
            f.write(head.encode() + np.array([ENDIAN_TAG], "<f4").tobytes())
        _place(elements.select("pos", "elid", "nodes", "scalar"), "pos", nelv, temp, blocks)
    with whole_file(base + ".nek5000", inputs) as temp, open(temp, "wb") as f:
        f.write(f"filetemplate: {os.path.basename(base)}.fld\nfirsttimestep: 1\nnumtimesteps: 1\n".encode())


def write_vtu(points: DataFrame, quads: DataFrame, path: str, data: tuple[str, ...] = (), inputs: tuple[str, ...] = (), most: int = 20_000_000) -> None:
    """Write a surface as a VTK grid of quads: points (point, x, y, z), quads (quad, a, b, c, d and data).
    The surface of a mesh is small beside it; one of more than `most` quads is refused, not gathered."""
    n = quads.count()
    if n > most:
        raise MeshError(f"{n} quads are too many for one file (at most {most})")
    p = points.orderBy("point").select("x", "y", "z").toArrow()
    q = quads.orderBy("quad").select("a", "b", "c", "d", *data).toArrow()

    def block(x: np.ndarray) -> str:
        raw = x.tobytes()
        return base64.b64encode(struct.pack("<Q", len(raw)) + raw).decode()

    def array(x: np.ndarray, kind: str, **attributes) -> str:
        return f'<DataArray type="{kind}"' + "".join(f' {k}="{v}"' for k, v in attributes.items()) + f' format="binary">\n{block(x)}\n</DataArray>'

    xyz = np.stack([p[a].to_numpy() for a in "xyz"], 1).astype("<f4") if p.num_rows else np.zeros((0, 3), "<f4")
    conn = np.stack([q[c].to_numpy() for c in "abcd"], 1).astype("<i8") if n else np.zeros((0, 4), "<i8")
    cells = []
    for name in data:
        x = q[name].to_numpy()
        whole = np.issubdtype(x.dtype, np.integer)
        cells.append(array(x.astype("<i4" if whole else "<f4"), "Int32" if whole else "Float32", Name=name))
    text = [
        '<?xml version="1.0"?>',
        '<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian" header_type="UInt64">',
        f'<UnstructuredGrid><Piece NumberOfPoints="{len(xyz)}" NumberOfCells="{n}">',
        "<Points>" + array(xyz, "Float32", NumberOfComponents=3) + "</Points>",
        "<Cells>",
        array(conn, "Int64", Name="connectivity"),
        array(4 * np.arange(1, n + 1, dtype="<i8"), "Int64", Name="offsets"),
        array(np.full(n, 9, np.uint8), "UInt8", Name="types"),
        "</Cells>",
        "<CellData>",
        *cells,
        "</CellData>",
        "</Piece></UnstructuredGrid></VTKFile>",
    ]
    with whole_file(path, inputs) as temp, open(temp, "w") as f:
        f.write("\n".join(text) + "\n")
