"""Structured box meshes in closed form: every record is a function of its number."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CURVES, FACE_SLOTS, LABELLED, MOST_IDS, OPPOSITE, PERIODIC, SLOT_CORNER, Mesh, MeshError
from .files import read_grid_lines

# fixed values: how a command line spells yes and no
YES, NO = {".true.", "true", "t"}, {".false.", "false", "f"}


def grid_lines(n: int, low: float, high: float, path: str = "uniform", direct: bool = False) -> list[float]:
    """The n + 1 coordinates of an axis. By default the lengths of the cells are added up from low, one
    by one, as floating point does it; direct takes the closed form, or a file's numbers as they are. A file
    replaces high, and with direct low as well."""
    given = None if path == "uniform" else read_grid_lines(path, n)
    if direct:
        return given if given is not None else [low + ((high - low) / float(n)) * k for k in range(n + 1)]
    lengths = [b - a for a, b in itertools.pairwise(given)] if given is not None else [(high - low) / float(n)] * n
    return list(itertools.accumulate(lengths, initial=low))


def parse_box(words: list[str]) -> dict:
    """The arguments of box_mesh, and `out`, from a command line: six bounds, three counts, then up to
    three flags of periodicity, three grid files, a file name, and anywhere --direct."""
    rest = [w for w in words if w != "--direct"]
    if len(rest) not in (9, 10, 12, 13, 15, 16):
        raise MeshError(f"invalid number of box arguments ({len(rest)}); valid: 9, 12 or 15, and a file name")
    try:
        bounds, counts = [float(w) for w in rest[:6]], [int(w) for w in rest[6:9]]
    except ValueError as e:
        raise MeshError(f"cannot parse the box arguments ({e})") from None
    flags = [w.lower() for w in rest[9:12]] if len(rest) >= 12 else ["f"] * 3
    if bad := [w for w in flags if w not in YES | NO]:
        raise MeshError(f"cannot parse {bad[0]!r} as a logical")
    return {"bounds": tuple(bounds), "counts": tuple(counts), "periodic": tuple(w in YES for w in flags), "files": tuple(rest[12:15]) if len(rest) >= 15 else ("uniform",) * 3, "direct": len(rest) < len(words), "out": rest[-1] if len(rest) in (10, 13, 16) else "box.nmsh"}


def _node(counts, at: list[Column]) -> Column:
    nx, ny, _ = counts
    return 1 + at[0] + at[1] * (nx + 1) + at[2] * ((nx + 1) * (ny + 1))


def box_elements(spark: SparkSession, counts: tuple[int, int, int], lines: list[list[float]] | None = None, partitions: int | None = None) -> DataFrame:
    """(pos, elid, v) of a box; lines are the coordinates of its axes, by default 0, 1, 2, ..."""
    nx, ny, nz = counts
    if min(counts) < 1:
        raise MeshError(f"all counts must be at least 1 (got {nx} {ny} {nz})")
    if max(nx * ny * nz, (nx + 1) * (ny + 1) * (nz + 1)) > MOST_IDS:
        raise MeshError("mesh too large: elements and points must have 32-bit ids")
    p = F.col("pos")
    cell = [p % nx, F.floor(p / nx) % ny, F.floor(p / (nx * ny))]

    def coordinate(axis: int, at: Column) -> Column:
        if lines is None:
            return at.cast("double")
        return F.element_at(F.col(f"line{axis}"), (at + 1).cast("int"))

    corners = []
    for corner in SLOT_CORNER:
        at = [cell[k] + corner[k] for k in range(3)]
        corners.append(F.struct(_node(counts, at).cast("int").alias("idx"), *(coordinate(k, at[k]).alias(a) for k, a in enumerate("xyz"))))
    rows = spark.range(0, nx * ny * nz, 1, *([partitions] if partitions else [])).withColumnRenamed("id", "pos")
    if lines is not None:  # three short arrays, one row; as long as one axis each
        held = spark.createDataFrame([tuple(lines)], "line0 array<double>, line1 array<double>, line2 array<double>")
        rows = rows.join(F.broadcast(held))
    return rows.select("pos", (p + 1).cast("int").alias("elid"), F.array(*corners).alias("v"))


def box_zones(spark: SparkSession, counts: tuple[int, int, int], periodic: tuple[bool, bool, bool] = (False,) * 3) -> DataFrame:
    """The zones of a box: periodic facets of each periodic axis, low side then high side, then the others
    labelled by their number. On a facet the earlier of its two axes is the outer loop."""
    faces = [f for d in range(3) if periodic[d] for f in (2 * d + 1, 2 * d + 2)] + [f for f in range(1, 7) if not periodic[(f - 1) // 2]]
    parts, before = [], 0
    for f in faces:
        axis, high = (f - 1) // 2, (f - 1) % 2
        outer, inner = (d for d in range(3) if d != axis)
        n = counts[outer] * counts[inner]
        k = F.col("id")
        cell: list[Column] = [None, None, None]
        cell[axis] = F.lit(counts[axis] - 1 if high else 0)
        cell[outer], cell[inner] = F.floor(k / counts[inner]), k % counts[inner]
        facing = list(cell)
        facing[axis] = F.lit(0 if high else counts[axis] - 1)

        def element(at):
            return (1 + at[0] + at[1] * counts[0] + at[2] * (counts[0] * counts[1])).cast("int")

        def merged(slot):
            at = [cell[d] + SLOT_CORNER[slot][d] for d in range(3)]
            return _node(counts, [F.when(x == counts[d], 0).otherwise(x) if periodic[d] else x for d, x in enumerate(at)]).cast("int")

        if periodic[axis]:
            own = (element(facing), F.lit(OPPOSITE[f - 1]), F.array(*(merged(s) for s in FACE_SLOTS[f - 1])), F.lit(PERIODIC))
        else:
            own = (F.lit(0), F.lit(f), F.array(*[F.lit(0)] * 4), F.lit(LABELLED))
        parts.append(spark.range(n).select((k + before).alias("rec"), element(cell).alias("e"), F.lit(f).alias("f"), *(c.alias(a) for c, a in zip(own, ("p_e", "p_f", "g", "t")))))
        before += n
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def box_mesh(spark: SparkSession, counts: tuple[int, int, int], bounds: tuple[float, ...] | None = None, periodic: tuple[bool, bool, bool] = (False,) * 3, files: tuple[str, str, str] = ("uniform",) * 3, direct: bool = False) -> Mesh:
    """A box of unit cells, or within bounds (x0, x1, y0, y1, z0, z1)."""
    lines = None
    if min(counts) >= 1 and (bounds is not None or any(f != "uniform" for f in files)):
        bounds = bounds or tuple(float(x) for n in counts for x in (0, n))
        lines = [grid_lines(n, bounds[2 * k], bounds[2 * k + 1], files[k], direct) for k, n in enumerate(counts)]
    elements = box_elements(spark, counts, lines)
    return Mesh(counts[0] * counts[1] * counts[2], elements, box_zones(spark, counts, periodic), spark.createDataFrame([], CURVES))
