"""The pipelines of the command line: make a box, convert, check, partition and export a surface."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import corner_ids
from ..operators import convert as conversion
from ..operators import geometry, partition, surface, topology
from ..operators.validate import validate
from ..schema import LABELLED, MOST_LABELS, PERIODIC, Mesh, MeshError
from ..sources.box import box_mesh, parse_box
from ..sources.files import read_nmsh
from ..sources.sinks import write_nmsh, write_vtu, write_zone_field
from ..store import frame, pinned


def _axis(a: str):
    return lambda c: c[a]


def _nan(a: str):
    return lambda c: F.isnan(c[a])


def unlabelled(mesh: Mesh, faces: DataFrame) -> DataFrame:
    """(pos, facet from 0) of external faces that no zone of types 1 to 5 or 7 documents."""
    at = mesh.elements.select("pos", F.col("elid").alias("e"))
    zoned = mesh.zones.where(F.col("t").between(1, 5) | (F.col("t") == LABELLED)).join(at, "e").select("pos", (F.col("f") - 1).alias("facet")).distinct()
    return faces.where("mult = 1").select("pos", "facet").join(zoned, ["pos", "facet"], "left_anti")


def report(mesh: Mesh, jacobian: bool = False) -> DataFrame:
    """(metric, value): what the checker counts. Faces and edges are counted after the periodic merge in
    which the last record of a vertex wins; `points` is the largest vertex id. NaN bounds are NaN."""
    merged = pinned(topology.replace_merge(mesh))
    faces = topology.faces(merged)
    face = faces.agg(F.count("*").alias("faces"), F.count_if(F.col("mult") == 1).alias("external"))
    edge = topology.distinct_edges(merged).agg(F.count("*").alias("edges"))
    free = unlabelled(mesh, faces).agg(F.count("*").alias("unlabelled"))
    bounds = []
    for a in "xyz":
        own, wrong = F.transform("v", _axis(a)), F.max(F.exists("v", _nan(a)))
        bounds += [F.when(wrong, float("nan")).otherwise(F.min(F.array_min(own))).alias(f"{a}_min"), F.when(wrong, float("nan")).otherwise(F.max(F.array_max(own))).alias(f"{a}_max")]
    size = mesh.elements.agg(F.count("*").alias("elements"), F.max(F.array_max(corner_ids(F.col("v")))).alias("points"), *bounds)
    t = F.col("t")
    zone = mesh.zones.agg(F.count_if(t == PERIODIC).alias("periodic"), F.count_if(t.between(1, 4)).alias("legacy"), *(F.count_if((t == LABELLED) & (F.col("p_f") == k)).alias(f"zone_{k:02d}") for k in range(1, MOST_LABELS + 1)))
    parts = [size, face, edge, free, zone]
    if jacobian:
        parts.append(geometry.jacobian_report(mesh.elements))
    out = None
    for p in parts:
        rows = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in p.columns))).alias("x")).select("x.*")
        out = rows if out is None else out.union(rows)
    return out


def check(spark: SparkSession, path: str, jacobian: bool = False, write_zone_indices: bool = False) -> tuple[DataFrame, bool]:
    """(report, whether the mesh is sound). The field of zone labels is written even if it is not."""
    mesh = validate(read_nmsh(spark, path))
    got = pinned(report(mesh, jacobian or write_zone_indices))
    bad = got.where("metric in ('unlabelled', 'n_bad') and value > 0").count()
    if write_zone_indices:
        write_zone_field(geometry.zone_field(mesh), mesh.nelv, os.path.splitext(path)[0] + "_zone_indices", (path,))
    return got, not bad


def make_box(spark: SparkSession, words: list[str]) -> str:
    """Write the box that command-line words describe; the name of its file."""
    told = parse_box(words)
    out = told.pop("out")
    write_nmsh(box_mesh(spark, told["counts"], told["bounds"], told["periodic"], told["files"], told["direct"]), out, tuple(f for f in told["files"] if f != "uniform"))
    return out


def convert(spark: SparkSession, path: str, out: str | None = None, tolerance: float | None = None) -> str:
    """Write the mesh of a re2 file. The tolerance is the argument, or the environment variable
    MESHSPARK_PERIODIC_TOL, or 1e-7."""
    if tolerance is None:
        said = os.environ.get("MESHSPARK_PERIODIC_TOL", "")
        try:
            tolerance = float(said) if said else conversion.PERIODIC_TOLERANCE
        except ValueError:
            raise MeshError(f"invalid periodic tolerance: {said}") from None
    out = out or (path[:-3] + "nmsh" if path.endswith(".re2") else path + ".nmsh")
    write_nmsh(conversion.convert(spark, path, tolerance), out, (path,))
    return out


def partitioned(mesh: Mesh, parts: int, backend: str = "spectral", stats: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(part of each place, cut and total). The graph is built from ids after the periodic merge to the
    least id; coordinate bisection without stats builds none."""
    partition.check_parts(mesh.nelv, parts)
    graph = pinned(topology.dual_graph(topology.min_merge(mesh))) if stats or backend != "geometric" else None
    if backend == "geometric":
        part = partition.coordinate_bisection(partition.centroids(mesh), mesh.nelv, parts)
    elif backend == "spectral":
        part = partition.spectral_bisection(graph, mesh.nelv, parts)
    elif backend == "metis":
        part = partition.kway(graph, mesh.nelv, parts)
    else:
        raise MeshError(f"unknown partitioner {backend!r}")
    partition.check_sizes(part, mesh.nelv, parts)
    return part, partition.weighted_cut(graph, part) if stats else None


def prepare_partition(spark: SparkSession, path: str, parts: int, out: str | None = None, backend: str = "spectral", stats: bool = True) -> tuple[str, DataFrame | None]:
    """Write the mesh in the order of its parts; (file name, cut and total)."""
    mesh = validate(read_nmsh(spark, path))
    part, cut = partitioned(mesh, parts, backend, stats)
    out = out or f"{os.path.splitext(path)[0]}_{parts}.nmsh"
    write_nmsh(partition.reorder(mesh, part), out, (path,))
    return out, cut


def export_surface(spark: SparkSession, path: str, out: str, colour: str = "zone", parts: int = 0) -> str:
    """Write the coloured surface of a mesh as a VTK file. Rendering is left to viewers of such files."""
    mesh = validate(read_nmsh(spark, path))
    points, quads, names = surface.coloured(mesh, colour, parts)
    write_vtu(points, quads, out, names, (path,))
    return out


def metrics(spark: SparkSession, rows: dict[str, float]) -> DataFrame:
    return frame(spark, [(k, float(v)) for k, v in rows.items()], "metric string, value double")
