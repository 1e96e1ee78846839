"""Queries that write generated files and read them back, or run over meshes with planted faults, and their SQL,
which knows the files by the formulas that they are generated by."""

from __future__ import annotations

import base64
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bc_type
from ..operators import convert, geometry, partition, surface, topology, validate
from ..schema import ENDIAN_TAG, RE2_ELEMENT, RE2_SIDE, SLOT_CORNER
from ..sources.box import box_mesh
from ..sources.files import read_nmsh, register
from ..sources.sinks import write_nmsh, write_vtu, write_zone_field
from ..store import frame, mounted_folder, pinned
from ..streaming.chunks import iter_elements
from . import tools
from .mesh_queries import _zones_sql

NX, NY, NZ = 6, 4, 3
N = NX * NY * NZ

# the converter's input: an x-periodic box whose other sides have types; faces in the converter's numbering
_TYPES = {1: b"W", 2: b"P", 3: b" v", 4: b"P", 5: b"MSH", 6: b"SYM"}


def _write_re2(path: str, version: str) -> None:
    wide = 4 if version == "#v001" else 8
    e = np.arange(N)
    x, y, z = e % NX, e // NX % NY, e // (NX * NY)
    elements = np.zeros(N, RE2_ELEMENT[wide])
    for k, (dx, dy, dz) in enumerate(SLOT_CORNER):
        elements["x"][:, k], elements["y"][:, k], elements["z"][:, k] = x + dx, y + dy, z + dz
    on = {1: y == 0, 2: x == NX - 1, 3: y == NY - 1, 4: x == 0, 5: z == 0, 6: z == NZ - 1}
    bcs = np.zeros(6 * N, RE2_SIDE[wide])
    for face in range(1, 7):
        own = bcs[face - 1 :: 6]
        own["e"], own["side"], own["t"] = e + 1, face, np.where(on[face], _TYPES[face], b"E")
        if face in (2, 4):
            own["d"][on[face], 0], own["d"][on[face], 1] = (e + 1 + (NX - 1) * (1 if face == 4 else -1))[on[face]], 6 - face
        if face == 5:
            own["d"][on[face], 4] = 2
    curved = np.repeat(e[e % 5 == 2], 3)
    curves = np.zeros(len(curved), RE2_SIDE[wide])
    turn = np.arange(len(curved)) % 3  # two records of one edge, the later of which wins, and one of another
    curves["e"], curves["side"], curves["t"] = curved + 1, np.where(turn < 2, 3, 12), np.where(turn == 0, b"C", b"m")
    curves["d"][:, 0] = curved * 10 + turn
    count = "<f8" if wide == 8 else "<i4"
    head = version + (f"{N:16d}{3:3d}{N:16d}" if version == "#v004" else f"{N:9d}{3:3d}{N:9d}")
    with open(path, "wb") as f:
        f.write(head.ljust(80).encode() + np.array([ENDIAN_TAG], "<f4").tobytes() + elements.tobytes())
        for rows in (curves, bcs):
            f.write(np.array([len(rows)], count).tobytes() + rows.tobytes())


def _in_folder(run):
    """A query over a folder of its own; its result is pinned before the folder goes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory(dir=mounted_folder(spark)) as d:
            return pinned(run(spark, d))

    query.__name__ = run.__name__
    return query


def _section(spark: SparkSession, d: str, version: str, section: str) -> DataFrame:
    path = os.path.join(d, f"{version[1:]}.re2")
    if not os.path.exists(path):
        _write_re2(path, version)
    register(spark)
    return spark.read.format("re2").option("section", section).option("chunk", 50).load(path)


@_in_folder
def input_elements(spark, d):
    out = None
    for version in ("#v001", "#v002", "#v004"):
        rows = _section(spark, d, version, "elements").select(F.lit(version).alias("version"), "pos", F.posexplode("v").alias("slot", "c"))
        rows = rows.select("version", "pos", F.col("slot").cast("long").alias("slot"), *(F.col(f"c.{a}").alias(a) for a in "xyz"))
        out = rows if out is None else out.union(rows)
    return out


@_in_folder
def input_boundaries(spark, d):
    out = None
    for version in ("#v001", "#v003", "#v004"):
        rows = _section(spark, d, version, "bcs").select(F.lit(version).alias("version"), "rec", F.col("e").cast("long").alias("e"), F.col("side").cast("long").alias("side"), bc_type(F.col("t")).alias("type"), *(F.col("d")[k].cast("double").alias(f"d{k}") for k in (0, 1, 4)))
        out = rows if out is None else out.union(rows)
    return out


def _converted(spark, d):
    path = os.path.join(d, "a.re2")
    _write_re2(path, "#v002")
    return convert.convert(spark, path, chunk=50)


@_in_folder
def convert_points(spark, d):
    return topology.corners(topology.cells(_converted(spark, d))).select("pos", F.col("slot").cast("long").alias("slot"), F.col("vid").cast("long").alias("vid"))


@_in_folder
def convert_zones(spark, d):
    """Through the file that the converter writes."""
    path = os.path.join(d, "a.re2")
    _write_re2(path, "#v002")
    z = read_nmsh(spark, tools.convert(spark, path)).zones
    return z.select(*(F.col(c).cast("long").alias(c) for c in ("rec", "e", "f", "p_e", "p_f", "t")), *(F.col("g")[k].cast("long").alias(f"g{k}") for k in range(4)))


@_in_folder
def convert_curves(spark, d):
    c = _converted(spark, d).curves.select("rec", F.col("e").cast("long").alias("e"), "data", F.posexplode("type").alias("k", "type"))
    return c.where("type > 0").select("rec", "e", (F.col("k") + 1).cast("long").alias("edge"), F.col("type").cast("long").alias("type"), F.col("data")[F.col("k")][0].alias("value"))


@_in_folder
def field_file(spark, d):
    """The field of zone labels, read back from its bytes."""
    base = os.path.join(d, "zones")
    write_zone_field(geometry.zone_field(box_mesh(spark, (4, 3, 2), periodic=(True, False, False))), 24, base)
    raw = open(base + ".fld", "rb").read()
    ids = np.frombuffer(raw, "<i4", 24, 136)
    xyz, scalar = np.frombuffer(raw, "<f4", 24 * 81, 232).reshape(24, 3, 27), np.frombuffer(raw, "<f4", 24 * 27, 232 + 4 * 24 * 81).reshape(24, 27)
    ends = np.frombuffer(raw, "<f4", 24 * 2, len(raw) - 8 * 24).reshape(24, 2)
    rows = [(int(ids[p]), k, *(float(v) for v in xyz[p, :, k]), int(scalar[p, k]), int(ends[p, 1])) for p in range(24) for k in range(27)]
    return frame(spark, rows, "id long, node long, x double, y double, z double, label long, most long")


@_in_folder
def surface_file(spark, d):
    """The surface of a box as a VTK file, read back from its blocks."""
    path = os.path.join(d, "skin.vtu")
    write_vtu(*surface.surface(box_mesh(spark, (4, 3, 2))), path)
    text = open(path).read()

    def block(name: str, kind: str) -> np.ndarray:
        head, _, rest = text.partition(f'Name="{name}"')
        return np.frombuffer(base64.b64decode(rest.partition(">")[2].partition("<")[0].strip())[8:], kind)

    quads = block("connectivity", "<i8").reshape(-1, 4)
    at = text.index("<Points>")
    points = np.frombuffer(base64.b64decode(text[text.index(">", text.index("<DataArray", at)) + 1 :].partition("<")[0].strip())[8:], "<f4").reshape(-1, 3)
    rows = [(q, k, *(float(x) for x in points[p])) for q, own in enumerate(quads.tolist()) for k, p in enumerate(own)]
    return frame(spark, rows, "quad long, k long, x double, y double, z double")


@_in_folder
def chunked_scan(spark, d):
    path = os.path.join(d, "box.nmsh")
    write_nmsh(box_mesh(spark, (NX, NY, NZ)), path)
    return frame(spark, [(first, *map(int, e.agg(F.count("*"), F.sum("elid")).first())) for first, e in iter_elements(spark, path, 17)], "first long, n long, ids long")


def _crossed(spark):
    """A box whose periodic records give vertices several new ids, out of order."""
    m = box_mesh(spark, (NX, NY, NZ), periodic=(True, False, False))
    g = F.array(*(F.pmod(F.col("rec") * 7 + 13 * k, F.lit((NX + 1) * (NY + 1) * (NZ + 1))).cast("int") + 1 for k in range(4)))
    return m.with_(zones=m.zones.withColumn("g", F.when(F.col("t") == 5, g).otherwise(F.col("g"))))


def merges_apart(spark, sf_dir):
    """Both merges over records in which the least and the last id of a vertex differ."""
    low, last = (topology.corners(f(_crossed(spark))).select("pos", F.col("slot").cast("long").alias("slot"), F.col("vid").cast("long").alias(n)) for f, n in ((topology.min_merge, "low"), (topology.replace_merge, "last")))
    return low.join(last, ["pos", "slot"])


def _faulty(spark):
    """A box with a fault of each kind, at places that follow from the record numbers."""
    m = box_mesh(spark, (NX, NY, NZ), periodic=(True, False, False))
    rec, z = F.col("rec"), m.zones
    for c, v, at in (("t", 9, 10), ("f", 7, 11), ("e", N + 1, 12), ("p_e", 0, 3), ("p_f", 25, 31)):
        z = z.withColumn(c, F.when(rec % 40 == at, v).otherwise(F.col(c)).cast("int"))
    e = m.elements.withColumn("elid", F.when(F.col("pos") % 30 == 4, F.col("elid") - 1).when(F.col("pos") == 50, N + 5).otherwise(F.col("elid")).cast("int"))
    kind = F.array(*(F.when((F.lit(k) == 2) & (F.col("id") % 4 == 1), 5).otherwise(3).cast("int") for k in range(12)))
    c = spark.range(9).select(F.col("id").alias("rec"), F.when(F.col("id") == 6, 0).otherwise(F.col("id") + 1).cast("int").alias("e"), F.array_repeat(F.array_repeat(F.lit(0.0), 5), 12).alias("data"), kind.alias("type"))
    return m.with_(zones=z, elements=e, curves=c)


def mesh_violations(spark, sf_dir):
    return validate.violations(_faulty(spark))


def faulty_report(spark, sf_dir):
    """The report over a box with inverted elements and undocumented facets; two labels for some facets."""
    m = box_mesh(spark, (NX, NY, NZ), periodic=(True, False, False))
    v = F.when(F.col("pos") % 10 == 7, F.transform("v", lambda c: F.struct(c["idx"].alias("idx"), c["x"].alias("x"), c["y"].alias("y"), (2 * F.floor(F.col("pos") / (NX * NY)) + 1 - c["z"]).alias("z")))).otherwise(F.col("v"))
    m = m.with_(elements=m.elements.withColumn("v", v), zones=m.zones.where("t = 5 or rec % 3 > 0"))
    return tools.report(m, jacobian=True).where("metric in ('unlabelled', 'n_bad', 'first_bad', 'min_jac', 'external')")


def last_labels(spark, sf_dir):
    """Of several labels of one facet the last record's counts."""
    m = box_mesh(spark, (NX, NY, NZ))
    again = m.zones.where("rec % 4 = 1").select((F.col("rec") + 1000).alias("rec"), "e", "f", "p_e", (F.col("p_f") + 10).cast("int").alias("p_f"), "g", "t")
    rows = geometry.facet_labels(m.with_(zones=m.zones.union(again)))
    return rows.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("facets"))


def spectral_parts(spark, sf_dir):
    """Spectral parts of a box beyond the dense solver's size: sizes, whether each is in one piece, and whether the cut is
    at most a quarter above that of coordinate bisection."""
    m = box_mesh(spark, (24, 18, 12))
    graph = pinned(topology.dual_graph(topology.cells(m)))
    part = pinned(partition.spectral_bisection(graph, m.nelv, 7))
    both = partition.Graph.read(graph, m.nelv, "the test")
    side = np.array([r.part for r in part.orderBy("pos").collect()])
    label = both.components(side)
    cut = [partition.weighted_cut(graph, p).first().cut for p in (part, partition.coordinate_bisection(partition.centroids(m), m.nelv, 7))]
    return frame(spark, [(k, int((side == k).sum()), len(np.unique(label[side == k])), bool(cut[0] <= 1.25 * cut[1])) for k in range(7)], "part long, size long, pieces long, cut_is_low boolean")


def repaired_parts(spark, sf_dir):
    """One part of all elements of a row, split by ties alone: the element with the strongest ties goes first."""
    m = box_mesh(spark, (30, 1, 1))
    part = m.elements.select("pos", F.when(F.col("pos") < 22, 0).otherwise(1).cast("int").alias("part"))
    got = partition.repair_sizes(topology.dual_graph(topology.cells(m)), part, m.nelv, 2)
    return got.select("pos", F.col("part").cast("long").alias("part"))


QUERIES = {f.__name__: f for f in (input_elements, input_boundaries, convert_points, convert_zones, convert_curves, field_file, surface_file, chunked_scan, merges_apart, mesh_violations, faulty_report, last_labels, spectral_parts, repaired_parts)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    cells = f"c AS (SELECT p AS pos, p % {NX} AS x, p // {NX} % {NY} AS y, p // {NX * NY} AS z FROM range({N}) r(p))"
    slots = "s(slot, cx, cy, cz) AS (VALUES " + ",".join(f"({k},{x},{y},{z})" for k, (x, y, z) in enumerate(SLOT_CORNER)) + ")"
    # ids in the order in which the corners of the file first show a point
    points = f"{cells}, {slots}, k AS (SELECT pos, slot, x + cx AS px, y + cy AS py, z + cz AS pz FROM c, s), v AS (SELECT px, py, pz, row_number() OVER (ORDER BY min(pos * 8 + slot)) AS vid FROM k GROUP BY ALL)"
    face = "f(face, facet, axis, side, kind) AS (VALUES (1,3,1,0,'W'),(2,2,0,1,'P'),(3,4,1,1,'v'),(4,1,0,0,'P'),(5,5,2,0,'MSH'),(6,6,2,1,'SYM'))"
    on = f"((axis = 0 AND x = side * {NX - 1}) OR (axis = 1 AND y = side * {NY - 1}) OR (axis = 2 AND z = side * {NZ - 1}))"
    b = f"b AS (SELECT pos * 6 + face - 1 AS rec, pos + 1 AS e, x, y, z, face, facet, CASE WHEN {on} THEN kind ELSE 'E' END AS type, {on} AND kind = 'P' AS paired, side FROM c, f)"
    partner = f"e + {NX - 1} * (1 - 2 * side)"
    turns = ((0, 0), (0, 1), (1, 1), (1, 0))  # y and z of the corners of both x facets
    pid = ", ".join(f"(SELECT min(vid) FROM v WHERE px IN (0, {NX}) AND py = y + {dy} AND pz = z + {dz}) AS g{k}" for k, (dy, dz) in enumerate(turns))
    zero = ", ".join(f"0 AS g{k}" for k in range(4))
    label = "CASE type WHEN 'MSH' THEN 2 WHEN 'W' THEN 3 WHEN 'v' THEN 4 ELSE 5 END"
    zones = f"WITH {points}, {face}, {b}, z AS (SELECT 0 AS own, 0 AS late, rec, e, facet AS f, {partner} AS p_e, 3 - facet AS p_f, 5 AS t, {pid} FROM b WHERE paired UNION ALL SELECT {label}, type <> 'MSH', rec, e, facet, 0, {label}, 7, {zero} FROM b WHERE type IN ('MSH', 'W', 'v', 'SYM')) SELECT row_number() OVER (ORDER BY own, late, rec) - 1 AS rec, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("e", "f", "p_e", "p_f", "t", "g0", "g1", "g2", "g3")) + " FROM z"
    d0 = f"CAST(CASE WHEN paired THEN {partner} ELSE 0 END AS DOUBLE) AS d0, CAST(CASE WHEN paired THEN 6 - face ELSE 0 END AS DOUBLE) AS d1, CAST(CASE WHEN type = 'MSH' THEN 2 ELSE 0 END AS DOUBLE) AS d4"
    versions = lambda names: "(VALUES " + ",".join(f"('{v}')" for v in names) + ") n(version)"
    zs = _zones_sql(NX, NY, NZ)
    ids = (NX + 1) * (NY + 1) * (NZ + 1)
    node = f"1 + ({{}}) + ({{}}) * {NX + 1} + ({{}}) * {(NX + 1) * (NY + 1)}"
    given = " UNION ALL ".join(f"SELECT 4 * rec + {k} AS turn, {node.format(f'CASE WHEN f = 1 THEN 0 ELSE {NX} END', f'(e - 1) // {NX} % {NY} + {dy}', f'(e - 1) // {NX * NY} + {dz}')} AS vid, (rec * 7 + {13 * k}) % {ids} + 1 AS g FROM z WHERE t = 5" for k, (dy, dz) in enumerate(turns))
    broken = f"z AS (SELECT rec, CASE WHEN rec % 40 = 12 THEN {N + 1} ELSE e END AS e, CASE WHEN rec % 40 = 11 THEN 7 ELSE f END AS f, CASE WHEN rec % 40 = 3 THEN 0 ELSE p_e END AS p_e, CASE WHEN rec % 40 = 31 THEN 25 ELSE p_f END AS p_f, CASE WHEN rec % 40 = 10 THEN 9 ELSE t END AS t FROM ({zs}))"
    bad = {"zone type": "t > 7", "zone place": f"e > {N} OR f > 6", "zone partner": f"t = 5 AND (p_e NOT BETWEEN 1 AND {N} OR p_f NOT BETWEEN 1 AND 6)", "zone label": "t = 7 AND p_f NOT BETWEEN 1 AND 20"}
    faults = f"WITH {broken} " + " UNION ALL ".join(f"SELECT '{k}' AS violation, count(*) AS n, CAST(min(rec) + 1 AS BIGINT) AS first FROM z WHERE {w}" for k, w in bad.items())
    faults += f" UNION ALL SELECT 'curve element', 1, 7 UNION ALL SELECT 'curve type', 2, 2 UNION ALL SELECT 'element id', 1, 51 UNION ALL SELECT 'element ids', {N} - count(DISTINCT i), NULL FROM (SELECT p + 1 - CASE WHEN p % 30 = 4 THEN 1 ELSE 0 END AS i FROM range({N}) r(p) WHERE p <> 50)"
    sides = 2 * (NX * NZ + NX * NY)
    report = f"WITH z AS ({zs}) SELECT 'unlabelled' AS metric, CAST(count(*) AS DOUBLE) AS value FROM z WHERE t = 7 AND rec % 3 = 0 UNION ALL SELECT 'external', {sides} UNION ALL SELECT 'n_bad', count(*) FROM range({N}) r(p) WHERE p % 10 = 7 UNION ALL SELECT 'first_bad', 8 UNION ALL SELECT 'min_jac', -0.125"
    small = "c AS (SELECT p AS pos, p % 4 AS x, p // 4 % 3 AS y, p // 12 AS z FROM range(24) r(p))"
    facet = "f(facet, axis, side) AS (VALUES (2,1,0),(3,1,1),(4,2,0),(5,2,1))"
    label27 = "max(CASE WHEN ((axis = 1 AND y = side * 2 AND (node // 3) % 3 = 2 * side) OR (axis = 2 AND z = side AND node // 9 = 2 * side)) THEN facet + 1 ELSE 0 END)"
    corner = "q(facet, axis, side, a, b, c_, d) AS (VALUES (0,0,0,0,4,7,3),(1,0,1,1,5,6,2),(2,1,0,0,1,5,4),(3,1,1,3,2,6,7),(4,2,0,0,1,2,3),(5,2,1,4,5,6,7))"
    skin = f"WITH {small}, {slots}, {corner}, o AS (SELECT row_number() OVER (ORDER BY pos, facet) - 1 AS quad, * FROM c, q WHERE (axis = 0 AND x = side * 3) OR (axis = 1 AND y = side * 2) OR (axis = 2 AND z = side)) " + " UNION ALL ".join(f"SELECT quad, CAST({k} AS BIGINT) AS k, CAST(x + cx AS DOUBLE) AS x, CAST(y + cy AS DOUBLE) AS y, CAST(z + cz AS DOUBLE) AS z FROM o JOIN s ON s.slot = o.{n}" for k, n in enumerate(("a", "b", "c_", "d")))
    plain = [(1, NY * NZ), (2, NY * NZ), (3, NX * NZ), (4, NX * NZ), (5, NX * NY), (6, NX * NY)]
    owner = "CASE " + " ".join(f"WHEN r < {sum(n for _, n in plain[: k + 1])} THEN {f}" for k, (f, _) in enumerate(plain)) + " END"
    return {
        "input_elements": f"WITH {cells}, {slots} SELECT version, pos, CAST(slot AS BIGINT) AS slot, CAST(x + cx AS DOUBLE) AS x, CAST(y + cy AS DOUBLE) AS y, CAST(z + cz AS DOUBLE) AS z FROM c, s, {versions(('#v001', '#v002', '#v004'))}",
        "input_boundaries": f"WITH {cells}, {face}, {b} SELECT version, rec, e, CAST(face AS BIGINT) AS side, type, {d0} FROM b, {versions(('#v001', '#v003', '#v004'))}",
        "convert_points": f"WITH {points} SELECT pos, CAST(slot AS BIGINT) AS slot, vid FROM k JOIN v USING (px, py, pz)",
        "convert_zones": zones,
        "convert_curves": f"WITH e AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS rec FROM range({N}) r(p) WHERE p % 5 = 2) SELECT rec, p + 1 AS e, CAST(edge AS BIGINT) AS edge, CAST(4 AS BIGINT) AS type, CAST(p * 10 + more AS DOUBLE) AS value FROM e, (VALUES (3, 1), (12, 2)) k(edge, more)",
        "field_file": f"WITH {small}, {facet}, l AS (SELECT pos, x, y, z, node, {label27} AS label FROM c, range(27) n(node), f GROUP BY ALL) SELECT pos + 1 AS id, node, x + (node % 3) / 2 AS x, y + ((node // 3) % 3) / 2 AS y, z + (node // 9) / 2 AS z, CAST(label AS BIGINT) AS label, CAST(max(label) OVER (PARTITION BY pos) AS BIGINT) AS most FROM l",
        "surface_file": skin,
        "chunked_scan": f"SELECT p // 17 * 17 AS first, count(*) AS n, CAST(sum(p + 1) AS BIGINT) AS ids FROM range({N}) r(p) GROUP BY ALL",
        "merges_apart": f"WITH {cells}, {slots}, z AS ({zs}), m AS (SELECT vid, min(g) AS low, arg_max(g, turn) AS last FROM ({given}) GROUP BY vid), k AS (SELECT pos, slot, {node.format('x + cx', 'y + cy', 'z + cz')} AS vid FROM c, s) SELECT pos, CAST(slot AS BIGINT) AS slot, CAST(least(vid, coalesce(low, vid)) AS BIGINT) AS low, CAST(coalesce(last, vid) AS BIGINT) AS last FROM k LEFT JOIN m USING (vid)",
        "mesh_violations": faults,
        "faulty_report": report,
        "last_labels": f"SELECT CAST({owner} + CASE WHEN r % 4 = 1 THEN 10 ELSE 0 END AS BIGINT) AS label, count(*) AS facets FROM range({sum(n for _, n in plain)}) t(r) GROUP BY ALL",
        "spectral_parts": f"SELECT k AS part, CAST({24 * 18 * 12} // 7 + CASE WHEN k < {24 * 18 * 12} % 7 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(1 AS BIGINT) AS pieces, true AS cut_is_low FROM range(7) r(k)",
        "repaired_parts": "SELECT p AS pos, CAST(CASE WHEN p < 15 THEN 0 ELSE 1 END AS BIGINT) AS part FROM range(30) r(p)",
    }
