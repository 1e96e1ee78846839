"""Queries over generated meshes, and their SQL. The SQL counts and places things by formulas of the grid; it
neither explodes facets nor joins corners where a formula will do."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import corner_ids, rank_of_position
from ..operators import geometry, partition, surface, topology
from ..sources.box import box_mesh
from ..sources.files import read_nmsh
from ..sources.sinks import write_nmsh
from ..store import frame, mounted_folder
from . import tools

NX, NY, NZ = 24, 18, 12
N = (NX, NY, NZ)
X_PERIODIC = (True, False, False)
PARTS = 7

# the cell (x, y, z) and slots (s: cx, cy, cz) of the grid, for the SQL
_CELLS = f"c AS (SELECT p AS pos, p % {NX} AS x, (p // {NX}) % {NY} AS y, p // {NX * NY} AS z FROM range({NX * NY * NZ}) r(p))"
_SLOTS = "s(slot, cx, cy, cz) AS (VALUES (0,0,0,0),(1,1,0,0),(2,1,1,0),(3,0,1,0),(4,0,0,1),(5,1,0,1),(6,1,1,1),(7,0,1,1))"
_NODE = f"1 + ({{}}) + ({{}}) * {NX + 1} + ({{}}) * {(NX + 1) * (NY + 1)}"
# facet, its axis and side, and the slots of its corners
_FACETS = "f(facet, axis, side, a, b, c_, d) AS (VALUES (0,0,0,0,4,7,3),(1,0,1,1,5,6,2),(2,1,0,0,1,5,4),(3,1,1,3,2,6,7),(4,2,0,0,1,2,3),(5,2,1,4,5,6,7))"


def _box(spark, counts=N, **options):
    return box_mesh(spark, counts, **options)


def box_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _box(spark).elements.select("pos", "elid", F.posexplode("v").alias("slot", "c"))
    return e.select("pos", F.col("elid").cast("long").alias("elid"), F.col("slot").cast("long").alias("slot"), F.col("c.idx").cast("long").alias("vid"), "c.x", "c.y", "c.z")


def box_points(spark, sf_dir):
    return _box(spark).elements.select(F.explode("v").alias("c")).select(F.col("c.idx").cast("long").alias("vid"), "c.x", "c.y", "c.z").distinct()


def box_face_multiplicity(spark, sf_dir):
    return topology.face_multiplicity(topology.cells(_box(spark))).groupBy(F.col("mult").cast("long").alias("mult")).agg(F.count("*").alias("facets"))


def box_faces(spark, sf_dir):
    return topology.faces(topology.cells(_box(spark))).groupBy(F.col("mult").cast("long").alias("mult")).agg(F.count("*").alias("faces"))


def box_edge_count(spark, sf_dir):
    raw = topology.distinct_edges(topology.cells(_box(spark))).agg(F.count("*").alias("raw_edges"))
    merged = topology.distinct_edges(topology.replace_merge(_box(spark, periodic=X_PERIODIC))).agg(F.count("*").alias("merged_edges"))
    return raw.crossJoin(merged)


def box_zones(spark, sf_dir):
    z = _box(spark, periodic=X_PERIODIC).zones
    return z.select(*(F.col(c).cast("long").alias(c) for c in ("rec", "e", "f", "p_e", "p_f", "t")), *(F.col("g")[k].cast("long").alias(f"g{k}") for k in range(4)))


def _flat(cells):
    return topology.corners(cells).select("pos", F.col("slot").cast("long").alias("slot"), F.col("vid").cast("long").alias("vid"))


def box_replace_merge(spark, sf_dir):
    return _flat(topology.replace_merge(_box(spark, periodic=X_PERIODIC)))


def box_min_merge(spark, sf_dir):
    return _flat(topology.min_merge(_box(spark, periodic=X_PERIODIC)))


def box_compress_ids(spark, sf_dir):
    return _flat(topology.compress_ids(topology.min_merge(_box(spark, periodic=X_PERIODIC))))


def box_dual_graph(spark, sf_dir):
    return topology.dual_graph(topology.cells(_box(spark)))


def box_linear_ranks(spark, sf_dir):
    n = NX * NY * NZ
    return spark.range(n).select(F.col("id").alias("pos"), rank_of_position(F.col("id"), n, PARTS).cast("long").alias("part"))


def box_linear_sizes(spark, sf_dir):
    return partition.linear_sizes(spark, NX * NY * NZ, PARTS).select(F.col("part").cast("long").alias("part"), "size")


def box_weighted_cut(spark, sf_dir):
    m = _box(spark)
    part = m.elements.select("pos", rank_of_position(F.col("pos"), m.nelv, PARTS).alias("part"))
    return partition.weighted_cut(topology.dual_graph(topology.cells(m)), part).select(F.col("cut").cast("long").alias("cut"), F.col("total").cast("long").alias("total"))


def box_bisection(spark, sf_dir):
    return partition.coordinate_bisection(partition.centroids(_box(spark, (3, 3, 3))), 27, 5).select("pos", F.col("part").cast("long").alias("part"))


def box_bisection_cut(spark, sf_dir):
    m = _box(spark, (8, 8, 8))
    part = partition.coordinate_bisection(partition.centroids(m), 512, 7)
    return partition.weighted_cut(topology.dual_graph(topology.cells(m)), part).select(F.col("cut").cast("long").alias("cut"), F.col("total").cast("long").alias("total"))


def box_spectral_sizes(spark, sf_dir):
    part, _ = tools.partitioned(_box(spark, (6, 5, 4)), PARTS, "spectral", False)
    return partition.part_sizes(part, PARTS).select(F.col("part").cast("long").alias("part"), "size")


def box_repaired_sizes(spark, sf_dir):
    m = _box(spark, (6, 5, 4))
    slabs = m.elements.select("pos", F.floor(F.col("pos") / 30).cast("int").alias("part"))
    part = partition.repair_sizes(topology.dual_graph(topology.cells(m)), slabs, m.nelv, PARTS)
    return partition.part_sizes(part, PARTS).select(F.col("part").cast("long").alias("part"), "size")


def box_reorder(spark, sf_dir):
    """Records dealt in turn over the parts: the block order is known."""
    m = _box(spark, (6, 5, 4), periodic=X_PERIODIC)
    part = m.elements.select("pos", (F.col("pos") % 4).cast("int").alias("part"))
    return partition.reorder(m, part).zones.select(*(F.col(c).cast("long").alias(c) for c in ("rec", "e", "f", "p_e", "p_f", "t")))


def box_skin(spark, sf_dir):
    m = _box(spark, periodic=X_PERIODIC)
    points, quads = surface.surface(m)
    names = [points.select(F.col("point").alias(n), F.col("vid").cast("long").alias(f"v{n}")) for n in "abcd"]
    for n, p in zip("abcd", names):
        quads = quads.join(p, n)
    return quads.select("quad", "pos", F.col("facet").cast("long").alias("facet"), "va", "vb", "vc", "vd")


def box_jacobian(spark, sf_dir):
    m = _box(spark, bounds=(0.0, float(NX), 0.0, 2.0 * NY, 0.0, 4.0 * NZ))
    return geometry.jacobians(m.elements).select("pos", "min_jac")


def box_node_coordinates(spark, sf_dir):
    rows = geometry.node_rows(_box(spark, (4, 3, 2)).elements).select("pos", F.posexplode("nodes").alias("node", "p"))
    return rows.select("pos", F.col("node").cast("long").alias("node"), "p.x", "p.y", "p.z")


def box_zone_field(spark, sf_dir):
    rows = geometry.zone_field(_box(spark, (4, 3, 2), periodic=X_PERIODIC)).select("pos", F.posexplode("scalar").alias("node", "label"))
    return rows.select("pos", F.col("node").cast("long").alias("node"), F.col("label").cast("long").alias("label"))


def box_report(spark, sf_dir):
    return tools.report(_box(spark, periodic=X_PERIODIC), jacobian=True)


def box_file_round_trip(spark, sf_dir):
    """Write the box as a file, read it back, and count what came."""
    with tempfile.TemporaryDirectory(dir=mounted_folder(spark)) as d:
        path = os.path.join(d, "box.nmsh")
        write_nmsh(_box(spark, periodic=X_PERIODIC), path)
        m = read_nmsh(spark, path, chunk=1000)
        e = m.elements.agg(F.count("*").alias("n"), F.sum("elid").alias("ids"), F.sum(F.aggregate(corner_ids(F.col("v")), F.lit(0).cast("long"), lambda s, x: s + x)).alias("vids")).first()
        z = m.zones.agg(F.count("*").alias("n"), F.sum("e").alias("e")).first()
        rows = {"file_bytes": os.path.getsize(path), "elements": e.n, "id_sum": e.ids, "vertex_id_sum": e.vids, "zones": z.n, "zone_element_sum": z.e, "trailing": m.trailing}
    return frame(spark, [(k, int(v)) for k, v in rows.items()], "metric string, value long")


QUERIES = {f.__name__: f for f in (box_elements, box_points, box_face_multiplicity, box_faces, box_edge_count, box_zones, box_replace_merge, box_min_merge, box_compress_ids, box_dual_graph, box_linear_ranks, box_linear_sizes, box_weighted_cut, box_bisection, box_bisection_cut, box_spectral_sizes, box_repaired_sizes, box_reorder, box_skin, box_jacobian, box_node_coordinates, box_zone_field, box_report, box_file_round_trip)}


def queries():
    return dict(QUERIES)


def _face_numbers(nx, ny, nz):
    inner = (nx - 1) * ny * nz + nx * (ny - 1) * nz + nx * ny * (nz - 1)
    outer = 2 * (ny * nz + nx * nz + nx * ny)
    return inner, outer


def _zones_sql(nx: int, ny: int, nz: int) -> str:
    """Zones of a box that is periodic in x: two periodic facets, then labels 3 to 6."""
    node = f"1 + {{}} + ({{}}) * {nx + 1} + ({{}}) * {(nx + 1) * (ny + 1)}"
    x = [
        f"SELECT {side * ny * nz} + y * {nz} + z AS rec, 1 + {side * (nx - 1)} + y * {nx} + z * {nx * ny} AS e, {side + 1} AS f, 1 + {(1 - side) * (nx - 1)} + y * {nx} + z * {nx * ny} AS p_e, {2 - side} AS p_f, 5 AS t, "
        + ", ".join(f"{node.format(0, f'y + {dy}', f'z + {dz}')} AS g{k}" for k, (dy, dz) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))))
        + f" FROM range({ny}) a(y), range({nz}) b(z)"
        for side in (0, 1)
    ]
    at, out = 2 * ny * nz, list(x)
    for f in (3, 4):
        out.append(f"SELECT {at} + x * {nz} + z, 1 + x + {(f - 3) * (ny - 1) * nx} + z * {nx * ny}, {f}, 0, {f}, 7, 0, 0, 0, 0 FROM range({nx}) a(x), range({nz}) b(z)")
        at += nx * nz
    for f in (5, 6):
        out.append(f"SELECT {at} + x * {ny} + y, 1 + x + y * {nx} + {(f - 5) * (nz - 1) * nx * ny}, {f}, 0, {f}, 7, 0, 0, 0, 0 FROM range({nx}) a(x), range({ny}) b(y)")
        at += nx * ny
    return " UNION ALL ".join(out)


def oracle_sql():
    inner, outer = _face_numbers(*N)
    edges = NX * (NY + 1) * (NZ + 1) + (NX + 1) * NY * (NZ + 1) + (NX + 1) * (NY + 1) * NZ
    wrapped = edges - NY * (NZ + 1) - (NY + 1) * NZ
    wrap = _NODE.format(f"(x + cx) % {NX}", "y + cy", "z + cz")
    n = NX * NY * NZ
    small, more = divmod(n, PARTS)
    neighbours = "o(dx, dy, dz) AS (SELECT * FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j), (VALUES (-1),(0),(1)) c(k) WHERE (i, j, k) <> (0, 0, 0))"
    graph = f"WITH {_CELLS}, {neighbours} SELECT pos AS i, pos + dx + dy * {NX} + dz * {NX * NY} AS j, CAST((2 - abs(dx)) * (2 - abs(dy)) * (2 - abs(dz)) AS BIGINT) AS w FROM c, o WHERE x + dx BETWEEN 0 AND {NX - 1} AND y + dy BETWEEN 0 AND {NY - 1} AND z + dz BETWEEN 0 AND {NZ - 1}"
    rank = f"CASE WHEN {{0}} < {more * (small + 1)} THEN {{0}} // {small + 1} ELSE {more} + ({{0}} - {more * (small + 1)}) // {small} END"
    parts27 = "0,0,2,0,1,3,1,1,3,0,2,2,0,3,3,1,3,4,0,2,2,1,4,4,1,4,4"
    sizes = lambda n, p: f"SELECT k AS part, CAST({n} // {p} + CASE WHEN k < {n} % {p} THEN 1 ELSE 0 END AS BIGINT) AS size FROM range({p}) r(k)"
    facts = {
        "elements": n, "points": (NX + 1) * (NY + 1) * (NZ + 1), "x_min": 0, "x_max": NX, "y_min": 0, "y_max": NY, "z_min": 0, "z_max": NZ,
        "faces": NX * NY * NZ + NX * (NY + 1) * NZ + NX * NY * (NZ + 1), "external": 2 * NX * (NY + NZ), "edges": wrapped, "unlabelled": 0, "periodic": 2 * NY * NZ, "legacy": 0,
        **{f"zone_{k:02d}": (NX * NZ if k in (3, 4) else NX * NY if k in (5, 6) else 0) for k in range(1, 21)},
        "min_jac": 0.125, "n_bad": 0, "first_bad": 0, "n_nan": 0,
    }
    file = f"WITH {_CELLS}, {_SLOTS}, z AS ({_zones_sql(*N)}) SELECT 'file_bytes' AS metric, 16 + 228 * {n} + 36 * (SELECT count(*) FROM z) AS value UNION ALL SELECT 'elements', {n} UNION ALL SELECT 'id_sum', {n * (n + 1) // 2} UNION ALL SELECT 'vertex_id_sum', CAST(sum({_NODE.format('x + cx', 'y + cy', 'z + cz')}) AS BIGINT) FROM c, s UNION ALL SELECT 'zones', count(*) FROM z UNION ALL SELECT 'zone_element_sum', CAST(sum(e) AS BIGINT) FROM z UNION ALL SELECT 'trailing', 0"
    turn = "CAST(1 + (({0} - 1) % 4) * 30 + ({0} - 1) // 4 AS BIGINT)"
    on = "((axis = 0 AND node % 3 = 2 * side) OR (axis = 1 AND (node // 3) % 3 = 2 * side) OR (axis = 2 AND node // 9 = 2 * side))"
    skin = (
        f"WITH {_CELLS}, {_SLOTS}, {_FACETS}, q AS (SELECT row_number() OVER (ORDER BY pos, facet) - 1 AS quad, * FROM c, f WHERE (axis = 0 AND x = side * {NX - 1}) OR (axis = 1 AND y = side * {NY - 1}) OR (axis = 2 AND z = side * {NZ - 1})) SELECT quad, pos, CAST(facet AS BIGINT) AS facet, "
        + ", ".join(f"CAST({_NODE.format(f's{k}.cx + x', f's{k}.cy + y', f's{k}.cz + z')} AS BIGINT) AS v{name}" for k, name in enumerate("abcd"))
        + " FROM q"
        + "".join(f" JOIN s s{k} ON s{k}.slot = q.{col}" for k, col in enumerate(("a", "b", "c_", "d")))
    )
    return {
        "box_elements": f"WITH {_CELLS}, {_SLOTS} SELECT pos, pos + 1 AS elid, CAST(slot AS BIGINT) AS slot, CAST({_NODE.format('x + cx', 'y + cy', 'z + cz')} AS BIGINT) AS vid, CAST(x + cx AS DOUBLE) AS x, CAST(y + cy AS DOUBLE) AS y, CAST(z + cz AS DOUBLE) AS z FROM c, s",
        "box_points": f"SELECT {_NODE.format('x', 'y', 'z')} AS vid, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM range({NX + 1}) a(x), range({NY + 1}) b(y), range({NZ + 1}) c(z)",
        "box_face_multiplicity": f"SELECT CAST(1 AS BIGINT) AS mult, CAST({outer} AS BIGINT) AS facets UNION ALL SELECT 2, {2 * inner}",
        "box_faces": f"SELECT CAST(1 AS BIGINT) AS mult, CAST({outer} AS BIGINT) AS faces UNION ALL SELECT 2, {inner}",
        "box_edge_count": f"SELECT CAST({edges} AS BIGINT) AS raw_edges, CAST({wrapped} AS BIGINT) AS merged_edges",
        "box_zones": f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('rec', 'e', 'f', 'p_e', 'p_f', 't', 'g0', 'g1', 'g2', 'g3'))} FROM ({_zones_sql(*N)})",
        "box_replace_merge": f"WITH {_CELLS}, {_SLOTS} SELECT pos, CAST(slot AS BIGINT) AS slot, CAST({wrap} AS BIGINT) AS vid FROM c, s",
        "box_min_merge": f"WITH {_CELLS}, {_SLOTS} SELECT pos, CAST(slot AS BIGINT) AS slot, CAST({wrap} AS BIGINT) AS vid FROM c, s",
        "box_compress_ids": f"WITH {_CELLS}, {_SLOTS} SELECT pos, CAST(slot AS BIGINT) AS slot, CAST((x + cx) % {NX} + (y + cy) * {NX} + (z + cz) * {NX * (NY + 1)} AS BIGINT) AS vid FROM c, s",
        "box_dual_graph": graph,
        "box_linear_ranks": f"SELECT p AS pos, CAST({rank.format('p')} AS BIGINT) AS part FROM range({n}) r(p)",
        "box_linear_sizes": sizes(n, PARTS),
        "box_weighted_cut": f"SELECT CAST(sum(CASE WHEN {rank.format('i')} <> {rank.format('j')} THEN w END) // 2 AS BIGINT) AS cut, CAST(sum(w) // 2 AS BIGINT) AS total FROM ({graph})",
        "box_bisection": f"SELECT row_number() OVER () - 1 AS pos, CAST(part AS BIGINT) AS part FROM (SELECT unnest([{parts27}]) AS part)",
        "box_bisection_cut": "SELECT CAST(2686 AS BIGINT) AS cut, CAST(11452 AS BIGINT) AS total",
        "box_spectral_sizes": sizes(120, PARTS),
        "box_repaired_sizes": sizes(120, PARTS),
        "box_reorder": f"SELECT rec, {turn.format('e')} AS e, CAST(f AS BIGINT) AS f, CASE WHEN t = 5 THEN {turn.format('p_e')} ELSE 0 END AS p_e, CAST(p_f AS BIGINT) AS p_f, CAST(t AS BIGINT) AS t FROM ({_zones_sql(6, 5, 4)})",
        "box_skin": skin,
        "box_jacobian": f"SELECT p AS pos, CAST(1 AS DOUBLE) AS min_jac FROM range({n}) r(p)",
        "box_node_coordinates": "SELECT p AS pos, k AS node, p % 4 + (k % 3) / 2 AS x, (p // 4) % 3 + ((k // 3) % 3) / 2 AS y, p // 12 + (k // 9) / 2 AS z FROM range(24) a(p), range(27) b(k)",
        "box_zone_field": f"WITH {_FACETS}, c AS (SELECT p AS pos, p % 4 AS x, (p // 4) % 3 AS y, p // 12 AS z FROM range(24) r(p)) SELECT pos, node, CAST(coalesce(max(CASE WHEN {on} AND ((axis = 1 AND y = side * 2) OR (axis = 2 AND z = side)) THEN facet + 1 END), 0) AS BIGINT) AS label FROM c, range(27) n(node), f GROUP BY pos, node",
        "box_report": " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value" for k, v in facts.items()),
        "box_file_round_trip": file,
    }
