"""Meshes against closed forms, brute force and byte layouts."""

import base64
import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions.columns import bc_type, rank_of_position, share
from meshspark.operators import convert, geometry, partition, surface, topology
from meshspark.operators.validate import validate
from meshspark.plans import tools
from meshspark.schema import CURVE, EDGE_SLOTS, ELEMENT, FACE_SLOTS, ZONE, MeshError
from meshspark.sources.box import box_mesh, grid_lines, parse_box
from meshspark.sources.files import read_grid_lines, read_nmsh
from meshspark.sources.sinks import write_nmsh
from meshspark.streaming.chunks import iter_elements

# box, periodic: elements, largest id, merged points, faces, edges, external, most, skin, zones 5, zones 7, bytes, links, weight
BOXES = [
    ((1, 1, 1), "FFF", 1, 8, 8, 6, 12, 6, 1, 6, 0, 6, 460, 0, 0),
    ((2, 2, 2), "FFF", 8, 27, 27, 36, 54, 24, 2, 24, 0, 24, 2704, 56, 76),
    ((3, 3, 3), "TTT", 27, 64, 27, 81, 81, 0, 2, 54, 54, 0, 8116, 702, 756),
    ((4, 3, 3), "TFT", 36, 80, 48, 120, 132, 24, 2, 66, 42, 24, 10600, 720, 816),
    ((2, 2, 2), "TTT", 8, 27, 8, 6, 12, 0, 8, 24, 24, 0, 2704, 56, 224),
    ((1, 3, 3), "TFF", 9, 32, 16, 33, 40, 12, 2, 30, 18, 12, 3148, 40, 128),
    ((1, 1, 1), "TTT", 1, 8, 1, 1, 1, 0, 6, 6, 6, 0, 460, 0, 0),
]


def box(spark, counts, per="FFF", **more):
    return box_mesh(spark, counts, periodic=tuple(c == "T" for c in per), **more)


@pytest.mark.parametrize("row", BOXES, ids=lambda r: f"{r[0]}{r[1]}")
def test_box_counts(spark, tmp_path, row):
    counts, per, n, top, points, faces, edges, external, most, skin, z5, z7, size, links, weight = row
    m = validate(box(spark, counts, per))
    assert m.nelv == n
    got = {r.metric: r.value for r in tools.report(m).collect()}
    assert (got["points"], got["faces"], got["edges"], got["external"], got["periodic"]) == (top, faces, edges, external, z5)
    assert sum(got[f"zone_{k:02d}"] for k in range(1, 21)) == z7 and got["unlabelled"] == 0
    merged = topology.replace_merge(m)
    assert topology.corners(merged).select("vid").distinct().count() == points
    f = topology.faces(merged).agg(F.max("mult"), F.sum("mult")).first()
    assert tuple(f) == (most, 6 * n)
    assert topology.skin(topology.cells(m)).count() == skin
    g = topology.dual_graph(topology.min_merge(m)).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    assert tuple(g) == (links, 2 * weight)
    path = str(tmp_path / "box.nmsh")
    write_nmsh(m, path)
    assert (tmp_path / "box.nmsh").stat().st_size == size == 16 + 228 * n + 36 * (z5 + z7)


def test_bisection_keeps_the_order_of_levels(spark):
    want = "0,0,2,0,1,3,1,1,3,0,2,2,0,3,3,1,3,4,0,2,2,1,4,4,1,4,4"
    m = box(spark, (3, 3, 3))
    got = partition.coordinate_bisection(partition.centroids(m), 27, 5)
    assert ",".join(str(r.part) for r in got.orderBy("pos").collect()) == want
    assert tuple(partition.weighted_cut(topology.dual_graph(topology.cells(m)), got).first()) == (249, 392)
    partition.check_sizes(got, 27, 5)


@pytest.mark.parametrize("backend", ["geometric", "spectral"])
def test_reorder_contract(spark, tmp_path, backend):
    src, out = str(tmp_path / "a.nmsh"), str(tmp_path / "b.nmsh")
    m = box(spark, (4, 3, 3), "TFF")
    write_nmsh(m, src)
    part, _ = tools.partitioned(m, 5, backend)
    made, cut = tools.prepare_partition(spark, src, 5, out, backend)
    part = [r.part for r in part.orderBy("pos").collect()]
    old, new = np.fromfile(src, ELEMENT, 36, offset=8), np.fromfile(out, ELEMENT, 36, offset=8)
    order = np.argsort(part, kind="stable")
    assert (new["elid"] == np.arange(1, 37)).all() and (new["v"] == old["v"][order]).all()
    place = np.empty(36, int)
    place[order] = np.arange(36)
    z0, z1 = (np.fromfile(p, ZONE, int(np.fromfile(p, "<i4", 1, offset=8 + 36 * 228)[0]), offset=12 + 36 * 228) for p in (src, out))
    assert (z1["e"] == place[z0["e"] - 1] + 1).all() and (z1["g"] == z0["g"]).all() and (z1["f"] == z0["f"]).all()
    five = z0["t"] == 5
    assert (z1["p_e"][five] == place[z0["p_e"][five] - 1] + 1).all() and (z1["p_e"][~five] == 0).all()
    assert made == out and cut.first().cut > 0
    assert tools.check(spark, out)[1]
    again = str(tmp_path / "c.nmsh")
    tools.prepare_partition(spark, src, 5, again, backend)
    assert open(again, "rb").read() == open(out, "rb").read()


def test_repair_gives_exact_sizes(spark):
    m = box(spark, (4, 3, 2))
    part = m.elements.select("pos", (F.col("pos") > 3).cast("int").alias("part"))
    graph = topology.dual_graph(topology.cells(m))
    got = partition.repair_sizes(graph, part, 24, 3)
    partition.check_sizes(got, 24, 3)


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "m.nmsh")
    m = box(spark, (2, 2, 1))
    write_nmsh(m, path)
    raw = open(path, "rb").read()
    for cut in (raw[:-4], raw[:100], raw[:6], struct.pack("<ii", 4, 2) + raw[8:], struct.pack("<ii", 0, 3) + raw[8:]):
        (tmp_path / "bad.nmsh").write_bytes(cut)
        with pytest.raises(MeshError):
            read_nmsh(spark, str(tmp_path / "bad.nmsh"))
    (tmp_path / "tail.nmsh").write_bytes(raw + b"xyz")
    assert read_nmsh(spark, str(tmp_path / "tail.nmsh")).trailing == 3
    with pytest.raises(MeshError):
        write_nmsh(read_nmsh(spark, path), path, (path,))
    assert open(path, "rb").read() == raw and not list(tmp_path.glob("*.tmp"))
    for change in ({"e": 11}, {"f": 7}, {"t": 8}, {"t": 0}, {"p_f": 21}, {"p_f": 0}):
        z = m.zones
        for c, v in change.items():
            z = z.withColumn(c, F.when(F.col("rec") == 3, v).otherwise(F.col(c)).cast("int"))
        with pytest.raises(MeshError):
            validate(m.with_(zones=z))
    twice = m.elements.withColumn("elid", F.when(F.col("pos") == 1, 1).otherwise(F.col("elid")).cast("int"))
    with pytest.raises(MeshError):
        validate(m.with_(elements=twice))
    with pytest.raises(MeshError):
        box(spark, (0, 1, 1))
    with pytest.raises(MeshError):
        tools.partitioned(m, 5)
    with pytest.raises(MeshError):
        partition.kway(topology.dual_graph(topology.cells(m)), 4, 2)


def test_round_trip_of_all_sections(spark, tmp_path):
    rng = np.random.default_rng(3)
    e, z, c = np.zeros(7, ELEMENT), np.zeros(3, ZONE), np.zeros(2, CURVE)
    e["elid"] = rng.permutation(7) + 1
    e["v"]["idx"] = rng.integers(1, 99, (7, 8))
    for a in "xyz":
        e["v"][a] = rng.normal(size=(7, 8))
    e["v"]["x"][0, 0] = -0.0
    z["e"], z["f"], z["t"], z["g"] = [1, 2, 3], [1, 6, 2], [6, 7, 2], rng.integers(0, 9, (3, 4))
    z["p_f"], z["p_e"] = [0, 4, 0], [5, 0, 77]
    c["e"], c["data"], c["type"] = [2, 5], rng.normal(size=(2, 12, 5)), rng.choice([0, 3, 4], (2, 12))
    raw = struct.pack("<ii", 7, 3) + e.tobytes() + struct.pack("<i", 3) + z.tobytes() + struct.pack("<i", 2) + c.tobytes()
    (tmp_path / "a.nmsh").write_bytes(raw)
    m = validate(read_nmsh(spark, str(tmp_path / "a.nmsh"), chunk=2))
    write_nmsh(m, str(tmp_path / "b.nmsh"))
    assert (tmp_path / "b.nmsh").read_bytes() == raw
    chunks = [(first, df.count()) for first, df in iter_elements(spark, str(tmp_path / "a.nmsh"), 3)]
    assert chunks == [(0, 3), (3, 3), (6, 1)]
    # a shuffled record order: ranks follow places, zones follow ids; types 6 and 2 differ in documenting facets
    labels = {(r.pos, r.facet): r.label for r in geometry.facet_labels(m).collect()}
    assert labels == {(int(np.flatnonzero(e["elid"] == 2)[0]), 5): 4}
    got = partition.reorder(m, m.elements.select("pos", F.lit(0).alias("part"))).zones.orderBy("rec").collect()
    assert [r.t for r in got] == [7, 6, 2] and [r.p_e for r in got] == [0, 5, 77]


def test_jacobian_and_field(spark, tmp_path):
    m = box(spark, (2, 1, 1), bounds=(0.0, 2.0, 0.0, 1.0, 0.0, 1.0))
    swap = F.when(F.col("pos") == 1, F.concat(F.array(F.col("v")[1], F.col("v")[0]), F.slice("v", 3, 6))).otherwise(F.col("v"))
    bad = m.with_(elements=m.elements.withColumn("v", swap))
    got = geometry.jacobian_report(bad.elements).first()
    assert got.min_jac == pytest.approx(-0.125) and (got.n_bad, got.first_bad, got.n_nan) == (1, 2, 0)
    nan = m.elements.withColumn("v", F.when(F.col("pos") == 0, F.transform("v", lambda c: c.withField("x", F.lit(float("nan"))))).otherwise(F.col("v")))
    got = geometry.jacobian_report(nan).first()
    assert (got.min_jac, got.n_bad, got.n_nan) == (0.125, 0, 1)
    path = str(tmp_path / "m.nmsh")
    write_nmsh(m, path)
    report, sound = tools.check(spark, path, write_zone_indices=True)
    assert sound
    raw = (tmp_path / "m_zone_indices.fld").read_bytes()
    assert len(raw) == 136 + 2 * (4 + 4 * 81 + 4 * 27 + 24 + 8)
    assert np.frombuffer(raw, "<i4", 2, 136).tolist() == [1, 2]
    xyz = np.frombuffer(raw, "<f4", 2 * 81, 144).reshape(2, 3, 27)
    assert xyz[1, 0, :3].tolist() == [1.0, 1.5, 2.0] and xyz[0, 2, ::9].tolist() == [0.0, 0.5, 1.0]
    scal = np.frombuffer(raw, "<f4", 54, 144 + 648).reshape(2, 27)
    assert scal[0, 0] == 5 and scal[0, 12] == 1 and scal[1, 26] == 6 and scal[0, 13] == 0
    assert "filetemplate: m_zone_indices.fld" in (tmp_path / "m_zone_indices.nek5000").read_text()


def test_surface_file(spark, tmp_path):
    path, out = str(tmp_path / "m.nmsh"), tmp_path / "skin.vtu"
    write_nmsh(box(spark, (3, 2, 2), "TFF"), path)
    tools.export_surface(spark, path, str(out), "partition", 4)
    text = out.read_text()
    assert 'NumberOfCells="32"' in text and 'Name="partition"' in text and 'Name="zone"' in text
    block = text.split('Name="zone" format="binary">\n')[1].split("\n")[0]
    raw = base64.b64decode(block)
    assert struct.unpack("<Q", raw[:8])[0] == 128
    zone = np.frombuffer(raw[8:], "<i4")
    assert sorted(set(zone.tolist())) == [0, 3, 4, 5, 6] and (zone == 0).sum() == 8
    points, quads = surface.surface(box(spark, (2, 2, 2)))
    assert points.count() == 26 and [tuple(r) for r in quads.orderBy("quad").select("pos", "facet").limit(4).collect()] == [(0, 0), (0, 2), (0, 4), (1, 1)]


def test_merges_differ_and_are_not_transitive(spark):
    m = box(spark, (2, 1, 1))
    first = [r.vid for r in topology.zone_corners(m.with_(zones=m.zones.withColumn("t", F.lit(5)))).where("rec = 0").orderBy("k").collect()]
    assert first == [1, 7, 10, 4]
    z = spark.createDataFrame([(0, 1, 1, 1, 1, [9, 7, 10, 4], 5), (1, 1, 1, 1, 1, [5, 7, 10, 4], 5), (2, 2, 2, 1, 1, [1, 9, 12, 6], 5)], m.zones.schema)
    m = m.with_(zones=z)
    low = {r.vid for r in topology.corners(topology.min_merge(m)).where("pos = 0 and slot = 0").collect()}
    last = {r.vid for r in topology.corners(topology.replace_merge(m)).where("pos = 0 and slot = 0").collect()}
    assert (low, last) == ({1}, {5})
    chain = [r.vid for r in topology.corners(topology.replace_merge(m)).where("pos = 1 and slot = 1").collect()]
    assert chain == [1]  # 3 -> 1, though 1 -> 5


def test_faces_and_edges_against_sets(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 12, (20, 8))
    cells = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(ids)], "pos long, ids array<long>")
    keys = [tuple(sorted(r[list(s)])) for r in ids for s in FACE_SLOTS]
    got = topology.face_multiplicity(cells).orderBy("pos", "facet").collect()
    assert [r.mult for r in got] == [keys.count(k) for k in keys]
    edges = {tuple(sorted((r[a], r[b]))) for r in ids for a, b in EDGE_SLOTS}
    assert topology.count_edges(cells) == len(edges)
    want = {(i, j): sum(int((ids[j] == v).sum()) for v in ids[i]) for i, j in itertools.permutations(range(20), 2)}
    links = {(r.i, r.j): r.w for r in topology.dual_graph(cells).collect()}
    assert links == {k: w for k, w in want.items() if w}


def test_linear_ranks(spark):
    for n, p in ((10, 3), (3, 3), (2, 5), (59, 7), (8, 1)):
        want = [r for r in range(p) for _ in range(n // p + (r < n % p))]
        got = spark.range(n).select(rank_of_position(F.col("id"), n, p)).collect()
        assert [r[0] for r in got] == want and share(n, p, 0, p) == n


def test_grid_lines_and_arguments(tmp_path):
    assert grid_lines(10, 0.0, 1.0)[8] == 0.7999999999999999 and grid_lines(10, 0.0, 1.0, direct=True)[8] == 0.8
    f = tmp_path / "g.csv"
    f.write_text("header\n0, 0.5\n 2 9\n")
    assert read_grid_lines(str(f), 2) == [0.0, 0.5, 2.0]
    assert grid_lines(2, 1.0, 7.0, str(f)) == [1.0, 1.5, 3.0] and grid_lines(2, 1.0, 7.0, str(f), True) == [0.0, 0.5, 2.0]
    f.write_text("0 1 2")
    assert read_grid_lines(str(f), 2) == [0.0, 1.0, 2.0]
    with pytest.raises(MeshError):
        read_grid_lines(str(f), 3)
    told = parse_box("0 1 0 1 0 1 2 3 4 .TRUE. f False uniform uniform a.csv o.nmsh --direct".split())
    assert told["counts"] == (2, 3, 4) and told["periodic"] == (True, False, False) and told["direct"] and told["out"] == "o.nmsh"
    for bad in ("0 1 0 1 0 1 2 3", "0 1 0 1 0 1 2 3 4 x f f", "0 1 0 1 0 1 2 3 z", " ".join("0" * 11)):
        with pytest.raises(MeshError):
            parse_box(bad.split())


def re2(path, xyz, curves=(), bcs=(), version=b"#v002", nel=None):
    n, wide = len(xyz), version != b"#v001"
    f, i = ("<f8", "<f8") if wide else ("<f4", "<i4")
    head = version + (b"%16d%3d%16d" % (nel or n, 3, n) if version == b"#v004" else b"%9d%3d%9d" % (nel or n, 3, n))
    out = head.ljust(80) + np.array([6.54321], "<f4").tobytes()
    for e in np.asarray(xyz, float):
        out += np.concatenate([[1.0], e.T.ravel()]).astype(f).tobytes()
    for rows in (curves, bcs):
        out += np.array([len(rows)], i).tobytes()
        for e, s, d, t in rows:
            out += np.array([e, s], i).tobytes() + np.array(list(d) + [0] * (5 - len(d)), f).tobytes() + t.ljust(8 if wide else 4, b"\0")
    path.write_bytes(out)
    return str(path)


def unit_box(nx):
    corner = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    return [[(i + x, y, z) for x, y, z in corner] for i in range(nx)]


@pytest.mark.parametrize("version", [b"#v001", b"#v002", b"#v004"])
def test_convert(spark, tmp_path, version):
    # faces 4 and 2 of the input are facets 1 and 2, 1 and 3 are facets 3 and 4
    bcs = [(1, 4, (2, 2), b"P"), (2, 2, (1, 4), b"P"), (1, 1, (0, 0, 0, 0, 4), b"MSH"), (1, 3, (), b"v"), (2, 1, (), b" W\0"), (2, 3, (), b"V"), (1, 5, (), b"E"), (1, 6, (), b"p"), (2, 5, (), b"xyz"), (2, 6, (), b"")]
    curves = [(2, 3, (1, 2, 3, 4, 5), b"C"), (2, 3, (9, 9, 9, 9, 9), b"m"), (1, 12, (7,), b"C")]
    src = re2(tmp_path / "a.re2", unit_box(2), curves, bcs, version)
    out = tools.convert(spark, src)
    m = validate(read_nmsh(spark, out))
    e = np.fromfile(out, ELEMENT, 2, offset=8)
    assert e["v"]["idx"].tolist() == [[1, 2, 3, 4, 5, 6, 7, 8], [2, 9, 10, 3, 6, 11, 12, 7]]
    z = [tuple(r)[1:] for r in m.zones.orderBy("rec").collect()]
    assert z[0] == (1, 1, 2, 2, [1, 5, 8, 4], 5) and z[1] == (2, 2, 1, 1, [1, 5, 8, 4], 5)
    assert [(r[0], r[1], r[3]) for r in z[2:]] == [(1, 3, 4), (1, 4, 5), (2, 4, 5), (2, 3, 6)]
    c = m.curves.orderBy("rec").collect()
    assert [(r.e, r.type[2], r.type[11], r.data[2][0], r.data[11][0]) for r in c] == [(1, 0, 3, 0.0, 7.0), (2, 4, 0, 9.0, 0.0)]


def test_convert_refuses(spark, tmp_path):
    good = re2(tmp_path / "a.re2", unit_box(1))
    raw = open(good, "rb").read()
    (tmp_path / "b.re2").write_bytes(raw[:150])
    cases = [str(tmp_path / "b.re2"), re2(tmp_path / "c.re2", unit_box(1), nel=2), re2(tmp_path / "d.re2", unit_box(1), bcs=[(1, 7, (), b"W")]), re2(tmp_path / "e.re2", unit_box(1), curves=[(1, 13, (), b"C")]), re2(tmp_path / "f.re2", unit_box(1), bcs=[(1, 1, (0, 0, 0, 0, 21), b"EXO")]), re2(tmp_path / "g.re2", unit_box(1), bcs=[(1, 1, (3, 1), b"P")]), re2(tmp_path / "h.re2", [[(float("nan"), 0, 0)] * 8])]
    for path in cases:
        with pytest.raises(MeshError):
            tools.convert(spark, path)
    assert not list(tmp_path.glob("*.nmsh")) and not list(tmp_path.glob("*.tmp"))


def test_points_differ_by_bits(spark, tmp_path):
    xyz = unit_box(1)
    other = [[(x if x else -0.0, y, z) for x, y, z in xyz[0]]]
    m = convert.convert(spark, re2(tmp_path / "a.re2", xyz + other))
    assert topology.corners(topology.cells(m)).select("vid").distinct().count() == 12


def test_leading_blank_drops_curves(spark, tmp_path):
    m = convert.convert(spark, re2(tmp_path / "a.re2", unit_box(1), [(1, 1, (1,), b"C"), (1, 2, (1,), b" C")]))
    assert m.curves.count() == 0
    got = spark.createDataFrame([(bytearray(b" W\0\0 "),)], "t binary").select(bc_type(F.col("t"))).first()[0]
    assert got == "W"


def test_sweep_is_no_component_search(spark):
    rows = [(0, 0, 5, 4), (0, 1, 4, 3), (0, 2, 3, 2), (1, 0, 2, 1)]
    got = {r.vid: r.pid for r in convert.sweep(spark.createDataFrame(rows, "rec long, k int, a long, b long")).collect()}
    pid = {v: v for v in range(1, 6)}
    for _ in range(3):
        for _, _, a, b in rows:
            pid[a] = pid[b] = min(pid[a], pid[b])
    assert got == pid and len(set(pid.values())) > 1


def grid_graph(*sides):
    """Links of a grid of cells, by shared corners."""
    at = list(itertools.product(*(range(s) for s in sides)))
    rows = [(a, b, 2 ** sum(x == y for x, y in zip(p, q))) for (a, p), (b, q) in itertools.permutations(enumerate(at), 2) if all(abs(x - y) <= 1 for x, y in zip(p, q))]
    return partition.Graph(*(np.array(c) for c in zip(*rows)), len(at))


def test_low_modes_equal_the_dense_solver(monkeypatch):
    g = grid_graph(14, 9, 5)
    a = np.zeros((g.n, g.n))
    a[g.i, g.j] = -g.w
    a[np.arange(g.n), np.arange(g.n)] = np.bincount(g.i, g.w)
    monkeypatch.setattr(partition, "DENSE", 60)
    x = partition.low_modes(g, 4)
    x /= np.linalg.norm(x, axis=0)
    assert np.allclose([v @ a @ v for v in x.T], np.linalg.eigvalsh(a)[1:5], rtol=1e-6)
    star = partition.Graph(np.r_[np.zeros(400, int), 1:401], np.r_[1:401, np.zeros(400, int)], np.ones(800), 401)
    assert partition.low_modes(star, 2).shape == (401, 2)


def test_region_grow():
    line = partition.Graph(np.r_[0:9, 1:10], np.r_[1:10, 0:9], np.ones(18), 10)
    assert partition.region_grow(line, 4).tolist() == [0] * 4 + [1] * 6
    # from the middle of a line the first growth cuts the rest in two, the second one doesn't
    order = np.array([5, 0, 1, 2, 3, 4, 6, 7, 8, 9])
    name = np.argsort(order)
    moved = partition.Graph(name[line.i], name[line.j], line.w, 10)
    side = partition.region_grow(moved, 4)
    assert (side == 0).sum() == 4 and partition.sides_connected(moved, side)
    apart = partition.Graph(np.array([0, 1, 2, 3]), np.array([1, 0, 3, 2]), np.ones(4), 6)
    assert partition.region_grow(apart, 3).tolist() == [0, 0, 0, 1, 1, 1] and apart.components().tolist() == [0, 0, 2, 2, 4, 5]
    empty = partition.Graph(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 3)
    assert empty.reached(1).tolist() == [1] and partition.sides_connected(empty, np.array([0, 1, 1])) is False


def test_repair_equals_the_greedy_rule(spark):
    rng = np.random.default_rng(9)
    for n, parts in ((20, 3), (17, 5)):
        a = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
        a = np.triu(a, 1) + np.triu(a, 1).T
        i, j = np.nonzero(a)
        graph = spark.createDataFrame([(int(x), int(y), int(a[x, y])) for x, y in zip(i, j)], "i long, j long, w long")
        first = (rng.random(n) ** 2 * parts).astype(int)
        got = [r.part for r in partition.repair_sizes(graph, spark.createDataFrame([(k, int(p)) for k, p in enumerate(first)], "pos long, part int"), n, parts).orderBy("pos").collect()]
        want = [share(n, parts, k, 1) for k in range(parts)]
        count = [list(first).count(k) for k in range(parts)]
        name = dict(zip(sorted(range(parts), key=lambda k: (-count[k], k)), sorted(range(parts), key=lambda k: (-want[k], k))))
        own = [name[k] for k in first]
        while any(own.count(k) > want[k] for k in range(parts)):
            source = next(k for k in range(parts) if own.count(k) > want[k])
            options = [(-sum(a[e, m] for m in range(n) if own[m] == k), k, e) for k in range(parts) if own.count(k) < want[k] for e in range(n) if own[e] == source]
            _, k, e = min(options)
            own[e] = k
        assert got == own
