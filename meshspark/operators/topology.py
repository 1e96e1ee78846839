"""Faces, edges, point identities, periodic merges, external surface and dual graph.

Elements come as (pos, ids): a record place and the 8 vertex ids as longs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical, corner_ids, edges, facet_slot, facets
from ..schema import MOST_IDS, PERIODIC, Mesh, MeshError
from ..store import numbered, pinned

KEYS = [f"k{i}" for i in range(4)]
BROADCAST = 1_000_000  # rows of two longs


def cells(mesh: Mesh) -> DataFrame:
    """(pos, ids) of a mesh, with its raw vertex ids."""
    return mesh.elements.select("pos", corner_ids(F.col("v")).alias("ids"))


def corners(cells: DataFrame) -> DataFrame:
    """(pos, slot, vid): a row per corner."""
    return cells.select("pos", F.posexplode("ids").alias("slot", "vid"))


def facet_rows(cells: DataFrame) -> DataFrame:
    """(pos, facet from 0, q, k0..k3): a row per element and facet; k are its ids in ascending order."""
    rows = cells.select("pos", F.explode(facets(F.col("ids"))).alias("x")).select("pos", "x.facet", "x.q")
    return rows.select("*", *canonical(F.col("q")))


def face_multiplicity(cells: DataFrame) -> DataFrame:
    """(pos, facet, q, mult): how often the face of each element's facet occurs in the mesh."""
    return facet_rows(cells).select("pos", "facet", "q", F.count("*").over(Window.partitionBy(*KEYS)).alias("mult"))


def faces(cells: DataFrame) -> DataFrame:
    """(k0..k3, mult, pos, facet): a row per distinct face; pos and facet name its first owner."""
    return facet_rows(cells).groupBy(*KEYS).agg(F.count("*").alias("mult"), F.min(F.col("pos") * 6 + F.col("facet")).alias("at_")).select(*KEYS, "mult", F.floor(F.col("at_") / 6).alias("pos"), (F.col("at_") % 6).cast("int").alias("facet"))


def skin(cells: DataFrame) -> DataFrame:
    """(pos, facet): the facets whose face occurs once. A face of one owner needs no second look at it."""
    return faces(cells).where("mult = 1").select("pos", "facet")


def distinct_edges(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(edges(F.col("ids"))).alias("e")).select("e.lo", "e.hi").distinct()


def count_edges(cells: DataFrame) -> int:
    return distinct_edges(cells).count()


def dedup_points(points: DataFrame) -> DataFrame:
    """points (corner, bx, by, bz) -> (bx, by, bz, vid): the distinct points, numbered from 1 by first
    appearance; corner is the place of a corner, the b are the bits of its coordinates. Points are equal if
    their bits are."""
    first = points.groupBy("bx", "by", "bz").agg(F.min("corner").alias("first"))
    out = pinned(numbered(first, ["first"], "at").select("bx", "by", "bz", (F.col("at") + 1).alias("vid")))
    if out.count() > MOST_IDS:
        raise MeshError(f"more than {MOST_IDS} distinct points")
    return out


def compress_ids(cells: DataFrame) -> DataFrame:
    """cells with their ids replaced by 0, 1, 2, ... in ascending order of id."""
    flat = corners(cells)
    dense = numbered(flat.select("vid").distinct(), ["vid"], "dense")
    return gather(flat.join(dense, "vid").select("pos", "slot", F.col("dense").alias("vid")))


def gather(flat: DataFrame) -> DataFrame:
    """Corners back to (pos, ids)."""
    rows = flat.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("slot", "vid"))).alias("c"))
    return rows.select("pos", F.transform("c", lambda c: c["vid"]).alias("ids"))


def zone_corners(mesh: Mesh, type_: int = PERIODIC) -> DataFrame:
    """(rec, k, pos, facet from 1, vid, g): the corners of the zones of a type, with the raw vertex id and
    the id that the record names."""
    at = mesh.elements.select("pos", F.col("elid").alias("e"), corner_ids(F.col("v")).alias("ids"))
    z = mesh.zones.where(F.col("t") == type_).select("rec", "e", "f", "g").join(at, "e")
    rows = z.select("rec", "pos", "f", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("ids")[facet_slot(F.col("f"), k)].alias("vid"), F.col("g")[k].cast("long").alias("g")) for k in range(4)))).alias("c"))
    return rows.select("rec", "c.k", "pos", F.col("f").alias("facet"), "c.vid", "c.g")


def _renamed(mesh: Mesh, names: DataFrame, value) -> DataFrame:
    """cells with each id replaced, once, by its value among names (vid, new). Names are those of periodic facets, a small
    part of all; up to BROADCAST of them are broadcast. Only elements that hold one are put together again."""
    every, few = cells(mesh), pinned(names)
    held = corners(every).join(F.broadcast(few) if few.count() <= BROADCAST else few, "vid")
    entry = F.struct("slot", value.alias("vid"))
    changed = held.groupBy("pos").agg(F.map_from_entries(F.collect_list(entry)).alias("new"))
    ids = F.transform("ids", lambda v, k: F.coalesce(F.col("new")[k], v))
    return every.join(changed, "pos", "left").select("pos", F.when(F.col("new").isNull(), F.col("ids")).otherwise(ids).alias("ids"))


def min_merge(mesh: Mesh) -> DataFrame:
    """cells where a vertex that periodic records name takes the least of its own id and theirs. One pass:
    the new id isn't looked up again."""
    low = zone_corners(mesh).groupBy("vid").agg(F.min("g").alias("new"))
    return _renamed(mesh, low, F.least("vid", F.coalesce("new", "vid")))


def replace_merge(mesh: Mesh) -> DataFrame:
    """cells where a vertex that periodic records name takes the id of the last record and corner that
    does. One pass as well."""
    last = zone_corners(mesh).groupBy("vid").agg(F.max_by("g", F.col("rec") * 4 + F.col("k")).alias("new"))
    return _renamed(mesh, last, F.coalesce("new", "vid"))


def dual_graph(cells: DataFrame) -> DataFrame:
    """(i, j, w): elements that share vertices, in both directions; w counts pairs of corners of the same
    vertex, so a vertex that an element holds twice counts twice."""
    held = corners(cells).groupBy("vid", "pos").agg(F.count("*").alias("n"))
    a, b = held.select("vid", F.col("pos").alias("i"), F.col("n").alias("m")), held.select("vid", F.col("pos").alias("j"), "n")
    once = a.join(b, "vid").where("i < j").groupBy("i", "j").agg(F.sum(F.col("m") * F.col("n")).alias("w"))
    return once.select(F.explode(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w"))).alias("e")).select("e.*")
