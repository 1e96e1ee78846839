"""The external surface of a mesh as indexed quads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import facets, rank_of_position
from ..schema import Mesh, MeshError
from ..store import numbered, pinned
from .geometry import facet_labels, jacobians
from .topology import cells, skin


def surface(mesh: Mesh, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, quads). quads (quad, pos, facet, a, b, c, d, and the columns of data): facets whose face
    occurs once by raw ids, in order of (pos, facet); a..d index points (point, vid, x, y, z), in single
    precision and order of vertex id. Where owners disagree on a point the last one wins. data is keyed by
    pos."""
    at = mesh.elements.select("pos", "v", F.transform("v", lambda c: c["idx"].cast("long")).alias("ids"))
    picked = skin(cells(mesh)).join(at, "pos").select("pos", "facet", "v", F.get(facets(F.col("ids")), F.col("facet"))["q"].alias("q"), F.get(facets(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: k.cast("long"))), F.col("facet"))["q"].alias("slots"))
    quads = pinned(numbered(picked, ["pos", "facet"], "quad"))
    corner = quads.select("quad", "q", "v", F.posexplode("slots").alias("k", "slot")).select("quad", "k", F.col("q")[F.col("k")].alias("vid"), F.col("v")[F.col("slot").cast("int")].alias("c"))
    place = F.col("quad") * 4 + F.col("k")
    last = corner.groupBy("vid").agg(F.max_by(F.struct("c.x", "c.y", "c.z"), place).alias("c"))
    points = pinned(numbered(last.select("vid", *(F.col("c")[a].cast("float").alias(a) for a in "xyz")), ["vid"], "point"))
    index = corner.select("quad", "k", "vid").join(points.select("vid", "point"), "vid").groupBy("quad").agg(*(F.max(F.when(F.col("k") == k, F.col("point"))).alias(n) for k, n in enumerate("abcd")))
    out = quads.select("quad", "pos", "facet").join(index, "quad")
    if data is not None:
        out = out.join(data, "pos")
    return points, out


def coloured(mesh: Mesh, colour: str = "zone", parts: int = 0) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(points, quads, names of the data): quads carry the label of their facet (0: none), and on request the
    rank that owns their element's place or its least Jacobian."""
    data, names = None, ("zone",)
    if colour == "partition":
        if parts < 1:
            raise MeshError("colouring by partition needs the number of parts")
        data, names = mesh.elements.select("pos", rank_of_position(F.col("pos"), mesh.nelv, parts).alias("partition")), ("partition", "zone")
    elif colour == "jacobian":
        data, names = jacobians(mesh.elements).select("pos", F.col("min_jac").alias("jacobian")), ("jacobian", "zone")
    elif colour != "zone":
        raise MeshError(f"unknown colouring {colour!r}")
    points, quads = surface(mesh, data)
    return points, quads.join(facet_labels(mesh).withColumnRenamed("label", "zone"), ["pos", "facet"], "left").withColumn("zone", F.coalesce("zone", F.lit(0))), names
