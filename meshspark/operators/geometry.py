"""The trilinear map of a hex at its 3 x 3 x 3 nodes, and its Jacobian.

Nodes are ordered t, s, r with r inner. The matrices are 27 x 8; unrolled as columns they would make
expressions of thousands of terms, so elements go through numpy in Arrow batches."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELLED, SLOT_CORNER, Mesh

NODES = (-1.0, 0.0, 1.0)


def shapes() -> tuple[np.ndarray, np.ndarray]:
    """(27 x 8 shape functions, 3 x 27 x 8 derivatives by r, s and t)."""
    value, slope = np.empty((27, 8)), np.empty((3, 27, 8))
    for p, (t, s, r) in enumerate(itertools.product(NODES, repeat=3)):
        for k, corner in enumerate(SLOT_CORNER):
            sign = [2.0 * c - 1.0 for c in corner]
            one = [1.0 + x * g for x, g in zip((r, s, t), sign)]
            value[p, k] = 0.125 * (one[0] * one[1] * one[2])
            slope[:, p, k] = [0.125 * (sign[0] * one[1] * one[2]), 0.125 * (one[0] * sign[1] * one[2]), 0.125 * (one[0] * one[1] * sign[2])]
    return value, slope


VALUE, SLOPE = shapes()


def node_coordinates(xyz: np.ndarray) -> np.ndarray:
    """(m, 8, 3) corners -> (m, 27, 3) nodes."""
    return np.einsum("pk,mkc->mpc", VALUE, xyz)


def least_jacobian(xyz: np.ndarray) -> np.ndarray:
    """(m, 8, 3) corners -> the least determinant over the nodes of each; NaN if any is."""
    a, b, c = (np.einsum("pk,mkc->mpc", d, xyz) for d in SLOPE)
    return np.einsum("mpc,mpc->mp", a, np.cross(b, c)).min(1)


def _xyz(v: pa.Array) -> np.ndarray:
    flat = v.flatten()
    return np.stack([flat.field(a).to_numpy() for a in "xyz"], 1).reshape(-1, 8, 3)


def jacobians(elements: DataFrame) -> DataFrame:
    """(pos, elid, min_jac): straight-sided; curves are not applied."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least_jacobian(_xyz(b.column(2))))], ["pos", "elid", "min_jac"])

    return elements.select("pos", "elid", "v").mapInArrow(run, "pos long, elid int, min_jac double")


def jacobian_report(elements: DataFrame) -> DataFrame:
    """One row: least Jacobian of those that are numbers, how many elements have one of 0 or less, the
    first of these (counted from 1, 0 if none), and how many have none that is a number."""
    j, bad = F.col("min_jac"), (F.col("min_jac") <= 0) & ~F.isnan("min_jac")
    return jacobians(elements).agg(F.min(F.when(~F.isnan(j), j)).alias("min_jac"), F.count_if(bad).alias("n_bad"), F.coalesce(F.min(F.when(bad, F.col("pos") + 1)), F.lit(0)).alias("first_bad"), F.count_if(F.isnan(j)).alias("n_nan"))


def node_rows(elements: DataFrame) -> DataFrame:
    """(pos, elid, nodes): 27 points of x, y, z."""

    def run(batches):
        for b in batches:
            g = node_coordinates(_xyz(b.column(2))).reshape(-1, 3)
            points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(g[:, k])) for k in range(3)], list("xyz"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, len(g) + 1, 27, dtype=np.int32)), points)], ["pos", "elid", "nodes"])

    return elements.select("pos", "elid", "v").mapInArrow(run, "pos long, elid int, nodes array<struct<x:double,y:double,z:double>>")


def facet_nodes() -> list[list[int]]:
    """The 9 nodes on each facet."""
    out = []
    for axis, end in ((0, 0), (0, 2), (1, 0), (1, 2), (2, 0), (2, 2)):
        out.append([p for p in range(27) if (p // 3**axis) % 3 == end])
    return out


def facet_labels(mesh: Mesh) -> DataFrame:
    """(pos, facet from 0, label) of labelled facets; the last record of a facet wins."""
    at = mesh.elements.select("pos", F.col("elid").alias("e"))
    z = mesh.zones.where(F.col("t") == LABELLED).join(at, "e")
    return z.groupBy("pos", (F.col("f") - 1).alias("facet")).agg(F.max_by("p_f", "rec").alias("label"))


def zone_field(mesh: Mesh) -> DataFrame:
    """(pos, elid, nodes, scalar): at each node the highest label of the facets it is on, else 0."""
    on = F.array(*(F.array(*(F.lit(int(p in nodes)) for p in range(27))) for nodes in facet_nodes()))
    per = facet_labels(mesh).groupBy("pos").agg(F.collect_list(F.struct("facet", "label")).alias("marks"))
    value = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda p: F.aggregate(F.coalesce("marks", F.array()), F.lit(0), lambda top, m: F.greatest(top, on[m["facet"]][p] * m["label"])).cast("float"))
    return node_rows(mesh.elements).join(per, "pos", "left").select("pos", "elid", "nodes", value.alias("scalar"))
