"""The data model: tables of elements, boundary zones and curves, and the constant topology of a hex."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class MeshError(ValueError):
    """A mesh, file or argument that is refused."""


# Corner slots (from 0) of facets 1..6 and of the 12 edges, the map from a converter's face
# number to a facet, the reference-cube corner of each slot, the opposite facet, and the bound on labels.
FACE_SLOTS = ((0, 4, 7, 3), (1, 5, 6, 2), (0, 1, 5, 4), (3, 2, 6, 7), (0, 1, 2, 3), (4, 5, 6, 7))
EDGE_SLOTS = ((0, 1), (2, 3), (4, 5), (6, 7), (0, 3), (1, 2), (4, 7), (5, 6), (0, 4), (1, 5), (3, 7), (2, 6))
FACET_OF_FACE = (3, 2, 4, 1, 5, 6)
SLOT_CORNER = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
OPPOSITE = (2, 1, 4, 3, 6, 5)
MOST_LABELS = 20
MOST_IDS = 2**31 - 1
PERIODIC, LABELLED = 5, 7

# The binary records. Sizes 228, 36 and 532 bytes; 200/100 and 64/32 for the converter's input.
ELEMENT = np.dtype([("elid", "<i4"), ("v", [("idx", "<i4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")], (8,))])
ZONE = np.dtype([("e", "<i4"), ("f", "<i4"), ("p_e", "<i4"), ("p_f", "<i4"), ("g", "<i4", (4,)), ("t", "<i4")])
CURVE = np.dtype([("e", "<i4"), ("data", "<f8", (12, 5)), ("type", "<i4", (12,))])
RE2_ELEMENT = {w: np.dtype([("group", f"<f{w}"), ("x", f"<f{w}", (8,)), ("y", f"<f{w}", (8,)), ("z", f"<f{w}", (8,))]) for w in (4, 8)}
RE2_SIDE = {8: np.dtype([("e", "<f8"), ("side", "<f8"), ("d", "<f8", (5,)), ("t", "S8")]), 4: np.dtype([("e", "<i4"), ("side", "<i4"), ("d", "<f4", (5,)), ("t", "S4")])}
ENDIAN_TAG = 6.54321

CORNER = T.StructType([T.StructField("idx", T.IntegerType()), *(T.StructField(a, T.DoubleType()) for a in "xyz")])
ELEMENTS = T.StructType([T.StructField("pos", T.LongType()), T.StructField("elid", T.IntegerType()), T.StructField("v", T.ArrayType(CORNER))])
ZONES = T.StructType([T.StructField("rec", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("e", "f", "p_e", "p_f")), T.StructField("g", T.ArrayType(T.IntegerType())), T.StructField("t", T.IntegerType())])
CURVES = T.StructType([T.StructField("rec", T.LongType()), T.StructField("e", T.IntegerType()), T.StructField("data", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("type", T.ArrayType(T.IntegerType()))])


@dataclass(frozen=True)
class Mesh:
    """elements (pos, elid, v), zones (rec, e, f, p_e, p_f, g, t) and curves (rec, e, data, type): pos and
    rec are places in the file from 0, elid and e are ids from 1, facets count from 1."""

    nelv: int
    elements: DataFrame
    zones: DataFrame
    curves: DataFrame
    trailing: int = 0

    def with_(self, **changed) -> "Mesh":
        return replace(self, **changed)
