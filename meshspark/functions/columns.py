"""Column expressions over corners, facets and element numbers; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EDGE_SLOTS, FACE_SLOTS, MeshError


def corner_ids(v: Column) -> Column:
    """The 8 vertex ids of an element as longs."""
    return F.transform(v, lambda c: c["idx"].cast("long"))


def facets(ids: Column) -> Column:
    """array of (facet, from 0; q, its 4 ids in slot order) from the 8 vertex ids of an element."""
    return F.array(*(F.struct(F.lit(k).alias("facet"), F.array(*(ids[s] for s in slots)).alias("q")) for k, slots in enumerate(FACE_SLOTS)))


def edges(ids: Column) -> Column:
    """array of (lo, hi): the 12 edges of an element, their ids in ascending order."""
    return F.array(*(F.struct(F.least(ids[a], ids[b]).alias("lo"), F.greatest(ids[a], ids[b]).alias("hi")) for a, b in EDGE_SLOTS))


def facet_slot(facet: Column, k: int) -> Column:
    """The slot of corner k of a facet that counts from 1."""
    return F.element_at(F.array(*(F.lit(s[k]) for s in FACE_SLOTS)), facet)


def canonical(q: Column, prefix: str = "k") -> list[Column]:
    """The ids of a facet in ascending order, as plain columns; hashing these needs no array."""
    sorted_ = F.array_sort(q)
    return [sorted_[i].alias(f"{prefix}{i}") for i in range(4)]


def centroid(v: Column, axis: str) -> Column:
    """The mean of the 8 corners, added up in slot order."""
    return F.aggregate(v, F.lit(0.0), lambda s, c: s + c[axis]) / 8


def bc_type(raw: Column) -> Column:
    """A boundary type as text: Latin-1, zero bytes as blanks, white space around it stripped."""
    text = F.translate(F.decode(raw, "ISO-8859-1"), "\0", " ")
    return F.regexp_replace(text, "^[\\s\\x1c-\\x1f\\x85\\xa0]+|[\\s\\x1c-\\x1f\\x85\\xa0]+$", "")


def rank_of_position(pos: Column, n: int, parts: int) -> Column:
    """The rank that owns a record when n records are dealt linearly: the first n % parts ranks have one
    more than the others."""
    if parts < 1:
        raise MeshError("the number of parts must be positive")
    small, more = divmod(n, parts)
    edge = F.lit((small + 1) * more)
    first = F.floor(pos / (small + 1))
    return F.when(pos < edge, first).otherwise(more + F.floor((pos - edge) / max(small, 1))).cast("int")


def share(n: int, parts: int, base: int, many: int) -> int:
    """How many records ranks base to base + many - 1 own together."""
    small, more = divmod(n, parts)
    return many * small + max(0, min(base + many, more) - base)
