"""What a mesh must satisfy. `violations` counts what is wrong, one aggregation for each section of the mesh;
`validate` refuses a mesh that has any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELLED, MOST_LABELS, PERIODIC, Mesh, MeshError

MESSAGES = {
    "zone type": "zone record {at} has an implausible type (valid: 1..7)",
    "zone place": "zone record {at} references an element or facet outside [1,{n}]x[1,6]",
    "zone partner": "periodic zone record {at} references a partner element or facet out of range",
    "zone label": "labelled zone record {at} has a label outside [1,{most}]",
    "curve element": "curve record {at} references an element outside [1,{n}]",
    "curve type": "curve record {at} has an unknown edge type (valid: 0, 3 and 4)",
    "element id": "element record {at} has an id outside [1,{n}]",
    "element ids": "element ids are not a permutation of 1..{n} (duplicate or missing id)",
}


def _rows(table: DataFrame, place: str, **bad) -> DataFrame:
    """(violation, n, first) from conditions: how many records, and the least place of one, from 1."""
    columns = [x for k, c in bad.items() for x in (F.count_if(c).alias(f"n_{k}"), F.min(F.when(c, F.col(place) + 1)).alias(f"first_{k}"))]
    each = F.array(*(F.struct(F.lit(k.replace("_", " ")).alias("violation"), F.col(f"n_{k}").alias("n"), F.col(f"first_{k}").alias("first")) for k in bad))
    return table.agg(*columns).select(F.explode(each).alias("x")).select("x.*")


def violations(mesh: Mesh) -> DataFrame:
    """(violation, n, first): records that break a rule, and the first of them, from 1. Types are 1 to 7; the partner of
    periodic and the label of labelled zones count. Ids that are in range may still repeat: `element ids` counts the
    ids that are missing."""
    n, t = mesh.nelv, F.col("t")

    def out(c, high):
        return ~F.col(c).between(1, high)

    zones = _rows(mesh.zones, "rec", zone_type=~t.between(1, 7), zone_place=out("e", n) | out("f", 6), zone_partner=(t == PERIODIC) & (out("p_e", n) | out("p_f", 6)), zone_label=(t == LABELLED) & out("p_f", MOST_LABELS))
    curves = _rows(mesh.curves, "rec", curve_element=out("e", n), curve_type=F.exists("type", lambda x: ~x.isin(0, 3, 4)))
    ids = _rows(mesh.elements, "pos", element_id=out("elid", n))
    kinds = mesh.elements.where(~out("elid", n)).agg(F.count_distinct("elid").alias("kinds"))
    whole = kinds.select(F.lit("element ids").alias("violation"), (F.lit(n) - F.col("kinds")).alias("n"), F.lit(None).cast("long").alias("first"))
    return reduce(DataFrame.union, (zones, curves, ids, whole))


def _refuse(mesh: Mesh, *names: str) -> None:
    found = {r.violation: r for r in violations(mesh).where("n > 0").collect()}
    for name, text in MESSAGES.items():
        if name in found and name.startswith(names):
            raise MeshError(text.format(at=found[name].first, n=mesh.nelv, most=MOST_LABELS))


def validate_zones(mesh: Mesh) -> None:
    _refuse(mesh, "zone")


def validate_curves(mesh: Mesh) -> None:
    _refuse(mesh, "curve")


def validate_ids(mesh: Mesh) -> None:
    """Element ids are a permutation of 1..nelv."""
    _refuse(mesh, "element")


def validate(mesh: Mesh) -> Mesh:
    _refuse(mesh, "zone", "curve", "element")
    return mesh
