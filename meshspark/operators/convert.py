"""From the converter's input (coordinates, curves, boundary conditions) to a mesh."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bc_type, facet_slot
from ..schema import CURVES, FACET_OF_FACE, LABELLED, MOST_LABELS, PERIODIC, Mesh, MeshError
from ..sources.files import frame_re2, register
from ..store import frame, numbered, pinned
from .topology import dedup_points

# Boundary types whose fifth number is a label, and the slot of each named type; types of
# one slot share a label. 'P' pairs facets; 'E', blank and unknown types are passed over.
USER_TYPES = ("MSH", "msh", "EXO", "exo")
NAMED_SLOT = {"W": 1, "v": 2, "V": 2, "O": 3, "o": 3, "SYM": 4, "sym": 4, "ON": 5, "on": 5, "s": 6, "sl": 6, "sh": 6, "shl": 6, "S": 6, "SL": 6, "SH": 6, "SHL": 6}
PERIODIC_TOLERANCE = 1e-7


def _facet(face):
    return F.element_at(F.array(*map(F.lit, FACET_OF_FACE)), face.cast("int"))


def validate_input(nelv: int, elements: DataFrame, curves: DataFrame, bcs: DataFrame) -> None:
    finite = F.forall("v", lambda c: F.abs(c["x"]).between(0, 1.7976931348623157e308) & F.abs(c["y"]).between(0, 1.7976931348623157e308) & F.abs(c["z"]).between(0, 1.7976931348623157e308))
    nan = F.exists("v", lambda c: F.isnan(c["x"]) | F.isnan(c["y"]) | F.isnan(c["z"]))
    if elements.where(~finite | nan).limit(1).count():
        raise MeshError("non-finite coordinate")
    for name, table, most in (("curve", curves, 12), ("boundary condition", bcs, 6)):
        bad = table.where(~F.col("e").between(1, nelv) | ~F.col("side").between(1, most)).agg(F.min("rec")).first()[0]
        if bad is not None:
            raise MeshError(f"{name} record {bad + 1} references an element or side out of range")


def classify_bcs(bcs: DataFrame, nelv: int) -> tuple[DataFrame, DataFrame]:
    """(labels, pairs). labels (seq, e, f, label) in the order in which records are met: those of user types,
    then named ones; a named slot's label is its rank by first record, after the largest user label.
    pairs (rec, e, f, p_e, p_f) of periodic facets."""
    t = F.col("type")
    rows = pinned(bcs.select("rec", "e", "side", "d", bc_type(F.col("t")).alias("type")))
    slot = F.coalesce(*(F.when(t.isin([n for n, s in NAMED_SLOT.items() if s == k]), k) for k in range(1, 7)))
    top = rows.where(t.isin(*USER_TYPES)).agg(F.max(F.col("d")[4].cast("long"))).first()[0]
    offset = max(0, top or 0)
    named = rows.withColumn("slot", slot).where(F.col("slot").isNotNull() & ~t.isin(*USER_TYPES))
    firsts = sorted((r.first, r.slot) for r in named.groupBy("slot").agg(F.min("rec").alias("first")).collect())  # six rows at most
    label_of = F.coalesce(*(F.when(F.col("slot") == s, offset + k + 1) for k, (_, s) in enumerate(firsts)), F.lit(0))
    user = rows.where(t.isin(*USER_TYPES)).select("rec", F.lit(0).alias("pass"), "e", _facet(F.col("side")).alias("f"), F.col("d")[4].cast("long").alias("label"))
    both = user.union(named.select("rec", F.lit(1).alias("pass"), "e", _facet(F.col("side")).alias("f"), label_of.cast("long").alias("label")))
    bad = both.where(~F.col("label").between(1, MOST_LABELS)).agg(F.min("label"), F.count("*")).first()
    if bad[1]:
        raise MeshError(f"boundary label out of [1,{MOST_LABELS}]: {bad[0]}")
    labels = both.select((F.col("pass") * F.lit(1 << 40) + F.col("rec")).alias("seq"), F.col("e").cast("int").alias("e"), "f", F.col("label").cast("int").alias("label"))
    pairs = rows.where(t == "P").select("rec", F.col("e").cast("int").alias("e"), _facet(F.col("side")).alias("f"), F.col("d")[0].cast("long").alias("p_e"), F.col("d")[1].cast("long").alias("side"))
    if pairs.where(~F.col("p_e").between(1, nelv) | ~F.col("side").between(1, 6)).limit(1).count():
        raise MeshError("periodic boundary condition references partner element or face out of range")
    return labels, pairs.select("rec", "e", "f", F.col("p_e").cast("int").alias("p_e"), _facet(F.col("side")).alias("p_f"))


def match_corners(elements: DataFrame, pairs: DataFrame, tolerance: float = PERIODIC_TOLERANCE) -> DataFrame:
    """(rec, k, a, b): for corner k of each paired facet its point a, and the point b of the partner facet
    that stands where a does after the mean shift between the facets. elements is (pos, v, vid)."""

    def side(element: str, facet: str, name: str) -> DataFrame:
        at = elements.select((F.col("pos") + 1).cast("int").alias(element), "v", "vid")
        c = F.array(*(F.struct(F.lit(k).alias("k"), F.col("vid")[facet_slot(F.col(facet), k)].alias("id"), *(F.col("v")[facet_slot(F.col(facet), k)][a].alias(a) for a in "xyz")) for k in range(4)))
        return pairs.join(at, element).select("rec", c.alias(name))

    both = side("e", "f", "i").join(side("p_e", "p_f", "j"), "rec")

    def mean(a):
        return F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, k: s + (F.col("i")[k][a] - F.col("j")[k][a])) / 4

    both = both.select("rec", "j", *(mean(a).alias(f"l{a}") for a in "xyz"), F.explode("i").alias("c"))

    def far(a):
        return lambda x: (F.col("c")[a] - x[a] - F.col(f"l{a}")) * (F.col("c")[a] - x[a] - F.col(f"l{a}"))

    hits = F.filter("j", lambda x: F.sqrt(far("x")(x) + far("y")(x) + far("z")(x)) < tolerance)
    found = pinned(both.select("rec", "c.k", F.col("c.id").alias("a"), hits.alias("hits")))
    bad = found.where(F.size("hits") != 1).agg(F.min(F.struct("rec", "k", F.size("hits").alias("n")))).first()[0]
    if bad is not None:
        raise MeshError(f"periodic facet corner has {bad.n} matches (expected 1); malformed periodic pairing")
    return found.select("rec", "k", "a", F.col("hits")[0]["id"].alias("b"))


def sweep(matches: DataFrame, most: int = 50_000_000, sweeps: int = 3) -> DataFrame:
    """(vid, pid): what three sweeps over the matches, in file order, make of the points they touch. Each
    match gives both of its points the smaller of their current ids; the number of sweeps and the order are
    part of the format, so this is no search for components. Only boundary corners come to the driver,
    as two integers each; more than `most` are refused."""
    if matches.count() > most:
        raise MeshError(f"more than {most} periodic corners")
    rows = matches.orderBy("rec", "k").select("a", "b").toArrow()
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pid = points.tolist()
    steps = list(zip(at[: len(a)].tolist(), at[len(a) :].tolist()))
    for _ in range(sweeps):
        for x, y in steps:
            pid[x] = pid[y] = min(pid[x], pid[y])
    return frame(matches.sparkSession, list(zip(points.tolist(), pid)), "vid long, pid long")


def aggregate_curves(curves: DataFrame) -> tuple[DataFrame, bool]:
    """(curves by element, whether they were dropped). One row per curved element; the type is the first raw
    byte, C or m, and any other drops all curves; of several records for one edge the last wins."""
    kind = F.substring(F.col("t"), 1, 1)
    rows = curves.select("rec", "e", "side", "d", F.when(kind == F.lit(b"C"), 3).when(kind == F.lit(b"m"), 4).alias("kind"))
    spark = curves.sparkSession
    if rows.where("kind is null").limit(1).count():
        return spark.createDataFrame([], CURVES), True
    last = rows.groupBy("e", "side").agg(F.max_by(F.struct("d", "kind"), "rec").alias("x"))
    per = last.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct(F.col("side").cast("int").alias("side"), "x"))).alias("m"))

    def edges(value, default):
        return F.array(*(F.coalesce(F.col("m")[k][value], default) for k in range(1, 13)))

    wide = per.select(F.col("e").cast("int").alias("e"), edges("d", F.array_repeat(F.lit(0.0), 5)).alias("data"), edges("kind", F.lit(0)).alias("type"))
    return numbered(wide, ["e"], "rec").select("rec", "e", "data", "type"), False


def convert(spark: SparkSession, path: str, tolerance: float = PERIODIC_TOLERANCE, chunk: int = 1 << 18) -> Mesh:
    """The mesh of a re2 file: points by their bits in order of appearance, boundary conditions as zones,
    periodic ids, curves by element. Element and corner order stay as they are."""
    if not tolerance > 0:
        raise MeshError(f"invalid periodic tolerance: {tolerance}")
    register(spark)
    _, nelv, _ = frame_re2(path)
    elements, curves, bcs = (spark.read.format("re2").option("section", s).option("chunk", chunk).load(path) for s in ("elements", "curves", "bcs"))
    validate_input(nelv, elements, curves, bcs)
    flat = elements.select("pos", F.posexplode("v").alias("slot", "c")).select("pos", "slot", "c.*")
    points = dedup_points(flat.select((F.col("pos") * 8 + F.col("slot")).alias("corner"), "bx", "by", "bz"))
    named = flat.join(points, ["bx", "by", "bz"]).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("slot", "vid"))).alias("s"))
    whole = pinned(elements.join(named, "pos").select("pos", "v", F.transform("s", lambda s: s["vid"]).alias("vid")))
    labels, pairs = classify_bcs(bcs, nelv)
    matches = match_corners(whole, pairs, tolerance)
    ids = sweep(matches)
    g = matches.join(ids, F.col("a") == F.col("vid")).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("k", "pid"))).alias("g"))
    periodic = pairs.join(g, "rec").select(F.lit(0).alias("label"), F.col("rec").alias("seq"), "e", "f", "p_e", "p_f", F.transform("g", lambda x: x["pid"].cast("int")).alias("g"), F.lit(PERIODIC).alias("t"))
    labelled = labels.select("label", "seq", "e", "f", F.lit(0).alias("p_e"), F.col("label").alias("p_f"), F.array_repeat(F.lit(0), 4).alias("g"), F.lit(LABELLED).alias("t"))
    zones = numbered(periodic.unionByName(labelled), ["label", "seq"], "rec").select("rec", "e", "f", "p_e", "p_f", "g", "t")
    out = whole.select("pos", (F.col("pos") + 1).cast("int").alias("elid"), F.transform(F.arrays_zip("v", "vid"), lambda x: F.struct(x["vid"].cast("int").alias("idx"), *(x["v"][a].alias(a) for a in "xyz"))).alias("v"))
    return Mesh(nelv, out, zones, aggregate_curves(curves)[0])
