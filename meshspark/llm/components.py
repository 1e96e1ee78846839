"""Connected components of an edge table, without gathering the graph anywhere.

Edges are dealt in chunks of bounded size; each chunk becomes a star forest (every node beside its
smallest reachable node). Large-star and small-star rounds then join the forests until nothing
changes. A graph of one chunk is done after the first contraction."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(nodes):
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def _contract(batches):
    got = [x for x in batches if x.num_rows]
    if got:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in got]) for k in (0, 1))
        node, root = roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], ["a", "b"])


def connected_components(work: Work, edges: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node that node reaches. Nodes that
    are their own root, and those without an edge, have no row. Nulls and loops are ignored."""
    edges = work.save(edges.select("a", "b").where("a <> b"), "edges")
    said = None
    while True:
        n = edges.count()
        forest = edges.repartition(max(1, math.ceil(n / chunk))).mapInArrow(_contract, "a long, b long")
        if n <= chunk:
            return work.save(forest.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
        forest = work.save(forest.distinct(), "forest")
        both = forest.union(forest.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = work.save(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        work.drop(edges)
        edges = work.save(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        was = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(large)
        work.drop(forest)
        if now == was == said:
            return work.save(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
        said = now
