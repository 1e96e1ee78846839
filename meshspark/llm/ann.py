"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

The rotation is learned on a bounded sample (principal axes, then iterative quantization); a vector's code
is the signs of its rotated coordinates. Each part of the table indexes every one of its codes in
`tables` substrings. A query of radius r probes each substring's index with every value within r // tables
bits of its own: by the pigeonhole principle a code within r differs by no more than that in one substring.
Codes found are kept if within r, and their vectors are reranked by cosine in double precision. The radius
starts at the learned one, which holds `reach` of the sample's true neighbours, and grows in a part
until it holds k codes or the whole part, so that no query comes back short. Each part passes on its
best k a query; these meet in one last ranking.

Queries are a stated set and are broadcast in blocks of at most `block` vectors, one block at a time: its best are
written out and the broadcast is dropped before the next.

Scores are sums in the order of the components, of vectors scaled by powers of two, so that equal vectors have equal scores
wherever they stand and no size over- or underflows; matrix products only tell which candidates can be among the best.

Defined results: vectors take no part if null, empty, zero, or of null or non-finite components. Vectors of several lengths
are searched by length, as a cosine needs two of one length. Equal scores go to the smaller vec_id; repeated vec_ids are
candidates each, but a query never finds its own vec_id. A null vec_id takes no part. Other columns are not read. An
empty table gives no rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, table


class Codes:
    """The learned rotation, and the radius that goes with it."""

    def __init__(self, sample: np.ndarray, k: int, reach: float, rounds: int = 30, seed: int = 7):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(0)
        dim = x.shape[1]
        self.bits = -(-dim // 8) * 8
        _, _, axes = np.linalg.svd(x - self.mean, full_matrices=True)
        v = (x - self.mean) @ axes.T
        spin = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(v.T @ np.where(v @ spin > 0, 1.0, -1.0))
            spin = a @ b
        self.turn = axes.T @ spin
        code, near = self.encode(x), []
        for i in range(0, len(x), 10):
            score = x @ x[i]
            score[i] = -2
            best = np.argsort(-score)[:k]
            near += np.bitwise_count(code[best] ^ code[i]).sum(1).tolist()
        self.radius = int(np.quantile(near, reach, method="higher")) if near else 0

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector; rows that fill the last byte are zero."""
        return np.packbits((x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.turn > 0, axis=1)


def _near(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits, by the number of bits set, up to the radius."""
    value = np.arange(1 << bits)
    return value[np.bitwise_count(value) <= radius]


class Index:
    """One part's codes, by the value of each byte."""

    def __init__(self, code: np.ndarray):
        self.code, self.order, self.first = code, [], []
        for t in range(code.shape[1]):
            self.order.append(np.argsort(code[:, t], kind="stable"))
            self.first.append(np.searchsorted(code[self.order[t], t], np.arange(257)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        tables, found = self.code.shape[1], np.zeros(len(self.code), bool)
        masks = _near(8, min(8, radius // tables))
        for t in range(tables):
            probes = int(code[t]) ^ masks
            low, many = self.first[t][probes], self.first[t][probes + 1] - self.first[t][probes]
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            found[self.order[t][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(1) <= radius]


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, summed in the order of the components."""
    total = np.zeros(len(x))
    for c in x.T:
        total += c * c
    return np.sqrt(total)


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those that take part, scaled by powers of two so that the largest component is about one."""
    rows, out = [], []
    for i, v in enumerate(column):
        if v.is_valid and len(v) == dim and not v.values.null_count:
            rows.append(i)
            out.append(v.values.to_numpy().astype(np.float64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    x = np.stack(out)
    top = np.abs(x).max(1)
    fine = np.isfinite(top) & (top > 0)
    return np.array(rows, np.int64)[fine], np.ldexp(x[fine], -np.frexp(top[fine])[1][:, None])


def learn(vectors: DataFrame, dim: int, k: int = 5, sample: int = 2000, reach: float = 0.99) -> Codes | None:
    """Codes from the rows of this length with the `sample` smallest hashes of vec_id."""
    rows = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = _vectors(rows.column(0).combine_chunks(), dim)[1] if rows.num_rows else np.zeros((0, dim))
    return Codes(x, k, reach) if len(x) else None


def _search(vectors: DataFrame, shared, dim: int, k: int, rows: int) -> DataFrame:
    """(query_id, vec_id, score): each part's best for the codes, ids and queries that were broadcast."""

    def best(own: np.ndarray, x: np.ndarray):
        c, qid, q = shared.value
        index, size, qcode, qsize = Index(c.encode(x)), _norms(x), c.encode(q), _norms(q)
        out = []
        for i in range(len(qid)):
            radius, want = c.radius, min(k, int((own != qid[i]).sum()))
            while True:
                at = index.within(qcode[i], radius)
                at = at[own[at] != qid[i]]
                if len(at) >= want or radius >= c.bits:
                    break
                radius = min(c.bits, radius + max(1, c.bits // 16))
            rough = (x[at] @ q[i]) / (size[at] * qsize[i])
            if len(at) > k:  # the k best and all that may tie with the last
                at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
            dot = np.zeros(len(at))
            for a, b in zip(x[at].T, q[i]):
                dot += a * b
            score = dot / (size[at] * qsize[i])
            top = np.lexsort((own[at], -score))[:k]
            out.append((np.full(len(top), qid[i]), own[at[top]], score[top]))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*out)], ["query_id", "vec_id", "score"])

    def run(batches):
        held, n = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                at, x = _vectors(b.column(1), dim)
                if len(at):
                    held.append((b.column(0).to_numpy()[at], x))
                    n += len(at)
            if held and (b is None or n >= rows):
                got = best(*(np.concatenate(y) for y in zip(*held)))
                if got is not None:
                    yield got
                held, n = [], 0

    return vectors.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, rows: int = 50_000) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of vectors (vec_id, embedding) with
    another vec_id. queries has the same columns."""
    spark, work = vectors.sparkSession, Work(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    stated = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    for dim in sorted(r[0] for r in stated.select(F.size("embedding")).distinct().collect()):
        codes = learn(vectors, dim, k)
        rest = iter(stated.where(F.size("embedding") == dim).toLocalIterator(prefetchPartitions=True)) if codes else iter(())
        while some := list(itertools.islice(rest, block)):
            at, x = _vectors(pa.array([r.embedding for r in some], pa.list_(pa.float64())), dim)
            if len(at):
                shared = spark.sparkContext.broadcast((codes, np.array([r.vec_id for r in some])[at], x))
                out = out.union(work.save(_search(vectors, shared, dim, k, rows), "best"))
                shared.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
