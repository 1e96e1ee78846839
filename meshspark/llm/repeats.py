"""Exact repeats: every byte covered by a string of `length` bytes that also starts anywhere else.

No suffix array can hold all texts at once, so equal strings are first brought together. A string's anchor
is its leftmost 32-byte gram of least hash; equal strings have equal anchors at equal places. Anchors are
counted by their hash, in all texts: a string whose anchor is alone is alone. Where an anchor's
whole surroundings (all bytes of all strings around it) occur twice, every string there is a repeat. What
is left are anchors that occur in different surroundings: the strings that have such an anchor are
gathered by its hash and sorted in a suffix array.

The suffix array is built by two-stage sorting: only suffixes smaller than their successors are sorted
directly; a scan over the buckets of first bytes, in ascending order, induces all others. Then
the common prefixes of neighbours tell the repeats. Suffixes longer than needed are never compared: a
gathered piece ends where its last string ends.

An anchor of more than `hot` different surroundings would bring too many pieces into one task. Its pieces are
cut into units of 32 neighbouring strings, which go by the 169 bytes that all strings of a unit share: equal strings are at
equal places in units of equal such bytes. Units of equal bytes are repeats; one of each kind is sorted beside the
others of its 169 bytes, as above. Where even those are of more than `hot` kinds, they are cut again, into units of 6 strings
and then of one, whose bytes are its key. Units are told apart by their bytes; only surroundings that recur whole are
told by two 64-bit hashes, the anchor's and theirs.

Defined results: a null text is empty. Rows that repeat a doc_id and text are documents of their own, and
so repeats of each other. Texts shorter than `length` lose nothing. Strings never cross documents. Of neighbours with
equal least grams the leftmost is the anchor. A null doc_id stays null and its text is judged like any other. Texts may be of any
length that fits a task's memory about forty times over. Columns other than doc_id and text are not read. An
empty table gives no rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, Work, flat, pieces, table

LENGTH, GRAM, UNITS = 200, 32, (32, 6, 1)


def _slide(x: np.ndarray, w: int, by) -> np.ndarray:
    """by (minimum or maximum) of each run of w values."""
    n, width = len(x) - w + 1, 1
    while 2 * width <= w:
        x, width = by(x[:-width], x[width:]), 2 * width
    return by(x[:n], x[w - width : w - width + n])


class Anchors:
    """The anchors of some texts, and what is needed around them."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, length: int):
        self.length, self.w = length, length - GRAM + 1
        self.spans, self.offsets = Spans(body), offsets
        n = len(body)
        self.text, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < length:
            return
        start = np.arange(n - GRAM + 1)
        self.h = self.spans.hash(start, start + GRAM)
        end = np.repeat(offsets[1:], np.diff(offsets))  # of each byte's text
        whole = start[: n - length + 1] + length <= end[: n - length + 1]
        low = np.where(whole, _slide(self.h, self.w, np.minimum), np.uint64(0))
        edge = np.zeros(self.w - 1, np.uint64)
        self.at = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), self.w, np.maximum) == self.h) & (start + GRAM <= end[: len(start)]))
        self.text = np.searchsorted(offsets, self.at, "right") - 1

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of all bytes of all strings that hold the anchor."""
        low = np.maximum(self.offsets[self.text], self.at - self.w + 1)
        high = np.minimum(self.offsets[self.text + 1], self.at + self.length)
        return low, high, self.spans.hash(low, high) ^ (self.at - low).astype(np.uint64)

    def strings(self, at: int, text: int) -> tuple[int, int]:
        """First and last start of the strings whose own anchor this is."""
        low, high = max(int(self.offsets[text]), at - self.w + 1), min(at, int(self.offsets[text + 1]) - self.length)
        before = np.flatnonzero(self.h[low:at] <= self.h[at])
        after = np.flatnonzero(self.h[at + 1 : high + self.w] < self.h[at])
        if len(before):
            low += int(before[-1]) + 1
        if len(after):
            high = min(high, at + 1 + int(after[0]) - self.w)
        return low, high


def suffix_order(text: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffixes of the pieces, in order. text: pieces of values over 0, each followed by a 0 at ends;
    starts: how many suffixes of each piece are wanted, from its first. Others may be among them."""
    n = len(text)
    first = np.concatenate([[0], ends[:-1] + 1])
    change = np.concatenate([np.flatnonzero(np.diff(text)) + 1, [n]])
    run = np.searchsorted(change, np.arange(n), "right")  # next place of another value
    after = change[run]
    small = (after < n) & (text[np.minimum(after, n - 1)] > text)  # smaller than its successor
    small[ends] = True
    at = np.flatnonzero(small)
    last = at[np.searchsorted(at, first + starts)]  # all others that are wanted lead to one up to this
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted[:n]) > 0
    raw, stop = text.astype(np.uint8).tobytes() if text.max(initial=0) < 256 else None, np.repeat(ends, np.diff(np.concatenate([first, [n]])))
    direct = np.flatnonzero(small & wanted)
    if raw is None:
        wide = text.astype(">u2").tobytes()
        keys = [wide[2 * i : 2 * j] for i, j in zip(direct.tolist(), stop[direct].tolist())]
    else:
        keys = [raw[i:j] for i, j in zip(direct.tolist(), stop[direct].tolist())]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    del keys
    cut = np.searchsorted(text[direct], np.arange(258))
    large, out, waiting = wanted & ~small, [], [[] for _ in range(258)]

    def before(own: np.ndarray) -> np.ndarray:
        back = own[own > 0] - 1
        return back[large[back]]

    for c in range(257):
        mine, level = [], np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        later = []
        while len(level):
            mine.append(level)
            back = before(level)
            level = back[text[back] == c]
            later.append(back[text[back] > c])
        own = direct[cut[c] : cut[c + 1]]
        mine.append(own)
        back = before(own)
        later.append(back[text[back] > c])
        out += mine
        back = np.concatenate(later)
        if len(back):
            back = back[np.argsort(text[back], kind="stable")]
            edge = np.flatnonzero(np.diff(text[back])) + 1
            for part in np.split(back, edge):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def repeated(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts in it of the strings that occur twice or more in all pieces."""
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(size + 1) - 1
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
    text[ends] = 0
    starts = size - length + 1
    first = ends - size
    order = suffix_order(text, ends, starts)
    piece = np.searchsorted(ends, order)
    mask = order - first[piece] < starts[piece]
    order = order[mask]
    spans = Spans(text.astype(np.uint8))
    h = spans.hash(order, order + length)
    twice, step = np.zeros(len(order), bool), np.arange(length)
    near = np.flatnonzero(h[1:] == h[:-1])
    for i in range(0, len(near), 20_000):
        k = near[i : i + 20_000]
        same = k[(text[order[k, None] + step] == text[order[k + 1, None] + step]).all(1)]
        twice[same] = twice[same + 1] = True
    hit = np.sort(order[twice])
    return [hit[a:b] - f for a, b, f in zip(np.searchsorted(hit, first), np.searchsorted(hit, ends), first)]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal ones; touching spans are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), body.alias("body")).withColumn("t", F.xxhash64("body"))


def _anchors(docs: DataFrame, length: int, bare: bool = False) -> DataFrame:
    """(h) or (h, around, d, t, p): every anchor; around is the hash of its surroundings."""

    def run(batches):
        for b in batches:
            body, offsets = flat(b.column(1))
            d, t = b.column(0), b.column(2).to_numpy()
            for i, j in pieces(offsets):
                a = Anchors(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                if len(a.at):
                    h = pa.array(a.h[a.at].view(np.int64))
                    if bare:
                        yield pa.RecordBatch.from_arrays([h], ["h"])
                    else:
                        yield pa.RecordBatch.from_arrays([h, pa.array(a.around()[2].view(np.int64)), d.take(pa.array(i + a.text)), pa.array(t[i + a.text]), pa.array(a.at - a.offsets[a.text])], ["h", "around", "d", "t", "p"])

    return _keyed(docs).mapInArrow(run, "h long" if bare else "h long, around long, d long, t long, p long")


def _units(parts: DataFrame, length: int, size: int, unit: int) -> DataFrame:
    """(d, t, h, s, o, body): units of `unit` strings of pieces of up to `size` strings that share a core of bytes.
    o: where in the body the core begins; strings begin there or up to size - 1 bytes before."""
    each = parts.select("d", "t", "h", "s", "o", "body", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // unit))).alias("j"))
    each = each.withColumn("core", F.col("o") - F.col("j") * unit)
    low, high = F.greatest(F.lit(0), F.col("core") - unit + 1), F.least(F.col("core"), F.octet_length("body") - length)
    each = each.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high")
    key = F.xxhash64("h", "j", F.substring("body", F.col("core").cast("int") + 1, F.lit(length - unit + 1)))
    return each.select("d", "t", key.alias("h"), (F.col("s") + F.col("low")).alias("s"), (F.col("core") - F.col("low")).alias("o"), F.substring("body", F.col("low") + 1, F.col("high") - F.col("low") + length).alias("body"))


def spans(docs: DataFrame, work: Work, length: int = LENGTH, hot: int = 2000, task_bytes: int = 3 << 19) -> DataFrame:
    """(d, t, starts, ends): the repeated spans of each document that has any, in bytes. d is its doc_id,
    t the hash of its text."""
    # a saved table under each join, so that Spark can split a hot key: it can't where a side still aggregates
    twice = work.save(_anchors(docs, length, bare=True).groupBy("h").count().where("count > 1").select("h"), "twice")
    some = work.save(_anchors(docs, length).join(twice, "h"), "anchors")
    work.release()
    kinds = work.save(some.groupBy("h", "around").agg(F.count("*").alias("n"), F.min(F.xxhash64("d", "t", "p")).alias("shown")), "kinds")
    many = work.save(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "many")
    told = work.save(kinds.join(many, "h").where("n > 1 or kinds > 1"), "told")
    flagged = some.join(told, ["h", "around"]).withColumn("sort", (F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("shown") == F.xxhash64("d", "t", "p"))))
    per = work.save(flagged.where("n > 1 or sort").groupBy("d", "t").agg(F.collect_set(F.struct("p", (F.col("n") > 1).alias("full"), "sort", (F.col("kinds") > hot).alias("hot"))).alias("a")), "per")
    work.drop(some)
    work.drop(kinds)
    work.release()

    def around(batches):
        for b in batches:
            out = {k: [] for k in ("d", "t", "starts", "ends", "pieces")}
            marks = b.column(3)
            cut, held = marks.offsets.to_numpy() - marks.offsets[0].as_py(), marks.flatten()
            place, *flags = (held.field(k).to_numpy(zero_copy_only=False) for k in ("p", "full", "sort", "hot"))
            for k, (d, t, body) in enumerate(zip(b.column(0), b.column(1), b.column(2))):
                text = np.frombuffer(body.as_buffer(), np.uint8)
                a, rows = Anchors(text, np.array([0, len(text)]), length), slice(cut[k], cut[k + 1])
                p, (full, sort, hot_) = place[rows], (f[rows] for f in flags)
                low, high, _ = a.around()
                at = np.searchsorted(a.at, p[full])
                starts, ends = joined(low[at], high[at])
                own = []
                for q, many in sorted(zip(p[sort].tolist(), hot_[sort].tolist())):
                    x, y = a.strings(q, 0)
                    if y >= x:
                        own.append({"h": int(a.h[q].view(np.int64)), "s": x, "o": q - x, "body": text[x : y + length].tobytes(), "hot": many})
                for name, v in zip(out, (d.as_py(), t.as_py(), starts.tolist(), ends.tolist(), own)):
                    out[name].append(v)
            piece = pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int64()), ("o", pa.int64()), ("body", pa.binary()), ("hot", pa.bool_())]))
            types = {"d": pa.int64(), "t": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "pieces": piece}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in out.items()})

    texts = _keyed(docs).alias("x").join(per.alias("y"), F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.t") == F.col("y.t"))).select("x.d", "x.t", "body", "a")
    found = work.save(texts.mapInArrow(around, "d long, t long, starts array<long>, ends array<long>, pieces array<struct<h:long,s:long,o:long,body:binary,hot:boolean>>"), "found")
    work.release()

    def sort(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        hits = repeated(whole["body"].to_pylist(), length)
        starts, ends, keep = [], [], []
        for k, (s, hit) in enumerate(zip(whole["s"].to_pylist(), hits)):
            if len(hit):
                a, b = joined(s + hit, s + hit + length)
                starts.append(a)
                ends.append(b)
                keep.append(k)
        if keep:
            rows = whole.select(["d", "t"]).take(pa.array(keep)).combine_chunks()
            yield pa.RecordBatch.from_arrays([rows["d"].chunk(0), rows["t"].chunk(0), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["d", "t", "starts", "ends"])

    gathered = found.where("size(pieces) > 0").select("d", "t", F.explode("pieces").alias("p")).select("d", "t", "p.*")
    cut, copies, crowded, size = gathered.where("not hot"), [found.where("size(starts) > 0").select("d", "t", "starts", "ends")], gathered.where("hot"), length - GRAM + 1
    cut = cut.select("d", "t", "h", "s", "body")
    for unit in UNITS:
        if not crowded.limit(1).count():
            break
        parts = work.save(_units(crowded, length, size, unit), "units")
        alike = work.save(parts.groupBy("h", "body").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "s", "o")).alias("one")), "alike")
        crowd = work.save(alike.groupBy("h").agg(F.count("*").alias("kinds")), "crowd")
        told = work.save(alike.join(crowd, "h").where("n > 1 or kinds > 1").select("h", "body", "n", "kinds", "one.*"), "told")
        copies.append(parts.join(told.where("n > 1").select("h", "body"), ["h", "body"]).select("d", "t", F.array("s").alias("starts"), F.array(F.col("s") + F.octet_length("body")).alias("ends")))
        last = unit == UNITS[-1]  # of one string there is one kind, but for keys that collide
        cut = cut.union(told.where("kinds > 1" if last else (F.col("kinds") > 1) & (F.col("kinds") <= hot)).select("d", "t", "h", "s", "body"))
        crowded, size = told.where(F.col("kinds") > hot), unit
    total = cut.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    sorted_ = cut.repartition(max(1, math.ceil(total / task_bytes)), "h").mapInArrow(sort, "d long, t long, starts array<long>, ends array<long>")
    every = reduce(DataFrame.union, copies).union(sorted_)
    both = work.save(every.groupBy("d", "t").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "spans")
    work.drop(found)
    work.release()
    return both


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per document: doc_id, n_bytes, starts and ends of the maximal removed runs, and kept, the
    remaining bytes."""
    work = Work(docs.sparkSession)
    found = spans(docs, work, length)

    def cut(batches):
        for b in batches:
            starts, ends, kept, size = [], [], [], []
            for body, s, e in zip(b.column(1), b.column(2), b.column(3)):
                text = body.as_buffer().to_pybytes()
                a, z = joined(*(np.array(v.as_py() or [], np.int64) for v in (s, e)))
                edges = [0, *np.stack([a, z], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
                starts.append(a)
                ends.append(z)
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    rows = _keyed(docs).alias("x").join(found.alias("y"), F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.t") == F.col("y.t")), "left").select("x.d", "body", "starts", "ends")
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Independent of the operator: every string of 200 bytes is listed and counted.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS g FROM d, LATERAL (SELECT unnest(range(0, len(x) // 2 - 199)) AS i)),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS f FROM s SEMI JOIN m USING (g)),
k AS (SELECT r, i, sum(f) OVER (PARTITION BY r ORDER BY i) AS k FROM p),
u AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY r, k),
v AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM u),
w AS (SELECT r, count(*) AS n, sum(z - a) AS c, max(z) AS z, string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS y FROM v JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN w USING (r)
"""
