"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is its windows of 13 consecutive words. A window is a set of overlapping shingles of 3
words, and a text contains the window only if it contains all of them: an overlap of the whole set needs
a prefix of one shingle. Shingles are ordered by rarity, counted over all documents, and the
prefix of a window is its rarest. Documents are scanned for prefix shingles; a match gives the one place
where the window can stand (positional bound), which must lie inside the text (length bound), and the
window's own hash is compared there, and then its words. Windows that stand there make their words hit.

The benchmark is dealt in blocks of at most `block_bytes` of text, read one at a time, so what is held and broadcast is bounded, and
documents are read once to count and once to join for each block; a benchmark of one block, as here, needs
two reads.

Defined results: null, empty and wordless texts have no words, no hits and are not contaminated; items
without words never occur; items with equal texts all count; a null item_id is not listed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, Work, flat, pieces, row_key, table, without

WINDOW, SHINGLE = 13, 3

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Words:
    """The words of some texts: runs of ASCII letters, digits and all other characters beyond ASCII.
    joined: the words in lower case with a space after each, so that spans of words hash as bytes."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        inside = _IN_WORD[body]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        cut = np.zeros(len(body) + 1, bool)
        cut[offsets] = True
        begin = np.flatnonzero((edge == 1)[:-1] | (inside & cut[:-1]))
        end = np.flatnonzero((edge == -1)[1:] | (inside & cut[1:])) + 1
        size = end - begin
        self.first = np.searchsorted(begin, offsets)  # of each text, in words
        self.n = np.diff(self.first)
        last = np.cumsum(size + 1) if len(size) else np.zeros(0, np.int64)
        self.start, self.end = last - size - 1, last - 1
        self.joined = np.full(int(last[-1]) if len(last) else 0, 32, np.uint8)
        if len(size):
            keep = inside.copy()
            self.joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOW[body[keep]]
        self.spans = Spans(self.joined)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of every run of k words that lies in one text."""
        text = np.repeat(np.arange(len(self.n)), self.n)
        at = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1]) if len(text) >= k else np.zeros(0, np.int64)
        return at, text[at], self.spans.hash(self.start[at], self.end[at + k - 1])

    def run(self, at: int, k: int) -> bytes:
        return self.joined[self.start[at] : self.end[at + k - 1]].tobytes()


class Benchmark:
    """Windows of a block of items: distinct word sequences, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        body, offsets = flat(pa.array([t or "" for _, t in items], pa.large_string()))
        words, seen = Words(body, offsets), {}
        for i, n in enumerate(words.n):
            k = min(WINDOW, int(n))
            for at in range(words.first[i], words.first[i] + n - k + 1) if k else ():
                seen.setdefault((words.run(at, k), k), set()).add(i)
        self.items = [x for x, _ in items]
        self.texts = [x for x, _ in seen]
        self.owners = [sorted(v) for v in seen.values()]
        self.length = np.array([k for _, k in seen], np.int64)
        self.prefix = np.zeros(len(seen), np.uint64)
        self.offset = np.zeros(len(seen), np.int64)
        body, offsets = flat(pa.array(self.texts, pa.large_binary()))
        self.words = Words(body, offsets)
        self.hash = self.words.spans.hash(self.words.start[self.words.first[:-1]], self.words.end[self.words.first[1:] - 1]) if seen else np.zeros(0, np.uint64)

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length (3, or fewer for shorter items): (window, offset in it, hash)."""
        out = {}
        for k in sorted({min(SHINGLE, int(x)) for x in self.length}):
            at, of, h = self.words.grams(k)
            own = np.minimum(self.length[of], SHINGLE) == k
            out[k] = of[own], (at - self.words.first[of])[own], h[own]
        return out

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; ties go to the earlier."""
        self.by = {}
        for k, (of, at, h) in self.shingles().items():
            rare = np.array([counts.get((k, int(x)), 0) for x in h.view(np.int64)])
            rank = np.lexsort((at, rare, of))
            first = rank[np.flatnonzero(np.diff(of[rank], prepend=-1))]
            self.prefix[of[first]], self.offset[of[first]] = h[first], at[first]
            own = of[first][np.argsort(h[first], kind="stable")]
            self.by[k] = own, self.prefix[own]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, window) of every occurrence."""
        got = []
        for k, (own, prefix) in self.by.items():
            at, text, h = words.grams(k)
            low, high = np.searchsorted(prefix, h, "left"), np.searchsorted(prefix, h, "right")
            some = np.flatnonzero(high > low)
            many = (high - low)[some]
            row = np.repeat(some, many)
            window = own[np.repeat(low[some], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            begin = at[row] - self.offset[window]
            inside = (begin >= words.first[text[row]]) & (begin + self.length[window] <= words.first[text[row] + 1])
            row, window, begin = row[inside], window[inside], begin[inside]
            same = words.spans.hash(words.start[begin], words.end[begin + self.length[window] - 1]) == self.hash[window]
            for r, w, b in zip(row[same], window[same], begin[same]):
                if words.run(b, int(self.length[w])) == self.texts[w]:
                    got.append((text[r], b, w))
        out = np.array(sorted(got), np.int64).reshape(-1, 3)
        return out[:, 0], out[:, 1], out[:, 2]


def _counts(docs: DataFrame, block: Benchmark) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents; as many rows as the block has."""
    wanted = {k: np.unique(h) for k, (_, _, h) in block.shingles().items()}
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        total = {k: np.zeros(len(h), np.int64) for k, h in shared.value.items()}
        for b in batches:
            body, offsets = flat(b.column(0))
            for i, j in pieces(offsets):
                words = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, h in shared.value.items():
                    own = words.grams(k)[2]
                    at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                    total[k] += np.bincount(at[h[at] == own], minlength=len(h))
        for k, n in total.items():
            some = n > 0
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(int(some.sum()), k, np.int32)), "h": pa.array(shared.value[k][some].view(np.int64)), "n": pa.array(n[some])})

    rows = docs.select("text").mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    return {(r.k, r.h): r.n for r in rows}


def _scan(docs: DataFrame, block: Benchmark, work: Work) -> DataFrame:
    """(doc_id, n_words, starts, ends, items): the hit spans in words, merged, and the items found."""
    block.order(_counts(docs, block))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own = shared.value
        for b in batches:
            body, offsets = flat(b.column(1))
            n, spans, items = np.zeros(b.num_rows, np.int64), [()] * b.num_rows, [()] * b.num_rows
            for i, j in pieces(offsets):
                words = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n[i:j] = words.n
                text, begin, window = own.hits(words)
                for t in np.unique(text):
                    rows = text == t
                    at = begin[rows] - words.first[t]
                    spans[i + t] = merged(list(zip(at.tolist(), (at + own.length[window[rows]]).tolist())))
                    items[i + t] = sorted({str(own.items[x]) for w in set(window[rows].tolist()) for x in own.owners[w] if own.items[x] is not None})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array([[x for x, _ in s] for s in spans], pa.list_(pa.int64())), pa.array([[y for _, y in s] for s in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "starts", "ends", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_bytes: int):
    own, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        own.append((r.i, r.text))
        size += len(r.text or "")
        if size >= block_bytes:
            yield Benchmark(own)
            own, size = [], 0
    if own:
        yield Benchmark(own)


def find(docs: DataFrame, items: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """A row per document: doc_id, n_words, starts and ends of the hit spans in words, and items. One block of
    the benchmark is held at a time."""
    work, blocks = Work(docs.sparkSession), _blocks(items, block_bytes)
    block, more = next(blocks, Benchmark([])), next(blocks, None)
    if more is None:
        return _scan(docs, block, work)
    keyed = work.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "docs")
    every = None
    while block is not None:
        part = work.save(_scan(keyed.select(F.col("row").alias("doc_id"), "text"), block, work), "block")
        every = part if every is None else every.union(part)
        block, more = more, next(blocks, None) if more is not None else None
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    joined = every.groupBy(F.col("doc_id").alias("row")).agg(F.first("n_words").alias("n_words"), pairs.alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = keyed.select("row", "doc_id").join(joined, "row").select("doc_id", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")

    def merge(batches):
        for b in batches:
            spans = [merged(list(zip(x, y))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            both = [pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *both, b.column(4)], ["doc_id", "n_words", "starts", "ends", "items"])

    return rows.mapInArrow(merge, "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>")


def judge(found: DataFrame, *more: str) -> DataFrame:
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    out = found.select("*", hit.alias("n_hit"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a whole window of 13 words of the benchmark occurs, however long they are, and those
    of which a twentieth or more of the words is hit, by shorter items too. Only keys of rows, a small part, meet the
    texts again. Defined results: null, empty and wordless texts stay; rows are judged one by one, whatever their doc_id,
    null or repeated; rows equal in doc_id and text go together. Extra columns of any name pass through. An
    empty table stays empty; with an empty benchmark all rows stay."""
    own = docs.select(row_key().alias("doc_id"), "text")
    found = judge(find(own, table(spark, sf_dir, "benchmark")), "starts", "ends")
    whole = F.exists(F.arrays_zip("starts", "ends"), lambda x: x["ends"] - x["starts"] >= WINDOW)
    bad = found.where(F.col("contaminated") | whole).select("doc_id").distinct()
    return without(docs, Work(spark).save(bad, "bad"))


# Independent of the operator: every run of 13 words is listed and looked up as text.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
o AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
