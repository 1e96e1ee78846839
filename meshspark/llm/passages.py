"""Near-duplicate passages by compact windows.

A text is the row of its shingles of 5 words. A passage is `width` shingles in a row, the shingles of
`min_words` words. Under a hash function, the passages whose least shingle is the same one form a compact
window: a node of the Cartesian tree over the hashes, of those that span `width` values or more. Over the starts of
passages these nodes are the runs of one sliding minimum, so they are found without building the rest of the tree,
in time that does not depend on its shape. A band is two functions; where a window of one meets a window of the other
(an interval join inside the text), all passages share both least shingles, the key of the run. Two passages with
a Jaccard similarity of s share no band with probability of about (1 - s^2)^bands: of 20,000 lone pairs with one changed word
(0.804) 11 were missed with 8 bands, 78 with 6, 418 with 4. Bands are worked through `wave` at a time, so that the work tables stay those of one wave; after the first, a key whose
runs are all in spans of one class already can tell nothing new and is left.

First the distinct shingles of each 2 MB of texts are brought together, and only passages go on that can reach the
threshold given how many of their shingles occur twice in the table; that loses none, and texts are not read again.

Runs are dealt by their key, packed in arrays; equal runs of one batch of texts go as one. Where the
surroundings of a run (all shingles of its passages) occur twice, all its passages are repeats and need no verification;
that is decided by the key and a 64-bit hash of the shingles beside it. Where a key has several kinds of surroundings, one run
of each kind is gathered with its shingles, and passages that can reach the threshold, given how many of their
shingles are anywhere in the other runs, are verified by the exact similarity of their shingle sets. Overlapping
passages of one text are not compared.

A key with more than `block` kinds of surroundings is dealt into blocks of about `block`, and every two blocks
meet in a group of their own, so no pair is lost; n kinds are sent n / block times each. The search is a probable one, by
the min-hashes, and the same at every size; what it reports is verified.

Rows linked by a reported passage have the same class_id, the smallest doc_id among them.

Defined results: texts of fewer than `min_words` words, null and empty ones have no passages. Rows that
repeat a text are near-duplicates of each other; so are passages that repeat inside one document. A row whose
doc_id is null has its class's id, null where no row of the class has one. Rows that repeat a doc_id are rows of their own. Texts may be
of any length that fits a task's memory about ten times over; extra columns are not read. Ties between least
shingles go to no one: equal values are one value. An empty table gives no rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, Spans, Work, _powers, flat, mix, pieces, table
from .components import connected_components
from .decontaminate import Words
from .repeats import joined

SHINGLE, MIN_WORDS, THRESHOLD, BANDS, WAVE = 5, 50, 0.8, 8, 2


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, own = len(h) - width + 1, 1
    while 2 * own <= width:
        h, own = np.minimum(h[:-own], h[own:]), 2 * own
    return np.minimum(h[:n], h[width - own : width - own + n])


def hashed(h: np.ndarray, function: int) -> np.ndarray:
    """32-bit values of a hash function over mixed 64-bit hashes."""
    odd = np.uint64((int(GOLD) * (2 * function + 3) | 1) & (1 << 64) - 1)
    return ((h ^ (h >> np.uint64(29 + function % 5))) * odd >> np.uint64(32)).astype(np.uint32)


def compact_windows(values: list[np.ndarray], text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, key) of the runs of passages whose least value is the same under every
    function; values: a row for each function, text: the text of each shingle. A run has `width` starts at most."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for v in values:
        key = key << np.uint64(32) | least(v, width).astype(np.uint64)
    whole = text[width - 1 :] == text[:n]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(new)
    new[np.flatnonzero((np.arange(n) - first[np.cumsum(new) - 1]) % width == 0)] = True
    edge = np.flatnonzero(np.concatenate([(new | ~whole)[1:], [True]]))  # last starts of runs
    first = np.flatnonzero(new & whole)
    return first, edge[np.searchsorted(edge, first)], key[first]


def _ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by value, values, where a value begins); equal values stand in the order of their places."""
    if len(h) > 1 << 20:
        pos = np.argsort(h, kind="stable")
    else:  # the place in the low bits; values that differ in these alone may take turns and then begin anew
        low = np.uint64(20)
        v = h >> low << low | np.arange(len(h), dtype=np.uint64)
        v.sort()
        pos = (v & np.uint64((1 << 20) - 1)).astype(np.int64)
    h = h[pos]
    return pos, h, np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)


def _loose(pos: np.ndarray, new: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Whether each shingle is in a passage that has some shingle twice."""
    a, b = pos[:-1][~new[1:]], pos[1:][~new[1:]]
    near = (b - a < width) & (text[a] == text[b])
    a, b = a[near], b[near]
    low = np.maximum(b - width + 1, np.searchsorted(text, text[a], "left"))
    high = np.minimum(a + width, np.searchsorted(text, text[a], "right"))
    n = len(text) + 1
    return np.cumsum(np.bincount(low, minlength=n) - np.bincount(high, minlength=n))[:-1] > 0


def able_starts(held: np.ndarray, loose: np.ndarray, text: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Starts of the passages that can have a near-duplicate. held: shingles that occur twice or more. loose: those
    that occur in a passage with fewer than `width` kinds of shingles. Of `width` kinds a passage shares 2t / (1 + t) at
    least with one of as many, and t with any; all shared ones are held, and loose where the other passage has fewer. Of a
    passage with fewer kinds all shingles are loose, and no more than 1 - t of `width` are not held."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def within(cells: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(cells)])
        return total[width:] - total[:-width]

    able = within(held) >= math.ceil(2 * threshold / (1 + threshold) * width - 1e-9)
    able |= within(held & loose) >= math.ceil(threshold * width - 1e-9)
    return np.flatnonzero(able & (text[width - 1 :] == text[:n]))


def _chunk(batches):
    """Texts in chunks of 2 MB (a longer one alone), compressed, so that they take one place in every later pass."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for b in batches:
        body, offsets = flat(b.column(2))
        for i, j in pieces(offsets, 1 << 21):
            ends, raw = offsets[i : j + 1] - offsets[i], body[offsets[i] : offsets[j]]
            data = pa.compress(raw.tobytes(), "zstd", asbytes=True) if len(raw) else b""
            rows = [pa.array([x.slice(i, j - i).to_pylist()], pa.list_(pa.int64())) for x in (b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *rows, pa.array([ends.astype(np.int64).tobytes()]), pa.array([data])], ["chunk", "ids", "d", "ends", "body"])
            chunk += 1


def _shingles(ends: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the shingles of a chunk."""
    offsets, text, h = np.frombuffer(ends.as_py(), np.int64), [], []
    body = np.frombuffer(pa.decompress(data.as_buffer(), int(offsets[-1]), "zstd"), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    for i, j in pieces(offsets):
        _, of, own = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).grams(SHINGLE)
        text.append(of + i)
        h.append(own)
    return np.concatenate(text), np.concatenate(h)


def _buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where in values in order each bucket begins, by their first 24 bits, and the end."""
    return np.searchsorted(h >> np.uint64(40), (np.arange(buckets + 1) * (1 << 24) // buckets).astype(np.uint64))


def _send(width: int, buckets: int):
    """(bucket, chunk, n, marks): the distinct shingles of each chunk, 32 bits beside those of the bucket, then a
    bit for each that is loose."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                text, h = _shingles(b.column(1)[k], b.column(2)[k])
                if not len(h):
                    continue
                pos, h, new = _ordered(h)
                loose = np.logical_or.reduceat(_loose(pos, new, text, width)[pos], np.flatnonzero(new))
                h = h[new]
                cut, low = _buckets_of(h, buckets), (h >> np.uint64(8)).astype(np.uint32)
                where = np.flatnonzero(np.diff(cut))
                data = [low[x:y].tobytes() + np.packbits(loose[x:y]).tobytes() for x, y in zip(cut[where], cut[where + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(np.full(len(where), b.column(0)[k].as_py())), pa.array(np.diff(cut)[where], pa.int64()), pa.array(data, pa.binary())], ["bucket", "chunk", "n", "marks"])

    return run


def _mark(batches):
    """(chunk, bucket, marks): a bit for each shingle sent that another chunk has sent as well, then one for each that
    is loose in any. Shingles that agree by chance in the bits sent are only marked too often."""
    got = {}
    for b in batches:
        for bucket, chunk, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
            got.setdefault(bucket, []).append((chunk, n, data.as_buffer()))
    while got:
        bucket, sent = got.popitem()
        low = np.concatenate([np.frombuffer(data, np.uint32, n) for _, n, data in sent])
        loose = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=n) for _, n, data in sent])
        v = low.astype(np.uint64) << np.uint64(32) | np.arange(len(low), dtype=np.uint64)
        v.sort()
        at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(v >> np.uint64(32), prepend=np.uint64(1 << 63)))
        size = np.diff(first, append=len(v))
        held, any_ = np.zeros(len(v), bool), np.zeros(len(v), bool)
        held[at] = np.repeat(size > 1, size)
        any_[at] = np.repeat(np.maximum.reduceat(loose[at], first), size)
        cut = np.cumsum([0] + [n for _, n, _ in sent])
        marks = [np.packbits(held[x:y]).tobytes() + np.packbits(any_[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in sent], pa.int64()), pa.array([bucket] * len(sent), pa.int32()), pa.array(marks, pa.binary())], ["chunk", "bucket", "marks"])


def _keep(width: int, threshold: float, buckets: int):
    """(id, s, n, x) of texts with passages that can have a near-duplicate: first shingle and number of shingles of
    each stretch of such passages, and the shingles. Rows come by chunk: its marks by bucket, then its texts."""

    def run(batches):
        marks = {}
        for b in batches:
            for k in range(b.num_rows):
                if not b.column(2)[k].is_valid:
                    marks[b.column(1)[k].as_py()] = b.column(4)[k].as_buffer()
                    continue
                text, h = _shingles(b.column(3)[k], b.column(4)[k])
                mine, marks = marks, {}
                if len(h) < width:
                    continue
                pos, own, new = _ordered(h)
                cut, of = _buckets_of(own[new], buckets), np.cumsum(new) - 1
                held, loose = np.bincount(of) > 1, np.zeros(of[-1] + 1, bool)
                for bucket, data in mine.items():
                    x, y = cut[bucket], cut[bucket + 1]
                    bits = np.frombuffer(data, np.uint8).reshape(2, -1)
                    held[x:y] |= np.unpackbits(bits[0], count=y - x).astype(bool)
                    loose[x:y] = np.unpackbits(bits[1], count=y - x)
                at = np.empty(len(h), np.int64)
                at[pos] = of
                start = able_starts(held[at], loose[at], text, width, threshold)
                if not len(start):
                    continue
                new = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(text[start], prepend=-1) != 0))
                low, high = start[new], start[np.append(new[1:], len(start)) - 1] + width
                first = np.searchsorted(text, text[low])
                rows = np.flatnonzero(np.diff(text[low], prepend=-1))
                ids, s, n, x = b.column(2)[k].as_py(), [], [], []
                for i, j in zip(rows.tolist(), [*rows[1:].tolist(), len(low)]):
                    s.append((low[i:j] - first[i:j]).tobytes())
                    n.append((high[i:j] - low[i:j]).tobytes())
                    x.append(b"".join(h[c:e].tobytes() for c, e in zip(low[i:j].tolist(), high[i:j].tolist())))
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t in text[low[rows]].tolist()], pa.int64()), *(pa.array(v, pa.binary()) for v in (s, n, x))], ["id", "s", "n", "x"])

    return run


def _able(work: Work, chunks: DataFrame, width: int, threshold: float) -> DataFrame:
    """(id, s, n, x): the shingles of all passages that can have a near-duplicate anywhere."""
    size = work.size(chunks)
    buckets = min(1 << 16, max(16, size >> 24))
    sent = chunks.select("chunk", "ends", "body").mapInArrow(_send(width, buckets), "bucket int, chunk long, n long, marks binary")
    marks = work.save(sent.repartition(buckets, "bucket").mapInArrow(_mark, "chunk long, bucket int, marks binary"), "marks")
    work.release()
    none, last = F.lit(None), F.lit((1 << 31) - 1)
    both = marks.select("chunk", "bucket", none.cast("array<long>").alias("ids"), none.cast("binary").alias("ends"), "marks").union(chunks.select("chunk", last, "ids", "ends", "body"))
    dealt = both.repartition(min(1 << 16, max(16, size >> 23)), "chunk").sortWithinPartitions("chunk", "bucket")
    able = work.save(dealt.mapInArrow(_keep(width, threshold, buckets), "id long, s binary, n binary, x binary"), "able")
    work.drop(marks)
    work.release()
    return able


class Sequence(Spans):
    """64-bit hashes of runs of shingles, as those of byte spans."""

    def __init__(self, x: np.ndarray):
        up, self.down = _powers(len(x) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])])


class Stretches:
    """The stretches of some rows: x, their shingles in a row, and of each stretch its first place in x, its row and
    its place in the text."""

    def __init__(self, b: pa.RecordBatch):
        body, self.offsets = flat(b.column(3))
        self.x = np.frombuffer(body.tobytes(), np.uint64)
        (s, of), (n, _) = flat(b.column(1)), flat(b.column(2))
        self.s, self.n = (np.frombuffer(v.tobytes(), np.int64) for v in (s, n))
        self.cut = of // 8  # of each row, in stretches
        self.first = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(of) - 1), np.diff(self.cut))


class Runs:
    """The runs of the stretches of rows i to j in some bands: the row, first shingle in it, passages, key, and a hash of the
    shingles."""

    def __init__(self, every: Stretches, i: int, j: int, width: int, bands: range):
        own = slice(every.cut[i], every.cut[j])
        x = every.x[every.offsets[i] // 8 : every.offsets[j] // 8]
        row, s, n = every.row[own], every.s[own], every.n[own]
        first, stretch, hashes, out = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), Sequence(x), []
        for band in bands:
            a, z, key = compact_windows([hashed(x, 2 * band), hashed(x, 2 * band + 1)], stretch, width)
            of = stretch[a]
            out.append((row[of], s[of] + a - first[of], z - a + 1, mix(key ^ np.uint64((band + 1) * int(GOLD) & (1 << 64) - 1)), hashes.hash(a, z + width)))
        self.row, self.at, self.n, self.key, self.around = (np.concatenate(v) for v in zip(*out))


def kinds_of(key: np.ndarray, around: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order by key, surroundings and row, where in it a key begins, where a kind begins)."""
    order = np.argsort(key)
    tied = np.concatenate([[False], key[order[1:]] == key[order[:-1]]]) if len(key) else np.zeros(0, bool)
    tied[:-1] |= tied[1:]
    some = order[tied]  # few keys recur, and only those need the other columns
    order[tied] = some[np.lexsort((row[some], around[some], key[some]))]
    key, around = key[order], around[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return order, new, new | np.concatenate([[True], around[1:] != around[:-1]]) if len(key) else new


def _deal(able: DataFrame, width: int, bands: range, buckets: int) -> DataFrame:
    """(bucket, own, runs): runs in blobs of key, hash of surroundings, row and place; place holds the first
    shingle, the number of passages, and whether the run recurs in its batch. own: blobs of row, place and row of
    the run that stands for them."""

    def run(batches):
        for turn, b in enumerate(batches):
            stretches, ids, parts = Stretches(b), b.column(0).to_numpy(), []
            for i, j in pieces(stretches.offsets, 1 << 20):
                r = Runs(stretches, i, j, width, bands)
                parts.append(np.stack([r.key, r.around, ids[r.row].view(np.uint64), (r.at << 8 | r.n << 1).astype(np.uint64)]))
            every = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.uint64)
            if not every.shape[1]:
                continue
            order, _, kind = kinds_of(every[0], every[1], every[2])
            every = every[:, order]
            of = np.cumsum(kind) - 1
            own = every[:, kind]
            own[3] |= (np.bincount(of) > 1).astype(np.uint64)
            more = np.stack([every[2, ~kind], every[3, ~kind], own[2, of[~kind]]])
            bucket = own[0] >> np.uint64(40)
            cut = np.searchsorted(bucket, (np.arange(buckets + 1) * (1 << 24) // buckets).astype(np.uint64))
            blobs = [np.ascontiguousarray(own[:, x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])]
            where = [k for k, x in enumerate(blobs) if x]
            mine = [False] * len(where) + [True]
            yield pa.RecordBatch.from_arrays([pa.array(where + [turn % buckets], pa.int32()), pa.array(mine), pa.array([blobs[k] for k in where] + [more.tobytes()], pa.binary())], ["bucket", "own", "runs"])

    return able.select("id", "s", "n", "x").mapInArrow(run, "bucket int, own boolean, runs binary")


def _lists(of: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Values of equal `of`, which is sorted, as lists."""
    cut = np.flatnonzero(np.diff(of, prepend=of[:1] - 1, append=of[-1:] + 1)) if len(of) else np.zeros(1, np.int64)
    return of[cut[:-1]], [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, pa.int64())) for v in values]


def _tell(width: int):
    """Of each bucket of runs: (id, starts, ends) where passages recur as they are, (id, wants, size) of runs that
    are to be compared, (id, other) of rows that share passages."""
    names, long = ["id", "starts", "ends", "wants", "size", "other"], pa.list_(pa.int64())

    def run(batches):
        got, more = [np.zeros((4, 0), np.uint64)], [np.zeros((3, 0), np.uint64)]
        for b in batches:
            for own, blob in zip(b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(blob.as_buffer(), np.uint64)
                (more if own else got).append(x.reshape(3 if own else 4, -1))
        every, more = np.concatenate(got, 1), np.concatenate(more, 1)
        del got
        order, new, kind = kinds_of(every[0], every[1], every[2])
        every = every[:, order]
        of, group = np.cumsum(kind) - 1, np.cumsum(new) - 1
        many = np.bincount(of) + np.bincount(of, (every[3] & np.uint64(1)).astype(float)).astype(np.int64) if len(of) else np.zeros(0, np.int64)
        full = many[of] > 1
        stands = every[2, kind][of]
        row = np.concatenate([every[2, full], more[0]]).view(np.int64)
        place = np.concatenate([every[3, full], more[1]])
        other = np.concatenate([stands[full], more[2]]).view(np.int64)
        if len(row):
            start = (place >> np.uint64(8)).astype(np.int64)
            end = start + (place >> np.uint64(1) & np.uint64(127)).astype(np.int64) + width + SHINGLE - 2
            ids, at = np.unique(row, return_inverse=True)
            wide = int(end.max()) + 1
            a, z = joined(at * wide + start, at * wide + end)
            who, (starts, ends) = _lists(a // wide, a % wide, a % wide + z - a)
            none = pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), starts, ends, pa.nulls(len(who), pa.binary()), none, none], names)
            pair = np.unique(np.stack([row, other])[:, row != other], axis=1)
            none = pa.nulls(pair.shape[1], long)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), none, none, pa.nulls(len(none), pa.binary()), pa.nulls(len(none), pa.int64()), pa.array(pair[1])], names)
        kinds = np.bincount(group[kind]) if len(of) else np.zeros(0, np.int64)
        asked = np.flatnonzero(kind & (kinds[group] > 1)) if len(of) else np.zeros(0, np.int64)
        if len(asked):
            want = np.stack([every[2, asked], every[0, asked], every[3, asked] >> np.uint64(1), kinds[group[asked]].astype(np.uint64), every[2, asked] << np.uint64(1)])
            got = _asked(want, width)
            none = pa.nulls(got.num_rows, long)
            yield pa.RecordBatch.from_arrays([got.column(0), none, none, got.column(1), got.column(2), pa.nulls(got.num_rows, pa.int64())], names)

    return run


def _screen(width: int, buckets: int):
    """Wants of rows in blobs by key: key, row, place, kinds, and what is known: the row's class so far, and
    whether all words of the run are in spans found so far."""

    def run(batches):
        for b in batches:
            parts = []
            for k, (blobs, starts, ends, root) in enumerate(zip(b.column(1), b.column(2), b.column(3), b.column(4).to_pylist())):
                want = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(4, -1) for x in blobs], 1)
                row = b.column(0)[k].as_py()
                covered, low, high = np.zeros(want.shape[1], bool), *(np.array(x.as_py() or [], np.int64) for x in (starts, ends))
                if len(low):
                    at = (want[1] >> np.uint64(7)).astype(np.int64)
                    own = np.searchsorted(low, at, "right") - 1
                    covered = (own >= 0) & (high[np.maximum(own, 0)] >= at + (want[1] & np.uint64(127)).astype(np.int64) + width + SHINGLE - 2)
                known = np.uint64(2 * (row if root is None else root)) + covered.astype(np.uint64)
                parts.append(np.stack([want[0], np.full(len(known), row, np.uint64), want[1], want[2], known]))
            every = np.concatenate(parts, 1)
            bucket = (every[0] >> np.uint64(40)).astype(np.int64) * buckets >> 24
            order = np.argsort(bucket, kind="stable")
            every, bucket = every[:, order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array([np.ascontiguousarray(every[:, x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["bucket", "runs"])

    return run


def _asked(want: np.ndarray, width: int) -> pa.RecordBatch:
    """want: row, key, place, kinds and what is known of runs, as a record (id, wants, size) for each row."""
    want = want[:, np.argsort(want[0], kind="stable")]
    cut = np.flatnonzero(np.concatenate([[True], want[0, 1:] != want[0, :-1], [True]]))
    blobs = [np.ascontiguousarray(want[1:, x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])]
    size = np.add.reduceat((want[2] & np.uint64(127)).astype(np.int64) + width - 1, cut[:-1]) * 8
    return pa.RecordBatch.from_arrays([pa.array(want[0, cut[:-1]].view(np.int64)), pa.array(blobs, pa.binary()), pa.array(size)], ["id", "wants", "size"])


def _choose(width: int):
    """Wants without those of keys that can tell nothing new: all words of all runs are in spans, in one class."""

    def run(batches):
        got = [np.frombuffer(x.as_buffer(), np.uint64).reshape(5, -1) for b in batches for x in b.column(1)]
        if not got:
            return
        every = np.concatenate(got, 1)
        every = every[:, np.argsort(every[0])]
        new = np.flatnonzero(np.concatenate([[True], every[0, 1:] != every[0, :-1]]))
        low, high = np.minimum.reduceat(every[4], new), np.maximum.reduceat(every[4], new)
        keep = np.repeat((low != high) | (low & np.uint64(1) == 0), np.diff(new, append=every.shape[1]))
        if keep.any():
            yield _asked(every[:, keep][[1, 0, 2, 3, 4]], width)

    return run


def _gather(width: int, block: int):
    """The shingles of the runs that are to be compared, with the blocks of their key."""
    names = ["key", "low", "high", "own", "id", "s", "known", "x"]

    def run(batches):
        for b in batches:
            every, ids = Stretches(b), b.column(0).to_numpy()
            for k in range(b.num_rows):
                want = np.concatenate([np.frombuffer(x, np.uint64).reshape(4, -1) for x in b.column(4)[k].as_py()], 1)
                at, n = (want[1] >> np.uint64(7)).astype(np.int64), (want[1] & np.uint64(127)).astype(np.int64) + width - 1
                stretch = every.cut[k] + np.searchsorted(every.s[every.cut[k] : every.cut[k + 1]], at, "right") - 1
                place = every.first[stretch] + at - every.s[stretch]
                blocks = -(-want[2].astype(np.int64) // block)
                own = (mix(ids[k : k + 1].view(np.uint64) ^ mix(want[1])) % blocks.astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(at)), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                at, n, own, place = at[row], n[row], own[row], place[row]
                for x in range(0, len(row), 4096):  # a part of a run that many share
                    y = slice(x, x + 4096)
                    ends = np.cumsum(n[y])
                    from_ = np.repeat(place[y] - (ends - n[y]), n[y]) + np.arange(ends[-1])
                    data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], 8 * ends]).astype(np.int32)), pa.py_buffer(every.x[from_])])
                    yield pa.RecordBatch.from_arrays([pa.array(want[0, row[y]].view(np.int64)), pa.array(np.minimum(own[y], other[y])), pa.array(np.maximum(own[y], other[y])), pa.array(own[y]), pa.array(np.full(len(ends), ids[k])), pa.array(at[y]), pa.array(want[3, row[y]].view(np.int64)), data], names)

    return run


class Piece:
    """The shingles of a run. row and s: its text, and where in it the run starts."""

    def __init__(self, x: np.ndarray, width: int, row: object = None, s: int = 0, size: np.ndarray | None = None, single: bool | None = None):
        self.x, self.row, self.s = x, row, s
        self.starts = np.arange(len(x) - width + 1)
        if size is None:
            kinds, code = np.unique(x, return_inverse=True)
            single = len(kinds) == len(x)
            size = np.full(len(self.starts), width) if single else _held(code, self.starts, width, len(kinds)).sum(1).astype(np.int64)
        self.single, self.size = single, size  # whether no shingle recurs, and the kinds in each passage


def _held(code: np.ndarray, starts: np.ndarray, width: int, kinds: int) -> np.ndarray:
    """A row per passage: 1 for each kind of shingle that is in it."""
    out = np.zeros((len(starts), kinds), np.float32)
    out[np.arange(len(starts))[:, None], code[starts[:, None] + np.arange(width)]] = 1
    return out


def similar(p: Piece, q: Piece, width: int, threshold: float, both: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts in p, starts in q) of passages that are as similar as the threshold. Passages of one text that
    overlap are not compared. both: how many kinds of shingles each two passages share, where that is known."""
    i, j = p.starts, q.starts
    if both is not None:
        pass
    elif p.single and q.single:  # places that agree are shared shingles
        box = np.zeros((len(p.x) + 1, len(q.x) + 1), np.int16)
        np.cumsum(np.cumsum(p.x[:, None] == q.x[None, :], 0, dtype=np.int16), 1, out=box[1:, 1:])
        rows = box[width:] - box[: len(i)]
        both = rows[:, width:] - rows[:, : len(j)]
    else:
        kinds, code = np.unique(np.concatenate([p.x, q.x]), return_inverse=True)
        both = _held(code[: len(p.x)], i, width, len(kinds)) @ _held(code[len(p.x) :], j, width, len(kinds)).T
    near = both * (1 + threshold) >= threshold * np.add.outer(p.size, q.size) - 1e-9
    if p.row is not None and p.row == q.row:
        near &= np.abs(np.subtract.outer(p.s + i, q.s + j)) >= width
    return i[near.any(1)], j[near.any(0)]


def _runs(cells: np.ndarray, width: int) -> np.ndarray:
    """For each row, how many cells of each run of `width` columns are true."""
    total = np.zeros((len(cells), cells.shape[1] + 1), np.int16)
    np.cumsum(cells, 1, out=total[:, 1:])
    return total[:, width:] - total[:, :-width]


def enough(size: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """How many shingles passages of `size` kinds must share with one of `other` kinds or more."""
    return np.ceil(np.maximum(threshold * size, threshold / (1 + threshold) * (size + other)) - 1e-9)


def compare(group: list[Piece], width: int, threshold: float, side: np.ndarray | None = None, known: list[np.ndarray] | None = None, label: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each piece its starts of near-duplicate passages, a label for each that pieces linked by such
    share). All pairs are compared, but for those that can't tell anything new: two passages can only reach the
    threshold if enough shingles of each are anywhere in the other's piece, and a pair is verified if that
    holds for a passage that is not yet known to have a near-duplicate, or for pieces of two labels. With `side`,
    only pieces of different sides are compared. known: for each piece, whether its passages are known to have
    near-duplicates, with the labels of the pieces."""
    n = len(group)
    if n == 2:
        starts = similar(group[0], group[1], width, threshold) if side is None or side[0] != side[1] else (np.arange(0), np.arange(0))
        return list(starts), np.zeros(2, np.int64) if len(starts[0]) else np.arange(2)
    label = np.arange(n) if label is None else label.copy()
    longest, most = max(len(p.x) for p in group), max(len(p.starts) for p in group)
    kinds, code = np.unique(np.concatenate([p.x for p in group]), return_inverse=True)
    of = np.repeat(np.arange(n), [len(p.x) for p in group])
    held = np.bincount(np.unique(code * n + of) // n) > 1  # by another piece as well
    code = np.where(held, np.cumsum(held) - 1, held.sum())[code]
    cells = np.full((n, longest), held.sum())
    size, open_ = np.zeros((n, most)), np.zeros((n, most), bool)  # by passage
    ends = np.cumsum([len(p.x) for p in group])
    for k, p in enumerate(group):
        cells[k, : len(p.x)] = code[ends[k] - len(p.x) : ends[k]]
        size[k, : len(p.starts)], open_[k, : len(p.starts)] = p.size, True
    small = np.where(open_, size, width).min(1).astype(np.int64)
    need = np.where(open_, enough(size, small.min(), threshold), width + 1).astype(np.int16)
    inside = np.zeros((int(held.sum()) + 1, n), bool)  # kind of shingle, piece
    inside[cells.ravel(), np.repeat(np.arange(n), cells.shape[1])] = True
    inside[-1] = False
    open_ &= _runs(cells < len(inside) - 1, width) >= need
    able, hit = open_.any(1), np.zeros_like(open_)
    if known is not None:
        for k, x in enumerate(known):
            hit[k, : len(x)] = x
        open_ &= ~hit
    for k in np.flatnonzero(able)[:-1].tolist():
        rest = np.flatnonzero(able[k + 1 :]) + k + 1
        if side is not None:
            rest = rest[side[rest] != side[k]]
        rest = rest[open_[k].any() | open_[rest].any(1) | (label[rest] != label[k])]
        if not len(rest):
            continue
        own, table = np.unique(cells[k]), None
        shared = inside[own].sum(0, dtype=np.int16)[rest]
        rest = rest[shared >= np.maximum(need[k].min(), need[rest].min(1))]
        if not len(rest):
            continue
        mine = (_runs(inside[cells[k]][:, rest].T, width) >= enough(size[k], small[rest, None], threshold)) & (size[k] > 0)
        theirs = (_runs(inside[:, k][cells[rest]], width) >= enough(size[rest], small[k], threshold)) & (size[rest] > 0)
        new = (label[rest] != label[k]) | (mine & open_[k]).any(1) | (theirs & open_[rest]).any(1)
        for at in np.flatnonzero(new & mine.any(1) & theirs.any(1)).tolist():
            m = int(rest[at])
            if label[k] == label[m] and not (mine[at] & open_[k]).any() and not (theirs[at] & open_[m]).any():
                continue
            both = None
            if not (group[k].single and group[m].single):  # by the kinds of piece k; what no other piece has is left out
                if table is None:
                    place = np.full(len(inside), len(own))
                    place[own] = np.arange(len(own))
                    place[-1] = len(own)
                    table = _held(place[cells[k]], group[k].starts, width, len(own) + 1)[:, :-1]
                both = table @ _held(place[cells[m]], group[m].starts, width, len(own) + 1)[:, :-1].T
            a, b = similar(group[k], group[m], width, threshold, both)
            if len(a):
                hit[k, a] = True
                hit[m, b] = True
                open_[k] &= ~hit[k]
                open_[m] &= ~hit[m]
                if label[k] != label[m]:
                    label[label == max(label[k], label[m])] = min(label[k], label[m])
    return [p.starts[hit[k, : len(p.starts)]] for k, p in enumerate(group)], label


class Gathered:
    """The pieces of some groups: x, the shingles of all pieces in a row, and their sizes, groups, rows and places.
    Pieces of one group are neighbours."""

    def __init__(self, x: np.ndarray, size: np.ndarray, group: np.ndarray, ids: np.ndarray, s: np.ndarray, width: int, threshold: float):
        self.x, self.size, self.group, self.ids, self.s, self.width = x, size, group, ids, s, width
        self.first = np.cumsum(size) - size
        self.piece = np.repeat(np.arange(len(size)), size)
        y = x ^ mix(group.astype(np.uint64) * GOLD + np.uint64(1))[self.piece]
        order = np.argsort(y, kind="stable")
        y, of = y[order], self.piece[order]
        new = np.concatenate([[True], y[1:] != y[:-1]])
        again = ~new & np.concatenate([[False], of[1:] == of[:-1]])
        # each passage with a shingle and the one before it of its kind has a kind less
        late, early = order[again], order[np.flatnonzero(again) - 1]
        low = np.maximum(late - width + 1, self.first[of[again]])
        less = np.zeros(len(x) + 1, np.int64)
        np.add.at(less, low[low <= early], 1)
        np.add.at(less, early[low <= early] + 1, -1)
        self.kinds = width - np.cumsum(less)[:-1]
        self.single = np.bincount(of[again], minlength=len(size)) == 0
        self.plain = np.ones(int(group[-1]) + 1, bool)  # groups where every passage has `width` shingles
        self.plain[group[~self.single]] = False
        run = np.cumsum(new) - 1
        self.order, self.run, self.begin = order, run, np.flatnonzero(new)
        held = np.zeros(len(x), bool)
        held[order] = (np.bincount(run[~again]) > 1)[run]
        # starts of passages, and their pieces
        n = size - width + 1
        self.of = np.repeat(np.arange(len(size)), n)
        self.start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.first[self.of]
        self.enough = int(np.ceil(2 * threshold / (1 + threshold) * width - 1e-9))
        need = np.where(self.plain, self.enough, np.ceil(threshold * width - 1e-9))[group]
        self.able = (self.within(held) >= need[self.of]) | ~self.single[self.of]

    def within(self, cells: np.ndarray) -> np.ndarray:
        """How many cells of each passage are true."""
        total = np.concatenate([[0], np.cumsum(cells)])
        return total[self.start + self.width] - total[self.start]

    def shown(self, r: int) -> Piece:
        a, z = self.first[r], self.first[r] + self.size[r]
        return Piece(self.x[a:z], self.width, self.ids[r], self.s[r], self.kinds[a : z - self.width + 1], self.single[r])

    def led(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts with a near-duplicate, groups that need no other comparison). Each piece is laid beside the first
        of its group that has a passage to compare, at the distance where most shingles agree; what agrees there is a
        lower bound of what two passages share. A group is done if that settles all its passages."""
        open_ = np.bincount(self.of[self.able], minlength=len(self.size)) > 0
        lead = np.full(len(self.plain), len(self.size))
        np.minimum.at(lead, self.group[open_], np.flatnonzero(open_))
        lead = np.minimum(lead, len(self.size) - 1)[self.group]
        # where the leader has the shingle
        stands = self.piece[self.order] == lead[self.piece[self.order]]
        at = np.full(len(self.begin), -1)
        at[self.run[stands]] = self.order[stands]
        where = np.empty(len(self.x), np.int64)
        where[self.order] = at[self.run]
        mine = np.flatnonzero((where >= 0) & (self.piece != lead[self.piece]))
        mine = mine[(self.x[where[mine]] == self.x[mine]) & (self.group[self.piece[where[mine]]] == self.group[self.piece[mine]])]
        wide = int(self.size.max()) + 1
        shift = (where[mine] - self.first[lead[self.piece[mine]]]) - (mine - self.first[self.piece[mine]])
        code = self.piece[mine] * (2 * wide) + shift + wide
        kinds, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        rank = np.lexsort((-count, kinds // (2 * wide)))
        best = rank[np.flatnonzero(np.diff(kinds[rank] // (2 * wide), prepend=-1))]
        way = np.zeros(len(self.size), np.int64)
        way[kinds[best] // (2 * wide)] = kinds[best] % (2 * wide) - wide
        chosen = np.zeros(len(kinds), bool)
        chosen[best] = True
        cells = np.zeros(len(self.x), bool)
        cells[mine[chosen[inverse]]] = True
        total, n, w = np.concatenate([[0], np.cumsum(cells)]), self.size - self.width + 1, self.width

        def near(piece: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether passages i of the pieces and j of their leaders share enough that agrees."""
            back = j - way[piece]
            high = np.maximum(np.minimum(i, back) + w, 0)
            low = np.minimum(np.maximum(i, back), high)  # back may lie beyond the piece, on either side
            at = self.first[piece]
            share = total[at + high] - total[at + low]
            apart = (self.ids[piece] != self.ids[lead[piece]]) | (np.abs(self.s[piece] + i - self.s[lead[piece]] - j) >= w)
            return (share >= self.enough) & apart & self.plain[self.group[piece]]

        others = np.flatnonzero(open_ & (lead != np.arange(len(lead))) & (self.group[lead] == self.group))
        hit = np.zeros(len(self.of), bool)
        edge = np.cumsum(n) - n
        for side in (0, 1):  # passages of the pieces, then of their leaders, each beside the nearest of the other
            many = n[others] if side == 0 else n[lead[others]]
            piece = np.repeat(others, many)
            at = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
            if side == 0:
                good = near(piece, at, np.clip(at + way[piece], 0, n[lead[piece]] - 1))
                hit[edge[piece[good]] + at[good]] = True
            else:
                good = near(piece, np.clip(at - way[piece], 0, n[piece] - 1), at)
                hit[edge[lead[piece[good]]] + at[good]] = True
        done = self.plain.copy()
        done[self.group[self.of[self.able & ~hit]]] = False
        return hit, done


def _verify(width: int, min_words: int, threshold: float):
    """(id, starts, ends, root) of pieces with near-duplicate passages. Pieces of which all words are in spans found by
    earlier bands are only compared with those of another class, and with passages that have no near-duplicate yet."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        key, low, high, own, ids, s, state = (whole[k].to_numpy() for k in ("key", "low", "high", "own", "id", "s", "known"))
        body, cut = flat(whole["x"])
        if body.ctypes.data % 8:
            body = body.copy()
        order = np.lexsort((high, low, key))
        change = (np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        group = np.concatenate([[0], np.cumsum(change)])
        size = np.diff(cut)[order] // 8
        at = np.repeat(cut[:-1][order] // 8 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        own, ids, s, state = own[order], ids[order], s[order], state[order]
        parts = Gathered(body.view(np.uint64)[at], size, group, ids, s, width, threshold)
        hit, done = parts.led()
        sides = low[order] != high[order]
        done[group[sides]] = False
        some = np.bincount(parts.of[parts.able], minlength=len(size)) > 0
        rest = np.flatnonzero(some & ~done[group])
        if len(rest):  # pieces that could match are all in spans of one class: nothing new, whatever the others are
            new = np.flatnonzero(np.diff(group[rest], prepend=-1))
            low_, high_ = np.minimum.reduceat(state[rest], new), np.maximum.reduceat(state[rest], new)
            old = np.repeat((low_ == high_) & (low_ & 1 > 0), np.diff(new, append=len(rest)))
            done[group[rest[old]]] = True
            hit |= np.isin(parts.of, rest[old])
            rest = rest[~old]
        # groups that are settled
        row = parts.of[hit & done[group[parts.of]]]
        start = (s[parts.of] + parts.start - parts.first[parts.of])[hit & done[group[parts.of]]]
        linked = np.unique(row)
        least_ = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_, group[linked], ids[linked])
        found, root, edge = [(row, start)], least_[group], np.concatenate([[0], np.cumsum(size - width + 1)])
        for rows in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1):
            if len(rows) < 2:
                continue
            side = own[rows] if sides[rows[0]] else None
            known = [hit[edge[r] : edge[r + 1]] & (side is None and parts.plain[group[r]]) | (state[r] & 1 > 0) for r in rows]
            label = np.unique(state[rows] >> 1, return_inverse=True)[1]  # the classes found by earlier bands
            if side is None and parts.plain[group[rows[0]]]:  # what has hits has them with the first
                linked = np.unique(label[[hit[edge[r] : edge[r + 1]].any() for r in rows]])
                label[np.isin(label, linked)] = linked.min(initial=len(rows))
            starts, label = compare([parts.shown(r) for r in rows], width, threshold, side, known, label)
            low_ = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low_, label, ids[rows])
            root[rows] = low_[label]
            own_ = np.repeat(rows, [len(x) for x in starts])
            found.append((own_, s[own_] + np.concatenate(starts)))
        row, start = (np.concatenate(x) for x in zip(*found))
        if len(row):
            wide = int(s.max()) + int(size.max()) + min_words + 1
            a, z = joined(row * wide + start, row * wide + start + min_words)
            who, (starts, ends) = _lists(a // wide, a % wide, a % wide + z - a)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), starts, ends, pa.array(root[who])], ["id", "starts", "ends", "root"])

    return run


def _search(work: Work, able: DataFrame, bands: range, known: DataFrame | None, min_words: int, threshold: float, block: int, buckets: int, task_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(spans of rows in words, links of rows) by these bands. known: spans and classes found so far."""
    width = min_words - SHINGLE + 1
    told = work.save(_deal(able, width, bands, buckets).repartition(buckets, "bucket").mapInArrow(_tell(width), "id long, starts array<long>, ends array<long>, wants binary, size long, other long"), "told")
    work.release()
    wants = told.where("wants is not null").select("id", "wants", "size")
    if known is not None:
        per = wants.groupBy("id").agg(F.collect_list("wants").alias("wants")).join(known, "id", "left").select("id", "wants", "starts", "ends", "root")
        wants = work.save(per.mapInArrow(_screen(width, buckets), "bucket int, runs binary").repartition(buckets, "bucket").mapInArrow(_choose(width), "id long, wants binary, size long"), "wants")
    total = wants.agg(F.sum("size")).first()[0] or 0
    asked = able.join(wants.groupBy("id").agg(F.collect_list("wants").alias("wants")), "id").select("id", "s", "n", "x", "wants")
    cut = asked.mapInArrow(_gather(width, block), "key long, low long, high long, own long, id long, s long, known long, x binary")
    checked = work.save(cut.repartition(max(1, math.ceil(total / task_bytes)), "key", "low", "high").mapInArrow(_verify(width, min_words, threshold), "id long, starts array<long>, ends array<long>, root long"), "checked")
    work.release()
    spans = told.where("starts is not null").select("id", "starts", "ends").union(checked.select("id", "starts", "ends"))
    links = told.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).union(checked.select("id", "root").where("id <> root"))
    return spans, links


def _known(work: Work, ids: DataFrame, found: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(the columns of ids, root, starts, ends): the least row of each row's class, and its merged spans."""
    spans, links = (reduce(DataFrame.union, part) for part in zip(*found))

    def tidy(batches):
        for b in batches:
            own, (low, high) = b.column(1).flatten(), (b.column(k).flatten().flatten().to_numpy() for k in (1, 2))
            row = np.repeat(np.repeat(np.arange(b.num_rows), b.column(1).value_lengths()), own.value_lengths())
            wide = int(high.max(initial=0)) + 2
            a, z = joined(row * wide + low, row * wide + high)
            who, (starts, ends) = _lists(a // wide, a % wide, a % wide + z - a)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), starts, ends], ["id", "starts", "ends"])

    merged = spans.groupBy("id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")).mapInArrow(tidy, "id long, starts array<long>, ends array<long>")
    root = connected_components(work, links.distinct()).select(F.col("node").alias("id"), "root")
    return work.save(ids.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")).join(merged, "id", "left"), "known")


def near_passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, bands: int = BANDS, wave: int = WAVE, block: int = 1024, task_bytes: int = 4 << 20) -> DataFrame:
    """A row per document: doc_id, starts and ends of the near-duplicate spans in words (maximal ones),
    and class_id. A passage has at most 123 words here."""
    if not SHINGLE <= min_words < 123:
        raise ValueError("passages have 5 to 122 words")
    work = Work(docs.sparkSession)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("d"), body.alias("body"))
    chunks = work.save(texts.mapInArrow(_chunk, "chunk long, ids array<long>, d array<long>, ends binary, body binary"), "texts", compression="none")
    ids = work.save(chunks.select(F.explode(F.arrays_zip("ids", "d")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.d").alias("d")), "ids")
    able = _able(work, chunks, min_words - SHINGLE + 1, threshold)
    work.drop(chunks)
    buckets, found, known = min(1 << 16, max(16, work.size(able) >> 23)), [], None
    for j in range(0, bands, wave):
        found.append(_search(work, able, range(j, min(j + wave, bands)), known, min_words, threshold, block, buckets, task_bytes))
        if known is None and bands > wave:
            known = _known(work, ids.select("id"), found)
    rows = _known(work, ids, found)
    low = work.save(rows.where("starts is not null").groupBy("root").agg(F.min("d").alias("low")), "low")
    none = F.array().cast("array<long>")
    return work.result(rows.join(low, "root", "left").select(F.col("d").alias("doc_id"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("low", "d").alias("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dup_words and n_spans (words in near-duplicate passages, and their maximal runs), class_id."""
    length = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return near_passages(table(spark, sf_dir, "documents")).select("doc_id", length.alias("n_dup_words"), F.size("starts").cast("long").alias("n_spans"), "class_id")
