"""Token ids in shard files compressed by Re-Pair grammars.

Documents are dealt in ranges of doc_id and tokenized; a shard holds about `shard_tokens` ids of whole
documents, in ascending order. In each shard frequent pairs of neighbouring ids become nonterminals, round
after round, until no pair occurs often enough to save the bytes of its rule (LEAST times). A round counts all pairs exactly,
and replaces every pair that can be replaced so often, the more frequent first where they overlap. No pair spans two
documents. A shard stores the rules, the length that each rule expands to, the documents' lengths in symbols and ids, and the
symbols; so any range of ids is read by adding up expansion lengths and expanding the symbols it touches.

A shard is framed by its length; a file is a run of shards, each followed by a line feed, and is written
by Spark's text writer as raw bytes, on any file system that Spark can write to.

Shard layout, little-endian: b"RPG1"; u32 length of the rest; i64 partition, i64 place in it; u32
documents, rules, symbols, terminals (ids below this are terminals), bytes a symbol (2 or 4); then i64
doc_id of each document (the least i64 for null), u32 symbols and u32 ids of each; u32 left and right of
each rule, u32 length of each; the symbols.

Defined results: a null text is empty and has the end id alone; repeated rows are encoded each; null ids
come first; an empty table writes no shard. Ties of doc_id go by text. Texts may be of any length that fits a task's memory about
thirty times over; a shard holds whole documents, so a longer one makes a longer shard. Other columns are not read."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from copy import copy
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, flat, table

END, NULL_ID = 0, -(1 << 63)
LEAST = 7  # a rule has 12 bytes, and each use of it saves a symbol of 2
HEAD = struct.Struct("<4sIqqIIIII")

# The pattern of the byte-level pre-tokenizer, for texts of ASCII and Latin letters only, where Python's
# classes agree with it; any other text goes to the library whole. So do texts that may name special tokens.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_KNOWN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])  # of U+00C0 to U+027F in UTF-8
_MARKS = ".,;:!?|%$&*#"
_UNKNOWN = np.isin(np.arange(256), list(_KNOWN), invert=True)
# A blank with such white space on both sides: there a text can't be cut at its blanks.
_SPACE = np.isin(np.arange(256), list(b"\t\n\r "))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models have for each byte: printable Latin-1 as it is, others from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """The tokenizers library behind a memory of what it has seen: pieces as the pre-tokenizer cuts them, and above these,
    words between single blanks, which are whole pieces with the blank before them. Each distinct word of a batch is looked up
    once, and new pieces go to the library together, as one text that it cuts at a mark; its own memory is off there, as none of
    them comes twice. Tokenizers other than byte-level BPE encode whole texts without any memory."""

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str, most_pieces: int = 400_000, most_words: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.pieces, self.most = Tokenizer.from_file(path), {}, most_pieces
        parts = json.loads(self.tok.to_str())
        pre = parts["pre_tokenizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        named = all("<|" in t["content"] for t in parts["added_tokens"])  # texts with such a mark go whole
        self.bare = parts["normalizer"] is None and byte_level and parts["model"]["type"] == "BPE" and named and not parts["truncation"] and not parts["padding"]
        self.model, self.letters, self.seen = self.tok.model, _byte_letters(), Seen(most_words)
        own = Tokenizer.from_file(path).model
        if hasattr(own, "_resize_cache"):
            own._resize_cache(0)
        self.bpe, self.blank = Tokenizer(own), np.zeros(self.tok.get_vocab_size(), bool)
        self.bpe.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.letters[0])
        self.wide = np.array([ord(self.letters[k]) for k in range(256)], "<u2")
        self.blank[[k for t, k in self.tok.get_vocab().items() if t.startswith(self.letters[32])]] = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            if len(self.pieces) > self.most:
                self.pieces.clear()
            ids = [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
            got = self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _cut(self, text: str) -> bytes:
        """Ids of any text, by its pieces; new ones go to the library's model."""
        return b"".join(map(self._piece, _PIECE.findall(text)))

    def _library(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number for each piece) of pieces, in one call. A key is a piece without the blank at its start, or NUL
        and a piece that has none. Pieces are cut where a token begins with the blank; before pieces that have none a
        blank is put that is not kept."""
        if not keys:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        spelled = self.wide[np.frombuffer((" " + "\0 ".join(keys)).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bpe.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
        cut = np.append(np.flatnonzero(self.blank[ids]), len(ids))
        if len(cut) != len(keys) + 1:
            own = [self._piece(k[1:] if k[:1] == "\0" else " " + k) for k in keys]
            return np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        bare = np.fromiter([k[:1] == "\0" for k in keys], bool, len(keys))
        return (np.delete(ids, cut[:-1][bare]) if bare.any() else ids), np.diff(cut) - bare

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number for each word) of words that differ, each with a blank before it. Letters, and letters before
        marks, which are a piece of their own, need no pattern, and each row of letters is looked up once."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.utf8_is_alpha(core)
        alone = plain.to_numpy(zero_copy_only=False)
        tail = np.where(alone, (pc.binary_length(words).to_numpy() - pc.binary_length(core).to_numpy()).astype(np.int64), 0)
        letters = core.filter(plain).dictionary_encode()

        def texts(x: pa.Array) -> list[str]:
            return x.to_numpy(zero_copy_only=False).tolist()

        marked, other = tail > 0, texts(words.filter(pc.invert(plain)))
        marks = ["\0" + w[-n:] for w, n in zip(texts(words.filter(pa.array(marked))), tail[marked].tolist())]
        # The other words are cut together, with a word of a letter after each, so that no white space meets.
        cut = _PIECE.findall("".join([f" {w} a" for w in other]))
        most = np.cumsum(np.fromiter(map(len, other), np.int64, len(other)) + 3)
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))), most)  # the pieces of that letter
        self.seen.turn()
        slot = self.seen.slots(texts(letters.dictionary), self._library)
        keys = [*marks, *[p[1:] if p[0] == " " else "\0" + p for p in cut]]
        number = dict(zip(once := list(dict.fromkeys(keys)), range(len(keys))))
        more = self.seen.slots(once, self._library)[np.fromiter(map(number.get, keys), np.int64, len(keys))]
        n = 1 + marked
        n[~alone] = np.diff(last, prepend=-1) - 1
        ends = np.cumsum(n)
        part, rest = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), np.repeat(~alone, n)
        part[(ends - n)[alone]] = slot[letters.indices.to_numpy()]
        part[ends[marked] - 1] = more[: len(marks)]
        part[rest] = np.delete(more[len(marks) :], last)
        ids, size = self.seen.ids(part)
        return ids, np.diff(np.append(0, np.cumsum(size))[ends], prepend=0)

    def _apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which texts go to the library whole, and which can't be cut at their blanks; a neighbour's end or start may put
        a text there that need not go."""
        whole, cut = np.full((2, len(texts)), not self.bare)
        body, at = flat(texts)
        if self.bare and len(body):
            blank, mark = np.flatnonzero(body[1:-1] == 32) + 1, np.flatnonzero(body[:-1] == ord("<"))
            blank = blank[_SPACE[body[blank - 1]]]
            odd = [low + np.flatnonzero(_UNKNOWN[body[low : low + (1 << 16)]]) for low in range(0, len(body), 1 << 16)]
            whole[np.searchsorted(at, np.concatenate([mark[body[mark + 1] == ord("|")], *odd]), "right") - 1] = True
            cut[np.searchsorted(at, blank[_SPACE[body[blank + 1]]], "right") - 1] = True
        return whole, cut

    def encode(self, texts: list[str], closing: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each ends), with the ids of `closing` after each text."""
        column = pa.array(texts, pa.large_string())
        whole, cut = self._apart(column)
        # what stands before the first blank, or all of a text that is not cut at its blanks
        first = [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else self._cut(t if c else t.partition(" ")[0]) for t, w, c in zip(texts, whole.tolist(), cut.tolist())]
        words = pc.split_pattern(pc.if_else(pa.array(whole | cut), "", column), " ")
        coded = words.values.dictionary_encode()
        begin = words.offsets.to_numpy()
        code = coded.indices.to_numpy().astype(np.int64)
        table, size = self._distinct(coded.dictionary)
        code[begin[:-1]] = np.arange(len(texts)) + len(size)
        code = np.insert(code, begin[1:], len(size) + len(texts))
        ids, n = _laid([*first, closing], code, table, size)
        ends = np.cumsum(n)
        return ids, ends[begin[1:] + np.arange(len(texts))] if len(texts) else ends


class Seen:
    """Rows of ids by their keys, in one table: those of at least the last `most` keys, and of those before them."""

    def __init__(self, most: int):
        self.most, self.older = most, None
        self.slot, self.flat, self.start, self.size = {}, np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, keys: list[str], find) -> np.ndarray:
        """Places in the table of keys that differ. New ones are found together."""
        out = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        missing = [keys[k] for k in new.tolist()]
        if self.older is not None:
            at = np.fromiter(map(self.older.slot.get, missing, repeat(-1)), np.int64, len(missing))
            out[new[at >= 0]] = self._add([keys[k] for k in new[at >= 0].tolist()], *self.older.ids(at[at >= 0]))
            new = new[at < 0]
            missing = [keys[k] for k in new.tolist()]
        out[new] = self._add(missing, *find(missing))
        return out

    def turn(self) -> None:
        """Drop the older keys if there are enough newer ones; places change."""
        if len(self.slot) > self.most:
            older = copy(self)
            older.older = None
            self.__init__(self.most)
            self.older = older

    def _add(self, keys: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        places = np.arange(len(self.size), len(self.size) + len(keys))
        self.slot.update(zip(keys, places.tolist()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        return places

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number for each place)"""
        return _taken(self.flat, self.start[slots], self.size[slots])


def _laid(own: list[bytes], code: np.ndarray, table: np.ndarray | None = None, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids in a row, number for each code) of codes, which count the entries of a table and then those of own."""
    more = np.frombuffer(b"".join(own), "<u4")
    n = np.fromiter(map(len, own), np.int64, len(own)) // 4
    table, size = (more, n) if table is None else (np.concatenate([table, more]), np.concatenate([size, n]))
    return _taken(table, (np.cumsum(size) - size)[code], size[code])


def _taken(table: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of a table in a row, n) of runs of n entries from each start."""
    ends = np.cumsum(n)
    at = np.repeat(start - (ends - n), n)
    at += np.arange(len(at))
    return table[at], n


def frequent_pairs(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, bucket) of those counted `least` times or more, the most frequent first, and the most frequent alone of
    those in one bucket of hashes; others have their turn in a later round. Then, for each bucket, whether it holds such a
    pair. Of the sorted pairs, those are frequent that are the same `least` - 1 places on."""
    pairs = np.sort(pairs)
    begin = np.flatnonzero(pairs[least - 1 :] == pairs[: max(0, len(pairs) - least + 1)])
    begin = begin[(begin == 0) | (pairs[begin - 1] != pairs[begin])]
    pair = pairs[begin]
    n = np.searchsorted(pairs, pair, "right") - begin
    pair = pair[np.argsort(-n, kind="stable")]
    at, place = bucket_of(pair), np.arange(len(pair))
    foremost, holds = np.empty(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
    foremost[at[::-1]] = place[::-1]
    first = foremost[at] == place
    holds[at] = True
    return pair[first], at[first], holds


BUCKETS = 1 << 18


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(2654435761)) >> np.uint32(14)
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.uint32)


def grammar(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST):
    """(symbols, ends in symbols, rules as pairs). ends: one past each document's last id. Rounds go on until no pair
    can be replaced `least` times. Symbols stay at the places of their first ids, with links to the next; a pair that is
    too rare can't recur more often later, so a round looks at the places alone that hold a frequent pair or are new."""
    sym, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids), dtype=np.int32)
    rules, there = np.zeros((0, 2), np.uint32), np.ones(len(ids), bool)
    rank_at, pair_at = np.empty(BUCKETS, np.int32), np.empty(BUCKETS, np.uint64)
    live = ~last
    live[-1:] = False
    at = np.flatnonzero(live)
    while len(at):
        left, right, follow = sym[at], sym[after[at]], after[at]
        narrow = terminals + len(rules) <= 1 << 16
        pairs = (left << np.uint32(16)) | right if narrow else (left.astype(np.uint64) << np.uint64(32)) | right
        bucket = bucket_of(pairs)
        pair, in_, holds = frequent_pairs(pairs, least)
        none = len(pair)
        if not none:
            break
        rank_at[in_], pair_at[in_] = np.arange(none), pair
        own = np.flatnonzero(holds[bucket])  # the places that any frequent pair can have
        at, follow, pairs, bucket = at[own], follow[own], pairs[own], bucket[own]
        rank = np.full(len(at) + 2, none, np.int32)
        rank[1:-1] = np.where(pair_at[bucket] == pairs, rank_at[bucket], none)
        next_ = np.append(follow[:-1] == at[1:], False)  # the next place is the next symbol's
        good = rank[1:-1] < none
        good &= ~next_ | (rank[1:-1] <= rank[2:])
        good[1:] &= ~next_[:-1] | (rank[2:-1] <= rank[1:-2])
        best = np.flatnonzero(good)
        run = np.concatenate([[True], ~next_[best[1:] - 1] | (np.diff(best) > 1)])[: len(best)]  # in a row of equal pairs every other one
        take = best[(best - best[run][np.cumsum(run) - 1]) % 2 == 0]
        which = rank[1 + take]
        used = np.bincount(which, minlength=none) >= least
        take = take[used[which]]
        if not len(take):
            break
        which = (np.cumsum(used) - 1)[rank[1 + take]]
        place, gone = at[take], follow[take]
        new = np.zeros((int(used.sum()), 2), np.uint32)
        new[which] = np.stack([sym[place], sym[gone]], 1)
        sym[place] = which + terminals + len(rules)
        last[place] = last[gone]
        there[gone] = False
        after[place] = after[gone]
        before[after[place]] = place
        rules = np.concatenate([rules, new])
        prior = before[place]
        look = np.concatenate([at, place, prior[prior >= 0]])
        if len(look) > len(live) >> 5:
            live[:] = False
            live[look] = True
            live &= there
            live &= ~last
            at = np.flatnonzero(live)
        else:
            look = np.unique(look)
            at = look[there[look] & ~last[look]]
    return sym[there], np.flatnonzero(last[there]) + 1, rules


def levels(rules: np.ndarray, terminals: int):
    """Rules in groups whose parts are all in earlier groups."""
    part = np.where(rules >= terminals, rules.astype(np.int64) - terminals, len(rules))
    done, left = np.zeros(len(rules) + 1, bool), np.arange(len(rules))
    done[-1] = True
    while len(left):
        ready = done[part[left]].all(1)
        yield left[ready]
        done[left[ready]] = True
        left = left[~ready]


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    out = np.ones(terminals + len(rules), np.uint32)
    for own in levels(rules, terminals):
        out[terminals + own] = out[rules[own]].sum(1)
    return out[terminals:]


def pack(part: int, place: int, doc_ids: list[int | None], flat: np.ndarray, ends: np.ndarray, terminals: int) -> bytes:
    """A shard of whole documents: their ids in a row, and one past the last of each."""
    terminals = max(terminals, int(flat.max(initial=0)) + 1)
    sym, cut, rules = grammar(flat, ends, terminals)
    wide = 2 if terminals + len(rules) <= 1 << 16 else 4
    body = b"".join(x.tobytes() for x in (np.array([NULL_ID if d is None else d for d in doc_ids], "<i8"), np.diff(cut, prepend=0).astype("<u4"), np.diff(ends, prepend=0).astype("<u4"), rules.astype("<u4"), lengths(rules, terminals).astype("<u4"), sym.astype(f"<u{wide}")))
    return HEAD.pack(b"RPG1", HEAD.size - 8 + len(body), part, place, len(ends), len(rules), len(sym), terminals, wide) + body


class Shard:
    """A shard read back."""

    def __init__(self, data: memoryview):
        magic, _, self.part, self.place, docs, rules, n, self.terminals, wide = HEAD.unpack_from(data)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, cut, size = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.rules, self.long, self.sym = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules), take(f"<u{wide}", n)
        self.table = None
        self.cut, self.ends = np.concatenate([[0], np.cumsum(cut, dtype=np.int64)]), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    def expand(self, sym: np.ndarray) -> np.ndarray:
        """The ids of some symbols. The rules are expanded once, into one row; rules refer to earlier ones."""
        if self.table is None:
            self.size = np.concatenate([np.ones(self.terminals, np.int32), self.long.astype(np.int32)])
            self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
            self.table = np.empty(int(self.size.sum()), np.uint32)
            self.table[: self.terminals] = np.arange(self.terminals)
            for own in levels(self.rules, self.terminals):
                part = self.rules[own].ravel()
                size, to = self.size[part], self.begin[self.terminals + own]
                to = np.stack([to, to + self.size[self.rules[own, 0]]], 1).ravel()
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                self.table[np.repeat(to, size) + step] = self.table[np.repeat(self.begin[part], size) + step]
        size = self.size[sym]
        shift = self.begin[sym] - (np.cumsum(size) - size)
        return self.table[np.repeat(shift, size) + np.arange(int(size.sum()))]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the symbols that reach into the range are expanded."""
        d0 = max(0, int(np.searchsorted(self.ends, start, "right")) - 1)
        d1 = int(np.searchsorted(self.ends, stop, "left"))
        sym = self.sym[self.cut[d0] : self.cut[min(d1, len(self.cut) - 1)]]
        size = np.where(sym >= self.terminals, self.long[np.maximum(sym, self.terminals).astype(np.int64) - self.terminals] if len(self.long) else 1, 1)
        before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]) + self.ends[d0]
        a, b = max(0, int(np.searchsorted(before, start, "right")) - 1), int(np.searchsorted(before, stop, "left"))
        return self.expand(sym[a:b])[start - before[a] : stop - before[a]] if b > a else sym[:0].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.sym[self.cut[k] : self.cut[k + 1]])


def shards(data: bytes):
    """The shards of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        size = 8 + struct.unpack_from("<I", view, at + 4)[0]
        yield Shard(view[at : at + size])
        at += size + 1


def gathered(batches, most: int = 4 << 20):
    """(doc_ids, texts) of rows in their order, about `most` bytes together: the larger, the fewer words recur in the next."""
    names, texts, size = [], [], 0
    for b in batches:
        for low in range(0, b.num_rows, 500):
            own = b.slice(low, 500)
            names += own.column(0).to_pylist()
            texts += [t or "" for t in own.column(1).to_pylist()]
            size += own.nbytes
            if size >= most:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def write(docs: DataFrame, at: str, tokenizer: str, shard_tokens: int = 1 << 19, end: int = END) -> None:
    """Write documents (doc_id, text) as shard files, in ascending order of doc_id."""
    closing = np.array([end], "<u4").tobytes()
    def run(batches):
        from pyspark import TaskContext

        coder, part, place = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        terminals = coder.tok.get_vocab_size()
        held, size = [], 0

        def shard():
            doc_ids, ids, ends = zip(*held)
            before = np.cumsum([0, *map(len, ids[:-1])])
            data = pack(part, place, [d for own in doc_ids for d in own], np.concatenate(ids), np.concatenate([e + x for e, x in zip(ends, before)]), terminals)
            return pa.RecordBatch.from_pydict({"shard": pa.array([data], pa.binary())})

        for names, texts in gathered(batches):
            ids, ends = coder.encode(texts, closing)
            first = 0
            while first < len(ends):  # documents up to the one that fills the shard
                base = int(ends[first - 1]) if first else 0
                stop = min(len(ends), int(np.searchsorted(ends, base + shard_tokens - size, "left")) + 1)
                held.append((names[first:stop], ids[base : ends[stop - 1]], ends[first:stop] - base))
                size += int(ends[stop - 1]) - base
                first = stop
                if size >= shard_tokens:
                    yield shard()
                    held, size, place = [], 0, place + 1
        if held:
            yield shard()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value")).write.text(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    """(part, place, k, doc_id, first, n_tokens, ids_crc32) of every document in the files; first counts
    the ids before it in its shard."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                for s in shards(data.as_buffer().to_pybytes()):
                    size, crc = np.diff(s.ends), []
                    for lo in range(0, len(s.doc_ids), 256):
                        hi = min(lo + 256, len(s.doc_ids))
                        ids = s.expand(s.sym[s.cut[lo] : s.cut[hi]]).astype("<u4").tobytes()
                        cut = 4 * (s.ends[lo : hi + 1] - s.ends[lo])
                        crc += [zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    n = len(size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s.part)), pa.array(np.full(n, s.place)), pa.array(np.arange(n)), pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID), pa.array(s.ends[:-1]), pa.array(size), pa.array(crc, pa.int64())], ["part", "place", "k", "doc_id", "first", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(at).select("content")
    return files.mapInArrow(run, "part long, place long, k long, doc_id long, first long, n_tokens long, ids_crc32 long")


def index(work: Work, rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): start counts the ids of all documents before. Sums run over
    shards inside a partition and over partitions, one row each."""
    rows = work.save(rows, "index")
    shard = rows.groupBy("part", "place").agg(F.sum("n_tokens").alias("n"))
    inner = shard.select("part", "place", (F.sum("n").over(Window.partitionBy("part").orderBy("place")) - F.col("n")).alias("inner"))
    part = shard.groupBy("part").agg(F.sum("n").alias("n"))
    outer = part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("outer"))
    base = inner.join(outer, "part").select("part", "place", (F.col("inner") + F.col("outer")).alias("base"))
    return rows.join(base, ["part", "place"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents, read the files back, and list what they hold."""
    spark = docs.sparkSession
    work = Work(spark)
    at = work.path("shards")
    write(docs, at, tokenizer or default_tokenizer())
    return work.result(index(work, read(spark, at)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)
