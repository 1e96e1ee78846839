"""The llm operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meshspark.llm import ann, components, decontaminate, langid, licenses, mixing, passages, queries, repeats, simhash, tokens, warc
from meshspark.llm.common import Spans, Work

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "ärger über Öl"), (7, "ärger über Öl"), (None, "lost row of words"), (8, "x" * 40_000), (9, "a b " * 9000), (10, "日本語 text ½ a  b   c \n d")]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS)


def words_of(rng, n, stock=400):
    return [f"w{rng.randrange(stock)}" for _ in range(n)]


def corpus(seed=1):
    """Texts with copies, edits, shared passages, and text repeated inside a document."""
    rng = random.Random(seed)
    base = [" ".join(words_of(rng, rng.randrange(20, 300))) for _ in range(30)]
    shared = " ".join(f"p{k}" for k in range(80))
    out = list(base) + base[:4] + [base[0]] * 3
    for t in base[4:10]:
        w = t.split()
        w[len(w) // 2] = "edited"
        out.append(" ".join(w))
    out += [f"{' '.join(words_of(rng, 40))} {shared} {' '.join(words_of(rng, 30))}" for _ in range(6)]
    w = shared.split()
    w[40] = "changed"
    out += [" ".join(words_of(rng, 10) + w), "abc " * 200, "z" * 700, shared + " " + shared]
    return list(enumerate(out, 1))


def components_by_force(links, nodes):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


# SimHash ------------------------------------------------------------------------------------------


def simhash_by_force(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_components(spark):
    rows = [r for r in corpus() + [(1000 + (d or 0), t) for d, t in ODD]]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    prints = {d: simhash_by_force(t) for d, t in rows}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {d: r.component_id for d, r in got.items()} == components_by_force(links, prints)
    xx = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert xx & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_simhash_links_of_crowded_cells(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    work = Work(spark)
    df = work.save(spark.createDataFrame([(x,) for x in signed], "fp long"))
    root = {r.node: r.root for r in components.connected_components(work, simhash.links(work, df)).collect()}
    links = [(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert {x: root.get(x, x) for x in signed} == components_by_force(links, signed)
    counts = df.select("fp", simhash.counts_per_nibble(F.col("fp")).alias("c")).collect()
    assert all((r.c >> 4 * k & 15) == ((r.fp >> 4 * k) & 15).bit_count() for r in counts for k in range(16))
    work.drop()


def test_simhash_empty_null_and_repeated_rows(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    got = simhash.near_duplicates(docs_of(spark, ODD).withColumn("fp", F.lit(3)).withColumn("low", F.lit(1))).collect()
    assert len(got) == len(ODD)
    zero = {r.doc_id: r.component_id for r in got if r.fingerprint == "0" * 16}
    assert zero[1] == zero[2] == zero[3] == 1
    kept = simhash.stage(spark, docs_of(spark, ODD), SF)
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7, 8, 9, 10]


@pytest.mark.parametrize("chunk", [1_000_000, 20])
def test_components_in_chunks(spark, chunk):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(60) if k % 20] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    work = Work(spark)
    got = {r.node: r.root for r in components.connected_components(work, spark.createDataFrame(links, "a long, b long"), chunk).collect()}
    nodes = {n for link in links for n in link}
    assert {n: got.get(n, n) for n in nodes} == components_by_force(links, nodes)
    assert components.connected_components(work, spark.createDataFrame([], "a long, b long")).collect() == []
    work.drop()


# Exact repeats ------------------------------------------------------------------------------------


def repeats_by_force(rows, length):
    texts, seen = [(t or "").encode() for _, t in rows], {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append((d, len(t), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~hit])))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark):
    rows = [(d, t if t is None or len(t) < 5000 else t[:5000]) for d, t in corpus() + ODD]
    got = repeats.remove_repeats(docs_of(spark, rows)).collect()
    told = [(r.doc_id, r.n_bytes, sum(e - s for s, e in zip(r.starts, r.ends)), len(r.starts), bytes(r.kept)) for r in got]
    assert sorted(told, key=repr) == repeats_by_force(rows, 200)


@pytest.mark.parametrize("hot", [1, 3])
def test_repeats_of_crowded_anchors(spark, hot):
    rng, rows = random.Random(3), [(k, t if t is None or len(t) < 5000 else t[:5000]) for k, (_, t) in enumerate(corpus() + ODD)]
    for size in (40, 150, 190, 199, 200, 201, 207, 230, 300):  # shared runs of bytes in other surroundings each
        run = "".join(rng.choice("abcdefgh ") for _ in range(size))
        rows += [(1000 * size + k, "".join(rng.choice("xyz ") for _ in range(250)) + run + "".join(rng.choice("xyz ") for _ in range(250 * (k % 2)))) for k in range(6)]
    work = Work(spark)
    got = {r.d: repeats.joined(np.array(r.starts), np.array(r.ends)) for r in repeats.spans(docs_of(spark, rows), work, hot=hot).collect()}
    want = {d: (n, k) for d, _, n, k, _ in repeats_by_force(rows, 200) if n}
    assert {d: (int((z - a).sum()), len(a)) for d, (a, z) in got.items()} == want
    work.drop()


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(docs_of(spark, [])).collect() == []


def test_two_stage_sort_orders_suffixes():
    rng = random.Random(2)
    for alphabet in (b"ab", b"abcdef", bytes(range(256)), b"a"):
        bodies = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
        size = np.array([len(b) for b in bodies])
        ends = np.cumsum(size + 1) - 1
        text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int16) + 1
        text[ends] = 0
        order = repeats.suffix_order(text, ends, size)
        first = ends - size
        suffix = {int(f + i): b[i:] for f, b in zip(first, bodies) for i in range(len(b))}
        got = [suffix[p] for p in order.tolist() if p in suffix]
        assert len(got) == len(suffix) and got == sorted(got)


# Near-duplicate passages --------------------------------------------------------------------------


def shingles_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def passages_by_force(rows, width=46):
    """By row: the words in passages that have a near-duplicate; and its class, the least id linked to it."""
    sh = [shingles_of(t or "") for _, t in rows]
    windows = [(k, i, frozenset(s[i : i + width])) for k, s in enumerate(sh) for i in range(len(s) - width + 1)]
    where = {}
    for x, (_, _, w) in enumerate(windows):
        for g in w:
            where.setdefault(g, []).append(x)
    true, links = [set() for _ in rows], set()
    for x, (k, i, w) in enumerate(windows):
        near = {}
        for g in w:
            for m in where[g]:
                near[m] = near.get(m, 0) + 1
        for m, n in near.items():
            other, j, v = windows[m]
            if m != x and (other != k or abs(j - i) >= width) and n >= 0.8 * (len(w) + len(v) - n) - 1e-9:
                true[k].update(range(i, i + width + 4))
                links.add((k, other))
    label = components_by_force([(a, b) for a, b in links if a != b], range(len(rows)))
    low = {}
    for k, r in label.items():
        if rows[k][0] is not None:
            low[r] = min(rows[k][0], low.get(r, rows[k][0]))
    return true, [low.get(label[k]) for k in range(len(rows))]


def test_near_passages_find_planted_and_report_true_ones(spark):
    rows = corpus()
    got = {r.doc_id: r for r in passages.near_passages(docs_of(spark, rows)).collect()}
    true, label = passages_by_force(rows)
    for (d, _), words, low in zip(rows, true, label):
        assert {p for a, b in zip(got[d].starts, got[d].ends) for p in range(a, b)} == words, d
        assert got[d].class_id == low, d


@needs_tables
def test_near_passages_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    got = {r.doc_id: r for r in passages.query(spark, SF).collect()}
    true, label = passages_by_force(rows)
    runs = [sum(p - 1 not in w for p in w) for w in true]
    assert {d: (len(w), n, c) for (d, _), w, n, c in zip(rows, true, runs, label)} == {d: (r.n_dup_words, r.n_spans, r.class_id) for d, r in got.items()}


def test_near_passages_with_clashing_columns_and_repeated_ids(spark):
    text = " ".join(f"q{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, 7, 8, 9), (1, "short text", 7, 8, 9), (1, text, 7, 8, 9), (None, text, 7, 8, 9), (3, None, 7, 8, 9)], "doc_id long, text string, id long, d long, body long")
    got = sorted(((r.doc_id, r.starts, r.ends, r.class_id) for r in passages.near_passages(docs).collect()), key=str)
    assert got == [(1, [0], [60], 1), (1, [0], [60], 1), (1, [], [], 1), (3, [], [], 3), (None, [0], [60], 1)]


def test_near_passages_find_lone_pairs_at_the_threshold(spark):
    rng, rows = random.Random(11), []
    for k in range(400):  # one word of 50 changed: a Jaccard similarity of 41/51
        w = [f"q{rng.getrandbits(60)}" for _ in range(50)]
        v = list(w)
        v[rng.randrange(5, 45)] = "changed"
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, " ".join(v))]
    got = {r.doc_id: r for r in passages.near_passages(docs_of(spark, rows)).collect()}
    assert sum(got[2 * k + 2].class_id == 2 * k + 1 and got[2 * k + 1].ends == [50] for k in range(400)) >= 399


def test_compare_equals_brute_force():
    rng, width = np.random.default_rng(6), 46
    for trial in range(60):
        base = rng.integers(0, 10_000, 91, np.uint64)
        base[45] = 77_777
        group = []
        for _ in range(8):
            x = base.copy()
            way = rng.integers(5)
            if way == 1:  # blocks in another order
                cut = int(rng.integers(5, 40))
                x[:45] = np.concatenate([x[cut:45], x[:cut]])
            elif way == 2:  # recurring shingles
                x[10:35], x[50:75] = np.resize(x[10:15], 25), np.resize(x[50:53], 25)
            if way:
                x[rng.integers(0, 45, int(rng.integers(0, 6)))] = rng.integers(20_000, 30_000)
            else:
                x[:45] = np.roll(x[:45], int(rng.integers(0, 9)))
            group.append(passages.Piece(x, width))
        starts, label = passages.compare(group, width, 0.8)
        sets = [[set(p.x[i : i + width].tolist()) for i in p.starts] for p in group]
        true, links = [set() for _ in group], []
        for k in range(8):
            for m in range(k):
                near = [(i, j) for i, a in enumerate(sets[k]) for j, b in enumerate(sets[m]) if len(a & b) >= 0.8 * len(a | b) - 1e-9]
                true[k] |= {i for i, _ in near}
                true[m] |= {j for _, j in near}
                links += [(k, m)] if near else []
        assert [set(s.tolist()) for s in starts] == true
        assert dict(enumerate(label.tolist())) == components_by_force(links, range(8))


def test_swapped_blocks_are_near_passages(spark):
    rng, rows = random.Random(12), []
    for k, cut in enumerate((10, 20, 25) * 3):
        w = [f"q{rng.getrandbits(60)}" for _ in range(50)]
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, " ".join(w[cut:] + w[:cut]))]
    got = {r.doc_id: r for r in passages.near_passages(docs_of(spark, rows)).collect()}
    assert all(got[2 * k + 2].class_id == 2 * k + 1 and got[2 * k + 1].ends == got[2 * k + 2].ends == [50] for k in range(9))


def test_hot_passages_lose_no_pair(spark):
    rng, rows = random.Random(13), []
    for k in range(150):  # the edge of the shared words on one side, a changed word on the other
        w = [f"q{rng.getrandbits(60)}" for _ in range(50)]
        v = list(w)
        v[rng.randrange(5, 45)] = "changed"
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, f"{' '.join(words_of(rng, 30))} {' '.join(v)} {' '.join(words_of(rng, 30))}")]
    rows += [(1000 + d, t) for d, t in corpus(3)]
    spans = [sorted((r.doc_id, tuple(r.starts), tuple(r.ends), r.class_id) for r in passages.near_passages(docs_of(spark, rows), bands=2, block=block).collect()) for block in (1024, 1)]
    assert spans[0] == spans[1]


def test_screen_keeps_every_near_passage_and_drops_lone_texts(spark):
    rng, width = np.random.default_rng(9), 46
    for trial in range(40):
        texts = [rng.integers(0, 1 << 60, 120, np.uint64) for _ in range(4)]
        for k in range(1, 3):  # changed, and recurring shingles
            texts[k][20:100] = texts[0][20:100]
            texts[k][rng.integers(20, 100, int(rng.integers(0, 12)))] = rng.integers(0, 1 << 60)
            if trial % 2:
                texts[k][40:48] = texts[k][50:58]
        h, text = np.concatenate(texts), np.repeat(np.arange(4), 120)
        pos, own, new = passages._ordered(h)
        held = np.isin(h, own[~new])
        loose = np.isin(h, h[passages._loose(pos, new, text, width)])
        able = set(passages.able_starts(held, loose, text, width, 0.8).tolist())
        sets = {(k, i): set(x[i : i + width].tolist()) for k, x in enumerate(texts) for i in range(75)}
        near = {k * 120 + i for (k, i), a in sets.items() if any(m != k and len(a & b) >= 0.8 * len(a | b) - 1e-9 for (m, _), b in sets.items())}
        assert near <= able and not any(x >= 360 for x in able)
    work, rows = Work(spark), [(k, " ".join(f"u{k}x{j}" for j in range(70))) for k in range(20)]
    rows.append((20, rows[3][1]))
    chunks = work.save(docs_of(spark, rows).selectExpr("doc_id id", "doc_id d", "cast(text as binary) body").mapInArrow(passages._chunk, "chunk long, ids array<long>, d array<long>, ends binary, body binary"), compression="none")
    assert sorted(r.id for r in passages._able(work, chunks, width, 0.8).collect()) == [3, 20]
    work.drop()


@pytest.mark.parametrize("covered", [0, 1])
def test_pieces_known_to_be_near_are_not_compared_again(monkeypatch, covered):
    calls, similar = [], passages.similar
    monkeypatch.setattr(passages, "similar", lambda *a: calls.append(1) or similar(*a))
    x = np.random.default_rng(5).integers(0, 1 << 60, 46, np.uint64)
    data = [np.roll(x, k).tobytes() for k in (0, 15, 31)]
    zero = pa.array([0] * 3)
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array([4, 5, 6]), zero, pa.array([8 + covered] * 3), pa.array(data)], ["key", "low", "high", "own", "id", "s", "known", "x"])
    got = [r for b in passages._verify(46, 50, 0.8)(iter([batch])) for r in b.to_pylist()]
    assert {(r["id"], *r["starts"], *r["ends"], r["root"]) for r in got} == {(k, 0, 50, 4) for k in (4, 5, 6)}
    assert bool(calls) != bool(covered)


@pytest.mark.parametrize("known, calls_", [([9, 9], 0), ([9, 11], 1), ([9, 8], 1)])
def test_two_pieces_of_one_class_are_not_compared_again(monkeypatch, known, calls_):
    calls, similar = [], passages.similar
    monkeypatch.setattr(passages, "similar", lambda *a: calls.append(1) or similar(*a))
    x = np.random.default_rng(5).integers(0, 1 << 60, 46, np.uint64)
    zero = pa.array([0] * 2)
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array([4, 5]), zero, pa.array(known), pa.array([x.tobytes(), np.roll(x, 23).tobytes()])], ["key", "low", "high", "own", "id", "s", "known", "x"])
    got = [r for b in passages._verify(46, 50, 0.8)(iter([batch])) for r in b.to_pylist()]
    assert {(r["id"], *r["starts"], *r["ends"], r["root"]) for r in got} == {(k, 0, 50, 4) for k in (4, 5)}
    assert len(calls) == calls_


def test_a_piece_with_recurring_shingles_is_spread_once(monkeypatch):
    x = np.random.default_rng(5).integers(0, 1 << 60, 46, np.uint64)
    x[30:35] = x[10:15]
    group, calls, held = [passages.Piece(np.roll(x, k), 46) for k in range(0, 36, 6)], [], passages._held
    monkeypatch.setattr(passages, "_held", lambda *a: calls.append(1) or held(*a))
    starts, label = passages.compare(group, 46, 0.8)
    assert [s.tolist() for s in starts] == [[0]] * 6 and set(label.tolist()) == {0} and len(calls) == 6


def test_kinds_of_gathered_passages():
    rng, width = np.random.default_rng(4), 46
    size = rng.integers(width, 92, 50)
    x = rng.integers(0, rng.integers(20, 200), int(size.sum())).astype(np.uint64)
    parts = passages.Gathered(x, size, np.arange(50) // 5, np.arange(50), np.zeros(50, np.int64), width, 0.8)
    for r in range(50):
        plain, shown = passages.Piece(x[parts.first[r] : parts.first[r] + size[r]], width), parts.shown(r)
        assert shown.size.tolist() == plain.size.tolist() and shown.single == plain.single


def test_a_leader_that_reaches_beyond_the_last_piece():
    rng, width = np.random.default_rng(8), 46
    lead, more = (rng.integers(0, 1 << 60, n, np.uint64) for n in (91, 30))
    data = [lead, np.concatenate([lead[45:], more]), np.concatenate([more, lead[:16]])]
    zero = pa.array([0] * 3)
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, zero, pa.array([4, 5, 6]), zero, pa.array([8, 10, 12]), pa.array([x.tobytes() for x in data])], ["key", "low", "high", "own", "id", "s", "known", "x"])
    got = {r["id"]: r for b in passages._verify(width, 50, 0.8)(iter([batch])) for r in b.to_pylist()}
    sets = [[set(x[i : i + width].tolist()) for i in range(len(x) - width + 1)] for x in data]
    near = [[i for i, a in enumerate(own) if any(len(a & b) >= 0.8 * len(a | b) for other in sets if other is not own for b in other)] for own in sets]
    assert near[0] and near[1] and not near[2] and got.keys() == {4, 5}
    assert all(got[k + 4]["starts"] == [near[k][0]] and got[k + 4]["ends"] == [near[k][-1] + 50] and got[k + 4]["root"] == 4 for k in (0, 1))


def test_compact_windows_partition_all_passages():
    rng = np.random.default_rng(4)
    for n in (5, 46, 47, 200):
        h, text, width = [rng.integers(0, 60, n).astype(np.uint32) for _ in range(2)], np.sort(rng.integers(0, 3, n)), 10
        first, last, key = passages.compact_windows(h, text, width)
        at = 0
        for i in range(n - width + 1):
            if text[i] == text[i + width - 1]:
                own = np.flatnonzero((first <= i) & (i <= last))
                assert len(own) == 1 and int(key[own[0]]) == int(h[0][i : i + width].min()) << 32 | int(h[1][i : i + width].min())
                at += 1
        assert at == (last - first + 1).sum() and (last - first < width).all()


def test_passages_of_odd_rows(spark):
    got = passages.near_passages(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(not r.starts for r in got if r.doc_id in (1, 2, 3, 4))
    assert passages.near_passages(docs_of(spark, [])).collect() == []


# Decontamination ----------------------------------------------------------------------------------


def contaminated_by_force(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, named = split(t), set(), set()
        for i, text in items:
            own = split(text)
            k = min(13, len(own))
            for s in range(len(own) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == own[s : s + k]:
                        hit.update(range(p, p + k))
                        named.add(str(i))
        out.append((d, len(w), len(hit), len(named), decontaminate.digest(list(named)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(5)
    items = [(k, " ".join(words_of(rng, n, 50))) for k, n in enumerate((20, 13, 14, 5, 2, 1, 30))] + [(7, None), (8, "..."), (9, "Straße ÜBER 日本 x1"), (10, items_text := "same text of an item here")] + [(11, items_text)]
    plain = [t for _, t in items if t]
    rows = ODD + [(100 + k, " ".join(words_of(rng, 60, 50)) + (", ".join(["", plain[k % len(plain)].upper(), "end"]) if k % 2 else "")) for k in range(40)] + [(200, plain[0] + " " + plain[0]), (201, plain[0][3:])]
    df = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = decontaminate.judge(decontaminate.find(docs_of(spark, rows), df, block)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == contaminated_by_force([(d, t) for d, t in rows], items)
    assert decontaminate.find(docs_of(spark, []), df, block).collect() == []
    none = decontaminate.judge(decontaminate.find(docs_of(spark, ODD), df.limit(0))).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none)


# Token ids ----------------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library():
    rng = random.Random(6)
    odd = ["", " ", "  ", "a  b", "a   b", " a \n b\n\n c  d\t e", "don't 'll x's'", "\n\n\n a", "a ", "a  ", "é à ñ 12 3.5 _x_ x_y", "<|endoftext|> a", "日本 a", "a b", "x\n \ny", "\r\n a\tb \t c", "½ ² a\x1cb", "ªº ×÷ ʭ", "\x00\x7f"]
    odd += ["".join(rng.choice("ab é'\n\t .,_1Z") for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    coder = tokens.Encoder(tokens.default_tokenizer(), 50, 20)
    for k in range(0, len(odd), 100):
        ids, ends = coder.encode(odd[k : k + 100], b"\1\0\0\0")
        for text, want, low, high in zip(odd[k:], library_ids(odd[k : k + 100]), [0, *ends], ends):
            assert ids[low:high].tolist() == [*want, 1], repr(text)
    ids, ends = coder.encode([])
    assert not len(ids) and not len(ends)


@needs_tables
def test_encoder_equals_the_library_on_the_table(spark):
    texts = [r.text or "" for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    ids, ends = tokens.Encoder(tokens.default_tokenizer()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == library_ids(texts)


def test_new_words_go_to_the_library_together():
    class Counted:
        calls = 0

        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            Counted.calls += 1
            return self.model.tokenize(piece)

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) + rng.choice(["", ",", ".\nB", "!!", "'s", "\n"]) for _ in range(300)) for _ in range(10)]
    coder = tokens.Encoder(tokens.default_tokenizer())
    coder.model = Counted(coder.model)
    ids, ends = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == library_ids(texts)
    assert Counted.calls <= 3 * len(texts)  # what stands before the first blanks


def test_a_piece_goes_to_the_library_once():
    class Recorded:
        def __init__(self, bpe):
            self.bpe, self.sent = bpe, []

        def encode_batch_fast(self, given, **more):
            for x in given:
                self.sent += x.split(coder.letters[0]) if isinstance(x, str) else x
            return self.bpe.encode_batch_fast(given, **more)

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(3, 9))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", ".\n" + rng.choice(words), "'s"]) for _ in range(300)) for _ in range(10)]
    coder = tokens.Encoder(tokens.default_tokenizer())
    coder.bpe = Recorded(coder.bpe)
    ids, ends = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == library_ids(texts)
    sent = [p for p in coder.bpe.sent if p != coder.letters[32]]  # the blank stands before pieces that have none
    assert len(sent) > 200 and len(sent) == len(set(sent))


def test_rows_of_a_table_are_found_after_it_turned():
    seen, found = tokens.Seen(3), []

    def find(keys):
        found.extend(keys)
        return np.array([ord(c) for k in keys for c in k], "<u4"), np.array([len(k) for k in keys], np.int64)

    for keys in (["ab", "c", ""], ["ab", "def"], ["c", "g"], ["ab", "hij", "k"], ["c", "lm"], ["ab", "def"]):
        seen.turn()
        ids, n = seen.ids(seen.slots(keys, find))
        assert "".join(map(chr, ids)) == "".join(keys) and n.tolist() == [len(k) for k in keys]
    assert found == ["ab", "c", "", "def", "g", "hij", "k", "lm", "def"]


def test_grammar_rounds_look_at_pairs_that_may_be_frequent_alone(monkeypatch):
    looked, plain = [], tokens.frequent_pairs
    monkeypatch.setattr(tokens, "frequent_pairs", lambda pairs, *more: looked.append(len(pairs)) or plain(pairs, *more))
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 5000, rng.integers(2, 9)) for _ in range(300)]
    ids = np.concatenate([x for _ in range(2000) for x in (words[rng.integers(300)], rng.integers(0, 5000, 12))])
    ends = np.arange(1000, len(ids) + 1000, 1000).clip(max=len(ids))
    sym, cut, rules = tokens.grammar(ids.astype("<u4"), ends, 5000)
    own = [np.array([k]) for k in range(5000)]
    for a, b in rules:
        own.append(np.concatenate([own[a], own[b]]))
    assert np.array_equal(np.concatenate([own[k] for k in sym]), ids)
    assert np.cumsum([len(own[k]) for k in sym])[cut - 1].tolist() == ends.tolist()
    assert len(looked) > 4 and sum(looked) < 2 * len(ids)


@pytest.mark.parametrize("least", [2, 7])
def test_grammar_stops_when_no_pair_repays_its_rule(least):
    rng = np.random.default_rng(3)
    for ids in (np.full(500, 7), rng.integers(0, 6, 3000), np.tile([1, 2, 3], 400), np.zeros(0, np.int64)):
        ends = np.unique(np.append(rng.integers(0, len(ids) + 1, 4), len(ids)))
        sym, cut, rules = tokens.grammar(ids.astype("<u4"), ends, 100, least)
        seen = {}
        for a, b in zip([0, *cut], cut):
            last = None
            for i in range(a, b - 1):
                pair = (int(sym[i]), int(sym[i + 1]))
                if last != (i - 1, pair):  # in a row of equal ids every other pair
                    seen[pair] = seen.get(pair, 0) + 1
                    last = (i, pair)
                else:
                    last = None
        assert all(n < least for n in seen.values()) and (len(rules) or len(ids) < 9)


def test_token_shards_round_trip(spark, tmp_path):
    rows = corpus() + [(1000 + (d or 0), t) for d, t in ODD]
    work = Work(spark)
    at = work.path("s")
    tokens.write(docs_of(spark, rows), at, tokens.default_tokenizer(), shard_tokens=700)
    got = tokens.index(work, tokens.read(spark, at)).orderBy("doc_id", "start").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    start = 0
    for r, (d, _), ids in zip(got, rows, library_ids([t or "" for _, t in rows]), strict=True):
        own = np.array([*ids, 0], "<u4")
        assert (r.doc_id, r.n_tokens, r.ids_crc32) == (d, len(own), zlib.crc32(own.tobytes()))
        if [x[0] for x in rows].count(d) == 1:
            assert r.start == start
        start += len(own)
    work.drop()
    assert tokens.round_trip(docs_of(spark, [])).collect() == []
    assert len(tokens.round_trip(docs_of(spark, ODD)).collect()) == len(ODD)


@pytest.mark.parametrize("terminals", [60, 70_000])
def test_grammar_expands_to_the_ids(terminals):
    rng = np.random.default_rng(8)
    docs = [np.append(rng.choice([5, 6, 7, 7, 7, 50], rng.integers(0, 900)), 0).astype("<u4") for _ in range(20)]
    data = tokens.pack(3, 4, [*range(19), None], np.concatenate(docs), np.cumsum([len(d) for d in docs]), terminals)
    (shard,) = tokens.shards(data + b"\n")
    whole = np.concatenate(docs)
    assert len(shard.rules) and len(shard.sym) < len(whole) and (shard.part, shard.place) == (3, 4)
    assert all((shard.document(k) == d).all() for k, d in enumerate(docs))
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(whole) + 1, 2))
        assert shard.ids(int(a), int(b)).tolist() == whole[a:b].tolist()


# WARC ---------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, small = "ü" * 200, "tiny"
    pages = [(5, "http://a/ b\n", big), (3, "http://c", big), (9, None, small), (2, "u", small), (7, "x", None), (8, "y", ""), (3, "http://c", big), (None, "n", big), (11, "z", "WARC/1.1\r\n\r\nContent-Length: 3\r\n" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    work = Work(spark)
    at = work.path("w")
    warc.write_archive(df, at, work)
    got = warc.read_archive(spark, at).collect()
    assert len(got) == len(pages)
    told = sorted(((r.page_id, r.record_type, r.refers_to, bytes(r.payload).decode(), r.payload_digest) for r in got), key=repr)
    want = sorted(((p, "revisit" if h == big and p != 3 else "response", 3 if h == big and p != 3 else None, h or "", hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages), key=repr)
    assert told == want
    assert spark.read.parquet(f"{at}/payloads").count() == len({h or "" for _, _, h in pages})
    assert {r.url for r in got} == {"http://a/%20b%0A", "http://c", None, "u", "x", "y", "n", "z"}
    warc.export(warc.read_archive(spark, at), work.path("x"))
    raw = b"".join(open(f.removeprefix("file:"), "rb").read() for f in spark.read.text(f"{work.root}/{work.n:03d}-x").inputFiles())
    seen = []
    while raw:
        head, _, raw = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        seen.append(raw[:n].decode())
        assert raw[n : n + 4] == b"\r\n\r\n"
        raw = raw[n + 4 :]
    assert sorted(seen) == sorted("" if t == "revisit" else h for _, t, _, h, _ in want)
    work.drop()
    empty = df.limit(0)
    work = Work(spark)
    warc.write_archive(empty, at := work.path("w"), work)
    assert warc.read_archive(spark, at).collect() == []
    work.drop()


# Nearest neighbours -------------------------------------------------------------------------------


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[100:200] = x[100]  # copies: ties go to smaller ids
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    odd = [(1000, None), (1050, [0.0] * 16), (1001, [float("nan")] + [1.0] * 15), (1002, [1.0] * 3), (None, [1.0] * 16), (1003, [None] + [1.0] * 15), (1004, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), block=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    n, hit = np.linalg.norm(x, axis=1), 0
    for q in range(0, 600, 50):
        s = x @ x[q] / (n * n[q])
        s[q] = -2
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for _, v, c in own)
        hit += len(set(best.tolist()) & {v for _, v, _ in own})
    assert len({c for q in (100, 150) for _, _, c in got[q]}) == 1  # equal vectors, equal scores
    assert hit >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    for scale in (1e-200, 1e200, 5e-324 * 2**60):  # sizes that over- or underflow when squared
        tiny = spark.createDataFrame([(k, [float(v * scale) for v in r]) for k, r in enumerate(x[:60])] + [(100, [1.0, 2.0]), (150, [2.0, 1.0])], "vec_id long, embedding array<double>")
        own = ann.nearest(tiny, tiny.where("vec_id % 50 = 0")).collect()
        assert len(own) == 12 and {(r.query_id, r.vec_id) for r in own if r.query_id >= 100} == {(100, 150), (150, 100)}
        s = x[:60] @ x[50] / (n[:60] * n[50])
        assert all(abs(r.score - s[r.vec_id]) < 1e-3 for r in own if r.query_id == 50)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


@needs_tables
def test_nearest_query_recall(spark):
    rows = spark.read.parquet(SF + "/embeddings.parquet").collect()
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, hit, every = {}, 0, 0
    for r in ann.query(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for k in np.flatnonzero(ids % 50 == 0):
        score = np.where(ids == ids[k], -2, x @ x[k])
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hit, every = hit + len(best & got[int(ids[k])]), every + 5
    assert hit >= 0.9 * every


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(10)
    code = rng.integers(0, 256, (500, 8), dtype=np.uint8)
    index = ann.Index(code)
    for radius in (0, 3, 8, 17, 25, 40, 64):
        for q in code[:5]:
            want = np.flatnonzero(np.bitwise_count(code ^ q).sum(1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


# Language ID, licenses, mixing --------------------------------------------------------------------


@needs_tables
def test_language_id_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert {d.doc_id for d in held} == {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1}
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_id_of_odd_rows(spark):
    train = docs_of(spark, [(k, f"the house and the river {k}" if k % 2 else f"la maison et la rivière {k}") for k in range(60)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    model = langid.fit(train)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs_of(spark, [*ODD, (50, "12 34"), (51, "the river")]).withColumn("score", F.lit(1)), model).collect()]
    by = {d: p for d, p, _ in got}
    assert len(got) == len(ODD) + 2 and by[1] == by[2] == by[3] == by[50] == "und" and by[51] == "en" and by[10] in ("en", "fr")
    assert all(s == 0 for _, p, s in got if p == "und")
    assert langid.fit(train.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.identify(docs_of(spark, ODD), None).collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), model).collect() == []


def test_language_fit_holds_one_table_of_its_rows(spark):
    rng = random.Random(14)
    train = docs_of(spark, [(k, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))) for k in range(1200)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    own = langid.shares(train.where("doc_id < 20")).collect()
    assert len(own) == 20 and all(len(r.x) <= 6 * 280 and abs(langid.dense([r.x])[0, :-1].sum() - 1) < 1e-5 for r in own)
    tracemalloc.start()
    assert langid.fit(train, per_lang=300) is not None
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 600 * 4 * langid.BUCKETS


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [*ODD, (20, f"prose here\n{mit[0]}\nmore"), (21, gpl[1].replace(" ", "\n", 3)), (22, f"a\n\n{mit[1][:300]}\n{mit[1][300:]}\n\nb"), (23, "Released under the Foo License"), (24, f"{mit[0]}\n{gpl[0]}")]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert [got[k].license for k in (20, 21, 22, 24)] == ["MIT", "GPL-3.0", "MIT", "GPL-3.0"] and got[23].license is None
    assert got[24].n_passages == 3 and got[20].score == 1.0 and all(got[d].license is None for d, _ in ODD)
    for n in range(1, 40):  # no size out of bounds can reach the threshold
        low, high = licenses.bounds(n, 0.8)
        assert all((2 * min(a, n) / (a + n) >= 0.8) == (low <= a <= high) for a in range(1, 99))
    assert licenses.scan(docs_of(spark, [])).collect() == []


def test_mixing(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(300):
        kind = k % 3
        w = words_of(rng, 40) + (["vile"] * 3 if kind == 2 else ["||| %%% |||"] * 30 if kind == 1 else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(kind != 1), int(kind == 2)))
    docs, marks = docs_of(spark, rows + ODD[:3]), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, marks).collect()}
    named = [(got[k].p_clean, got[k].p_low, got[k].p_toxic) for k in range(300)]
    assert np.mean([np.argmax(p) == k % 3 for k, p in enumerate(named)]) > 0.95
    total = np.array([sum(r.rate * r.tokens * r[f"p_{d}"] for r in got.values()) for d in mixing.DOMAINS])
    assert np.abs(total / total.sum() - [0.95, 0.05, 0]).max() < 0.02 and all(r.rate >= 0 for r in got.values())
    assert {r.rate > 0 for r in mixing.mix(docs, marks.limit(0)).collect()} == {True}
    assert mixing.mix(docs.limit(0), marks).collect() == []


def test_span_hashes_tell_spans_apart():
    body = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    s = Spans(body)
    at = {}
    for i in range(len(body)):
        for j in range(i + 1, len(body) + 1):
            at.setdefault(bytes(body[i:j]), set()).add(int(s.hash(np.array([i]), np.array([j]))[0]))
    assert all(len(v) == 1 for v in at.values()) and len(set().union(*at.values())) == len(at)


# Queries ------------------------------------------------------------------------------------------


@needs_tables
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


CLASH = ("gone_", "bad_id", "Score", "lang_pred", "dropped_row", "row", "fp", "root", "d", "t", "id", "repeated_row", "tokens", "p", "a", "b", "n", "h")


def stage_docs(spark, rows):
    df = docs_of(spark, rows)
    return df.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in CLASH))


def kept_by_stage(spark, stage, rows):
    docs = stage_docs(spark, rows)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema["Score"].dataType == docs.schema["Score"].dataType
    got = out.collect()
    assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in got for c in CLASH)
    return sorted(((r.doc_id, r.text) for r in got), key=repr)


EXTRA = [(None, None), (None, "x" * 300), (5, "another text of this id"), (5, "another text of this id"), (7, "12 34"), (30, "tie"), (31, "tie")]


@needs_tables
def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stage_docs(spark, []), SF).collect() == []


@needs_tables
def test_language_stage_drops_rows_without_letters_alone(spark):
    rows = ODD + EXTRA + [(k, f"the house and the river {k}") for k in range(100, 140)]
    want = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    assert kept_by_stage(spark, langid.stage, rows) == sorted(want, key=repr)


@needs_tables
def test_simhash_stage_equals_brute_force(spark):
    rows = corpus() + ODD + EXTRA + [(5, corpus()[0][1])]
    prints = [simhash_by_force(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    label = components_by_force(links, range(len(rows)))
    got = kept_by_stage(spark, simhash.stage, rows)
    assert len(got) == len(set(label.values()))
    for root in set(label.values()):
        group = [rows[k] for k in label if label[k] == root]
        low = min((d for d, _ in group if d is not None), default=None)
        assert sum(got.count(x) for x in set(group) if x[0] == low) >= 1


@needs_tables
def test_decontamination_stage_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    long = next(t for _, t in items if len(words(t)) > 16)
    rng = random.Random(8)
    rows = ODD + EXTRA + [(40, long), (None, long), (41, " ".join(words_of(rng, 900)) + " " + " ".join(words(long)[:13])), (42, " ".join(words_of(rng, 900) + words(long)[:12])), (41, "clean text")]
    windows = {tuple(w[i : i + 13]) for w in (words(t) for _, t in items) for i in range(len(w) - 12)}
    hit = lambda t: any(tuple(w[i : i + 13]) in windows for w in [words(t)] for i in range(len(w) - 12))
    want = [x for x in rows if not hit(x[1])]
    assert len(want) == len(rows) - 3 and kept_by_stage(spark, decontaminate.stage, rows) == sorted(want, key=repr)


@needs_tables
def test_mixing_stage_keeps_the_clean_and_odd_rows(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (9001, ""), (9002, None)]
    got = kept_by_stage(spark, mixing.stage, rows)
    own = {r.doc_id: r for r in mixing.mix(docs, spark.read.parquet(SF + "/labels.parquet")).collect()}
    assert {(None, None), (9001, ""), (9002, None)} <= set(got)
    assert {d for d, r in own.items() if r.p_clean >= 0.5} <= {d for d, _ in got} and len(got) < len(rows)


def test_rates_are_the_least_squares_optimum(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([0.4, 0.3, 0.3], 40), rng.integers(5, 80, 40)
    rows = spark.createDataFrame([(k, int(n[k]), [float(x) for x in p[k]]) for k in range(40)], "doc_id long, tokens long, p array<double>")
    got = mixing.rates(Work(spark), rows, {"clean": 0.6, "low": 0.3, "toxic": 0.1}, most=60, tolerance=1e-9)
    r = np.array([x.r for x in got.select("doc_id", F.col("rate").alias("r")).orderBy("doc_id").collect()])
    a = (p * n[:, None]).T
    share = np.array([0.6, 0.3, 0.1])
    target = share * min(a.sum(1)[k] / share[k] for k in range(3) if share[k])
    slope = a.T @ np.linalg.solve(a @ a.T, a @ r - target)  # the optimality conditions, by another solver
    assert (r >= 0).all() and np.abs(slope[r > 1e-6]).max() < 1e-3 and slope[r <= 1e-6].min(initial=0) > -1e-3


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, n = Work(spark), docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = work.save(stage(spark, docs, SF))
        assert out.columns == docs.columns and 0 < out.count() <= n
        docs, n = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.collect())
    work.drop()
