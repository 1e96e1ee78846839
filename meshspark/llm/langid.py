"""Language identification in two steps: the language family, then one-versus-one linear support
vector machines between the languages of that family.

Features are hashed letter trigrams of the whole text, in lower case, with every other ASCII byte as a
space; a text is the mean of its trigrams. Families come from a table of language codes; a code that
it lacks is a family of its own. A family is predicted by one-versus-one machines as well. The models
are fitted on the driver from a bounded sample: `per_lang` labelled rows a language, each a vector of the 4,096 shares
of its whole text, counted on the executors. Only shares that are not zero are sent and kept; a machine holds the one dense
table of its own rows, 16 KB each. Predictions read whole texts.

Defined results: a text that is null or has no letter is `und` with score 0. Without labelled rows
every text is `und`. Repeated rows get the same answer each; a null doc_id is not held out and is never
learned from."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, pieces, table

# fixed values: language families by ISO 639-1 code
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS = 1 << 12

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigrams(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bucket for each byte: 0 where no trigram of this text starts, or one without two letters."""
    low = _FOLD[body]
    after = np.zeros(len(low), bool)
    after[1:] = low[:-1] == 0xC3  # capital letters of Latin-1, as UTF-8
    low = np.where(after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 32, low).astype(np.uint32)
    out = np.zeros(len(low), np.int64)
    if len(low) >= 3:
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        spaces = (low == 32).astype(np.uint8)
        hashed = ((code * np.uint32(2654435761)) >> np.uint32(12)).astype(np.int64) % (BUCKETS - 1) + 1
        out[:-2] = np.where(spaces[:-2] + spaces[1:-1] + spaces[2:] >= 2, 0, hashed)
    for back in (1, 2):
        ends = offsets[1:] - back
        out[ends[(ends >= offsets[:-1]) & (ends >= 0)]] = 0
    return out


def _means(grams: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the mean weight of its trigrams, for each column of weights; weights[0] is zero."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        n = np.maximum(np.add.reduceat(grams > 0, offsets[full], dtype=np.int64), 1)
        for c in range(weights.shape[1]):
            out[full, c] = np.add.reduceat(weights[:, c][grams], offsets[full]) / n
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def packed(n: np.ndarray) -> bytes:
    """The shares of counts by bucket: the buckets that occur, as 2-byte integers, then their shares, as 4-byte floats."""
    at = np.flatnonzero(n)
    return at.astype("<u2").tobytes() + (n[at] / max(1, n.sum())).astype("<f4").tobytes()


def dense(x: list[bytes]) -> np.ndarray:
    """A row for each packed vector: its shares by bucket, and a one."""
    out = np.zeros((len(x), BUCKETS + 1), np.float32)
    out[:, -1] = 1
    for row, data in zip(out, x):
        n = len(data) // 6
        row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f4", offset=2 * n)
    return out


class Machine:
    """A linear SVM (squared hinge) between two classes, and a slope that turns margins to odds. z: the rows as of
    dense(), which are centred and scaled in place."""

    def __init__(self, z: np.ndarray, y: np.ndarray, rounds: int = 150, reg: float = 1e-4):
        x, cost = z[:, :-1], np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
        self.mean = x.mean(0)
        x -= self.mean
        scale = float(np.sqrt(np.concatenate([(x[k : k + 64] ** 2).sum(1) for k in range(0, len(x), 64)]).mean())) or 1.0
        x /= scale
        w = v = np.zeros(z.shape[1], np.float32)
        y, top = y.astype(np.float32), np.ones(z.shape[1], np.float32)
        for _ in range(20):  # the largest curvature
            top = z.T @ (cost * (z @ top))
            most = float(np.linalg.norm(top))
            top /= most
        step, t = 1 / (2.2 * most + reg), 1.0
        for _ in range(rounds):
            slack = np.maximum(0, 1 - y * (z @ v))
            new = v - step * (reg * v - 2 * (z.T @ (cost * y * slack)))
            t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            v, w = new + np.float32((was - 1) / t) * (new - w), new
        margin, slope = y * (z @ w), 1.0
        for _ in range(100):
            slope += 2 * (cost * margin * _sigmoid(-slope * margin)).sum()
        self.slope = float(np.clip(slope, 1, 20))
        self.w, self.b = w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ self.mean)


class Model:
    """The fitted machines: between families, and between the languages of each."""

    def __init__(self, x: list[bytes], langs: list[str]):
        named = np.array(langs, dtype=object)
        family = np.array([FAMILY_OF.get(c, c) for c in langs], dtype=object)
        self.families = {f: sorted(set(named[family == f])) for f in sorted(set(family))}
        self.pairs, weights, bias = {}, [np.zeros(BUCKETS)], [0.0]
        for of, names in [(family, list(self.families)), *((named, v) for v in self.families.values())]:
            for a, b in itertools.combinations(names, 2):
                rows = np.flatnonzero((of == a) | (of == b))
                m = Machine(dense([x[k] for k in rows]), np.where(of[rows] == a, 1.0, -1.0))
                m.w[0] = 0
                self.pairs[a, b] = len(weights)
                weights.append(m.w * m.slope)
                bias.append(m.b * m.slope)
        self.weights, self.bias = np.stack(weights, 1), np.array(bias)

    def _shares(self, names: list[str], odds: np.ndarray) -> np.ndarray:
        """Probabilities of the names from those of their pairs."""
        logs = np.zeros((len(odds), len(names)))
        for i, j in itertools.combinations(range(len(names)), 2):
            p = np.clip(odds[:, self.pairs[names[i], names[j]]], 1e-12, 1 - 1e-12)
            logs[:, i] += np.log(p)
            logs[:, j] += np.log(1 - p)
        logs = np.exp(logs - logs.max(1, keepdims=True))
        return logs / logs.sum(1, keepdims=True)

    def predict(self, grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = _sigmoid(_means(grams, offsets, self.weights) + self.bias)
        groups = list(self.families)
        first = self._shares(groups, odds)
        chosen, lang, score = first.argmax(1), np.empty(len(odds), object), np.zeros(len(odds))
        for k, f in enumerate(groups):
            rows = np.flatnonzero(chosen == k)
            inner = self._shares(self.families[f], odds[rows])
            if len(rows):
                lang[rows] = np.array(self.families[f], dtype=object)[inner.argmax(1)]
                score[rows] = first[rows, k] * inner.max(1)
        return lang, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, t, x): the shares of a whole text's trigrams by bucket, packed; t, a hash of the text."""

    def run(batches):
        for b in batches:
            body, offsets = flat(b.column(3))
            out = []
            for i, j in pieces(offsets):
                cut = offsets[i : j + 1] - offsets[i]
                grams = trigrams(body[offsets[i] : offsets[j]], cut)
                for x, y in zip(cut[:-1], cut[1:]):
                    n = np.bincount(grams[x:y], minlength=BUCKETS)
                    n[0] = 0
                    out.append(packed(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["doc_id", "lang", "t", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, lang string, t long, x binary")


def fit(docs: DataFrame, per_lang: int = 400) -> Model | None:
    """Fitted on at most per_lang doc_ids of each language, those with the smallest hashes; none of them held out. They
    are chosen from ids and languages alone, then only the vectors of their texts come to the driver, 6 bytes a bucket that occurs."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    langs = sorted(r[0] for r in known.select("lang").distinct().collect())
    chosen = None
    for lang in langs:
        top = known.where(F.col("lang") == lang).select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(per_lang)
        chosen = top if chosen is None else chosen.union(top)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()] if langs else []
    if not ids:
        return None
    rows = shares(docs.where(F.col("doc_id").cast("long").isin(ids)).where("lang is not null")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.t))
    return Model([r.x for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs and lang_pred, score, in place of columns that have these names. Other columns pass through unread."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at, schema = keep.index("text"), StructType([docs.schema[c] for c in keep])
    schema = schema.add("lang_pred", StringType()).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(at)
            body, offsets = flat(texts)
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, j in pieces(offsets) if m else ():
                own, cut = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                got = m.predict(trigrams(own, cut), cut)
                letter = (_FOLD[own] != 32) & (own < 128)
                known = np.concatenate([[0], np.cumsum(letter)])[cut]
                for k in range(i, j):
                    if known[k - i + 1] > known[k - i] or any(map(str.isalpha, texts[k].as_py() or "")):
                        lang[k], score[k] = got[0][k - i], got[1][k - i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those that are null or without any letter. Defined results: every row is
    judged by its own text, read whole, whatever its doc_id or how often it occurs; all columns, of any name and lang and score
    among them, pass through as they are. An empty table stays empty; without labelled rows nothing has a language."""
    model, names = fit(docs), docs.columns
    plain = ["text" if c == "text" else f"c{k}" for k, c in enumerate(names)]
    return identify(docs.toDF(*plain), model).where("lang_pred <> 'und'").select(*(F.col(c).alias(n) for c, n in zip(plain, names)))
