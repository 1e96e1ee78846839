"""Soft-membership mixing: document rates whose expected token totals by domain match target weights.

The label table gives three domains: toxic (toxic = 1), low (quality = 0) and clean. A logistic regression
over the presence of terms is fitted on at most `per_domain` labelled documents of each, those of the
smallest hashes, weighted by the domains' shares of all labels. Its terms are the `vocabulary` words that
tell the domains apart best, of those with a chi-square of `least` or more, and steps of three numbers: the
share of letters, the share of distinct words and the length of words. It gives each document the
probabilities p of the domains.

A document of n words has n * p expected tokens of each domain; with rates r >= 0 the totals are A r. The
rates minimise (A r - t)' G^-1 (A r - t), where t are the targets and G = A A', by projected gradient: all
rates start at one; a step takes A' G^-1 (A r - t) off and clips at zero. In this metric the gradient's
Lipschitz constant is one, so the step is one. A step is one sum over the documents that brings as
many numbers to the driver as there are domains; the rates themselves stay an expression of those numbers. It stops
after `most` steps, or where one takes less than a hundred-thousandth off what is minimised; targets of zero are only neared, as
every document has some probability of every domain.

The targets are the weights times a budget; by default the largest budget for which no domain needs more
than it is expected to have.

Only DataFrame functions run on the main path.

Defined results: null and wordless texts have no tokens and rate 1. Labels of null or unknown doc_id and
null labels are ignored; without any labels all documents are clean. Repeated label rows count each.
An empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, row_key, table, without

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), lambda w: w != "")


def _step(name: str, value: Column, step: float, most: int) -> Column:
    """A pseudo-word for a number: its name and how many steps it has."""
    return F.concat(F.lit(f"\x01{name}"), F.least(F.floor(value / step), F.lit(most)).cast("string"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, tokens (how many words), terms (distinct words and pseudo-words), beside the other columns
    that docs has."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *others, F.length(F.coalesce("text", F.lit(""))).alias("n_"), _words(F.col("text")).alias("words_"))
    held = held.select("*", F.size("words_").cast("long").alias("tokens"), F.array_distinct("words_").alias("distinct_"), F.length(F.array_join("words_", "")).alias("letters_"))
    some = F.greatest(F.col("tokens"), F.lit(1))
    steps = F.array(
        _step("letters", F.col("letters_") / F.greatest("n_", F.lit(1)), 0.025, 40),
        _step("distinct", F.size("distinct_") / some, 0.05, 20),
        _step("long", F.col("letters_") / some, 0.5, 20),
    )
    return held.select("doc_id", *others, "tokens", F.concat("distinct_", steps).alias("terms"))


class Posterior:
    """A logistic regression as plain numbers: the start, and what each term adds, by domain."""

    def __init__(self, start: list[float], weight: dict[str, list[float]]):
        self.start, self.weight, self.terms = start, weight, sorted(weight)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with p, the probabilities of the domains, in place of its terms. Each step is a column of its
        own, so that none is computed twice."""
        logs = F.array(*map(F.lit, self.start))
        if self.terms:
            added = F.create_map(*(x for w in self.terms for x in (F.lit(w), F.array(*map(F.lit, self.weight[w])))))
            seen = F.array_intersect("terms", F.array(*map(F.lit, self.terms)))
            logs = F.aggregate(seen, logs, lambda acc, w: F.zip_with(acc, F.element_at(added, w), lambda a, b: a + b))
        n = len(self.start)
        df = df.withColumn("logs_", logs)
        df = df.withColumn("odds_", F.array(*(F.exp(F.col("logs_")[k] - F.array_max("logs_")) for k in range(n))))
        total = sum(F.col("odds_")[k] for k in range(n))
        return df.withColumn("p", F.array(*(F.col("odds_")[k] / total for k in range(n)))).drop("terms", "logs_", "odds_")


def fit(docs: DataFrame, labels: DataFrame, per_domain: int = 1500, vocabulary: int = 250, least: float = 40.0) -> Posterior:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    own = labels.select(F.col("doc_id").cast("long").alias("labelled"), domain.alias("domain")).where("labelled is not null and domain is not null")
    share = {r.domain: r.n for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in range(len(DOMAINS)):
        top = own.where(F.col("domain") == c).orderBy(F.xxhash64("labelled"), "labelled").limit(per_domain)
        chosen = top if chosen is None else chosen.union(top)
    known = features(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("labelled")).drop("labelled"))
    work = Work(docs.sparkSession)
    known = work.save(known.select("domain", "terms"), "labelled")
    sampled = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sampled.get(c, 0) for c in range(len(DOMAINS))]
    if not sum(n):
        return Posterior([0.0] + [-50.0] * (len(n) - 1), {})
    counts = known.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(*(F.count_if(F.col("domain") == c).alias(f"n{c}") for c in range(len(n))))
    spread = F.lit(0.0)
    every = sum(F.col(f"n{c}") for c in range(len(n)))
    for c in range(len(n)):  # chi-square of presence
        if n[c]:
            want = every / sum(n) * n[c]
            spread = spread + (F.col(f"n{c}") - want) * (F.col(f"n{c}") - want) / (want * (1 - every / (sum(n) + 1)))
    step = F.col("term").startswith("\x01")
    terms = sorted(r.term for r in counts.where((every >= 5) & (step | (spread >= least))).orderBy(F.desc(step), F.desc(spread), "term").limit(vocabulary + 100).collect())
    rows = known.select("domain", F.array_intersect("terms", F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("seen")).collect()
    work.drop()
    at = {w: k for k, w in enumerate(terms)}
    x, y, weight = np.zeros((len(rows), len(terms) + 1)), np.zeros((len(rows), len(n))), np.zeros(len(rows))
    for k, r in enumerate(rows):
        x[k, [at[w] for w in r.seen]] = 1
        y[k, r.domain], weight[k] = 1, share[r.domain] / n[r.domain]
    x[:, -1] = 1
    theta = regression(x, y, weight / weight.sum())
    missing = [c for c in range(len(n)) if not n[c]]
    theta[-1, missing] -= 50
    return Posterior(theta[-1].tolist(), {w: theta[k].tolist() for w, k in at.items()})


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, rounds: int = 600) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient descent."""
    theta = v = np.zeros((x.shape[1], y.shape[1]))
    step, t = 1 / (0.5 * (weight @ (x * x).sum(1)) + reg), 1.0
    for _ in range(rounds):
        z = x @ v
        z = np.exp(z - z.max(1, keepdims=True))
        new = v - step * (x.T @ ((z / z.sum(1, keepdims=True) - y) * weight[:, None]) + reg * v)
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, theta = new + (was - 1) / t * (new - theta), new
    return theta


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan, for a matrix of a few rows; rows without any mass stay zero."""
    n = len(m)
    a = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(m)]
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        if abs(a[i][i]) < 1e-300:
            return [[(1 / m[r][r] if m[r][r] else 0.0) * (r == c) for c in range(n)] for r in range(n)]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i])]
    return [row[n:] for row in a]


def rates(work: Work, members: DataFrame, weights: dict[str, float], budget: float | None = None, most: int = 30, tolerance: float = 1e-4, fixed: Column | None = None) -> DataFrame:
    """members (tokens, p and others) with their rate. Where `fixed` holds, the rate stays one, and the others are fitted
    around it. Every fifth step is written out, so that plans stay small."""
    n = len(DOMAINS)
    a = [F.col("p")[k] * F.col("tokens") for k in range(n)]
    free = F.lit(True) if fixed is None else ~fixed
    sums = members.agg(*(F.sum(a[k]).alias(f"e{k}") for k in range(n)), *(F.sum(F.when(free, a[j] * a[k])).alias(f"g{j}{k}") for j in range(n) for k in range(j, n))).first()
    have = [sums[f"e{k}"] or 0.0 for k in range(n)]
    share = [weights.get(d, 0.0) / (sum(weights.values()) or 1.0) for d in DOMAINS]
    if budget is None:
        budget = min((have[k] / share[k] for k in range(n) if share[k] > 0), default=0.0)
    target = [s * budget for s in share]
    gram = [[(sums[f"g{min(j, k)}{max(j, k)}"] or 0.0) * (1 + 1e-9 * (j == k)) for k in range(n)] for j in range(n)]
    inverse, rate, now, was = _inverse(gram), F.lit(1.0), have, None
    for turn in range(most):
        miss = [(now[k] or 0.0) - target[k] for k in range(n)]
        step = [sum(inverse[j][k] * miss[k] for k in range(n)) for j in range(n)]
        left = sum(x * y for x, y in zip(miss, step))  # what is minimised; no step raises it
        if left < tolerance**2 or was is not None and was - left < tolerance * left / 10:
            break
        was = left
        rate = F.when(free, F.greatest(F.lit(0.0), rate - sum(F.lit(step[k]) * a[k] for k in range(n)))).otherwise(F.lit(1.0))
        if turn % 5 == 4:
            members, rate = work.save(members.withColumn("rate", rate), "rates"), F.col("rate")
        now = members.agg(*(F.sum(a[k] * rate).alias(f"e{k}") for k in range(n))).first()
    return members.withColumn("rate", rate)


def members(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without text, tokens and p, the probabilities of the domains."""
    model = fit(docs, labels, **options)
    return model.apply(features(docs))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, **options) -> DataFrame:
    """A row per document: doc_id, tokens, p_clean, p_low, p_toxic and rate."""
    work = Work(docs.sparkSession)
    own = work.save(members(docs.select("doc_id", "text"), labels, **options), "members")
    own = rates(work, own, weights or WEIGHTS, budget)
    return own.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are most probably clean stay, the domain of which the targets want most; the rates of the others
    are fitted around them, and each stays with the probability of its rate, drawn from a hash of its doc_id and text. So
    the kept mixture meets the targets wherever the others can bring it there. The decisions are a table of their
    own: as a filter over the texts, the optimizer would put the whole classifier into every step of the rate.
    Defined results: null and wordless texts have no tokens, count as most probably clean or not by their terms, and have
    rate one, so they stay; rows are judged one by one, whatever their doc_id, null or repeated; rows equal in doc_id and
    text go together. Extra columns of any name pass through. An empty table stays empty; without labels all stay."""
    model, work = fit(docs, table(spark, sf_dir, "labels")), Work(spark)
    own = work.save(model.apply(features(docs.select(row_key().alias("doc_id"), "text"))), "members")
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    gone = rates(work, own, WEIGHTS, fixed=F.col("p")[0] >= 0.5).where(~(F.col("rate") > draw)).select("doc_id").distinct()
    return without(docs, work.save(gone, "gone"))
