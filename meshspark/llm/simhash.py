"""SimHash near-duplicates: fingerprints embedded as popcounts per segment, joined on a grid.

A fingerprint's 16 nibbles give 16 bit counts of 0 to 4. The Manhattan distance of two such points
is at most the Hamming distance of the fingerprints, so points farther apart than the radius can't
link. Two points within 2 of each other share a cell at distance 1 or less from both: every distinct
fingerprint visits its own cell and those one step away, at most 33. A cell that two fingerprints
visit gives one pair, verified by its XOR. The fingerprints of fuller cells are verified the same
way in Hamming space: within 2 bits of each other they share a word at most one bit from both, and a
word has 65 such fingerprints at most, so no group can grow. Copies are one fingerprint from the
start. Links become components by star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, fresh, row_key, table, without
from .components import connected_components

SHINGLE, SEED = 3, 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64 bits; zero without words. A text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, seed) for g in grams), ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): fp is the fingerprint as a signed long, row the key of the row. Null texts have no words."""

    def run(batches):
        for b in batches:
            got = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.view(np.int64))], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row")).mapInArrow(run, "doc_id long, row long, fp long")


def counts_per_nibble(fp: Column) -> Column:
    """16 popcounts of 4-bit segments, each in its own nibble of a long."""
    halves = []
    for half in (fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)):  # no overflow in 32 of 64 bits
        pairs = half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
        even = F.lit(0x33333333)
        halves.append(pairs.bitwiseAND(even) + F.shiftright(pairs, 2).bitwiseAND(even))
    return halves[0].bitwiseOR(F.shiftleft(halves[1], 32))


def _cells(fps: DataFrame) -> DataFrame:
    at = F.col("at")
    steps = [at]
    for k in range(0, 64, 4):
        here, step = F.shiftrightunsigned(at, k).bitwiseAND(F.lit(15)), F.shiftleft(F.lit(1).cast("long"), k)
        steps += [F.when(here > 0, at - step), F.when(here < 4, at + step)]
    return fps.select("fp", counts_per_nibble(F.col("fp")).alias("at")).select("fp", F.explode(F.array(*steps)).alias("cell")).where("cell is not null")


def links(work: Work, fps: DataFrame) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints of at most 2 differing bits to hold together
    every component of all such pairs."""
    cells = _cells(fps)
    full = work.save(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    two = full.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()
    many = cells.join(full.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    balls = many.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)))).alias("word"))
    stars = balls.groupBy("word").agg(F.collect_list("fp").alias("in")).where("size(in) > 1").select(F.array_min("in").alias("a"), F.explode("in").alias("b"))
    return two.unionByName(stars.where("a <> b").distinct())


def _rooted(work: Work, prints: DataFrame) -> DataFrame:
    """(fp, low, root, child): the least doc_id of each fingerprint, and the least fingerprint that it reaches."""
    fps = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    label = connected_components(work, links(work, fps)).withColumnRenamed("node", "fp")
    return work.save(fps.join(label, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("child")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per input row. Fingerprints of at most 2 differing
    bits are linked; component_id is the smallest doc_id reachable. Null and wordless texts have
    fingerprint zero; a null doc_id stays null and takes its class's id."""
    work = Work(docs.sparkSession)
    prints = work.save(fingerprints(docs), "prints")
    rooted = _rooted(work, prints)
    least = rooted.join(rooted.where("child").select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(least, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    out = prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return work.result(out)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, and of rows that share it the one of the
    least key. Defined results: rows without a doc_id stay only where no row of the component has one, one of them;
    rows that repeat a doc_id with other texts are judged by their own texts; rows equal in doc_id and text
    are one group, of which one stays, whatever their other columns; null, empty and wordless texts are one group.
    Texts are read whole. Extra columns of any name pass through. An empty table stays empty."""
    work = Work(spark)
    prints = work.save(fingerprints(docs), "prints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    rows = prints.join(_rooted(work, prints).select("fp", "root"), "fp").select("root", "doc_id", "row")
    groups = work.save(rows.groupBy("root").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1").select("root", F.col("best.row").alias("stays")), "groups")
    gone = work.save(rows.join(groups, "root").where("row <> stays").select("row").distinct(), "gone")
    again = work.save(prints.groupBy("row").count().where("count > 1").select("row").join(gone, "row", "left_anti"), "again")
    kept = without(docs, gone)
    if not again.limit(1).count():
        return kept
    (name,) = fresh(docs, "repeated_row")
    repeated = docs.select("*", row_key().alias(name)).join(again.toDF(name), name, "left_semi").dropDuplicates([name]).drop(name)
    return without(kept, again).unionByName(repeated.select(*kept.columns))
