"""Fixed intermediate results, and an order that needs no single task."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. This machine's temporary folder
    stands in only where the setting is absent and Spark runs in this one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or tempfile.gettempdir() + "/meshspark-work"


def mounted_folder(spark: SparkSession) -> str:
    """The same as a path for files that are opened by name."""
    at = shared_folder(spark)
    if "://" in at and not at.startswith("file://"):
        raise ValueError(f"{at} is not mounted as a folder")
    path = at.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def pinned(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with its place in the order, from 0, as a long. Rows are dealt in ranges and sorted inside them;
    only the number of rows of each range comes to the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    fixed = pinned(ranged)
    part = F.shiftright("at_", 33)
    total, before = 0, {}
    for p, n in sorted((r.p, r.n) for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before[p] = total
        total += n
    if not before:
        return fixed.withColumn(name, F.col("at_")).drop("at_")
    offsets = F.element_at(F.array(*(F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1))), part.cast("int") + 1)
    return fixed.withColumn(name, F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + offsets).drop("at_")


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of the driver's own rows."""
    return spark.createDataFrame(rows, schema)
