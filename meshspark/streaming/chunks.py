"""Element scans in chunks, for reductions that never need a whole mesh at once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import frame_nmsh, register


def iter_elements(spark: SparkSession, path: str, chunk: int = 1 << 21) -> Iterator[tuple[int, DataFrame]]:
    """(first place, elements) of each run of `chunk` records. Spark scans such runs in parallel by itself, one
    to a task; this is for code that wants to go through them in order."""
    register(spark)
    sections, nelv, _ = frame_nmsh(path)
    del sections
    whole = spark.read.format("nmsh").option("section", "elements").option("chunk", chunk).load(path)
    for first in range(0, nelv, chunk):
        yield first, whole.where((F.col("pos") >= first) & (F.col("pos") < min(nelv, first + chunk)))
