"""A corpus pipeline of the llm operators: language ID, SimHash near-duplicates, benchmark decontamination,
mixing by domain, and token ids. Each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshspark.llm import decontaminate, langid, mixing, simhash, tokens
from meshspark.llm.common import Work

STAGES = [
    ("language ID", langid.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing to target weights", mixing.stage),
    ("token-ID output", tokens.stage),
]

#: Learned models decide what stays, so no SQL gives the rows; tests/llm compares the deciding rules of the stages with
#: brute force over what the models said.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents."""
    work = Work(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    out = STAGES[-1][1](spark, docs, sf_dir)
    work.drop()
    return out
