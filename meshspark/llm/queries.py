"""The thin opN_ queries: each runs one operator over its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession


def _late(module: str, name: str):
    """A query whose module is imported when it runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


QUERIES = {
    "op1_license_scan": _late("licenses", "query"),
    "op2_warc_archive": _late("warc", "query"),
    "op3_simhash_dedup": _late("simhash", "query"),
    "op4_near_passages": _late("passages", "query"),
    "op5_language_id": _late("langid", "query"),
    "op6_decontamination": _late("decontaminate", "query"),
    "op7_token_shards": _late("tokens", "query"),
    "op8_remove_repeats": _late("repeats", "query"),
    "op9_mixing": _late("mixing", "query"),
    "op10_nearest": _late("ann", "query"),
}


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, licenses, repeats, warc

    return {"op1_license_scan": licenses.sql(), "op2_warc_archive": warc.SQL, "op6_decontamination": decontaminate.SQL, "op8_remove_repeats": repeats.SQL}
