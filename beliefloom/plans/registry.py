"""All queries of the core and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beliefloom.plans import audits, core_problems, reference  # noqa: F401 - audits adds to the tables of reference

QUERIES = {**reference.QUERIES, **core_problems.QUERIES}
ORACLES = {**reference.ORACLES, **core_problems.ORACLES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["claims_filtered"](spark, sf_dir)
