"""Small driver-side tables: reports and metadata only.

Anything that grows with the data is scanned, never shipped through here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MAX_LOCAL_ROWS = 100_000


def small_table(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    rows = list(rows)
    if len(rows) > MAX_LOCAL_ROWS:
        raise ValueError(f"{len(rows)} rows is not a small table; write it out and scan it")
    return spark.createDataFrame(rows, schema)
