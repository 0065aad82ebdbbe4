"""Parquet tables of a data directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 16 << 20       # input bytes in a part of a spread scan, about
PART_ROWS = 1 << 20         # rows in one, at most about


def ensure_parallelism(df: DataFrame, n_rows: int = 0) -> DataFrame:
    """Spread a scan evenly over the cores, in parts of bounded size.

    Splits are cut by bytes, but a row group is read by one of them, so a
    small input often sits in one task however many splits it has, and a large
    one in as few tasks as its writer left row groups. The rows move once, in
    their compressed columns. There is a part for each core, and more of them
    once they would be larger than ``PART_BYTES`` or, where ``n_rows`` is given
    (well compressed input), than ``PART_ROWS``: what a task keeps and reads
    doesn't grow with the table, whatever its size and layout.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // PART_BYTES), -(-n_rows // PART_ROWS)))


def read_table(spark: SparkSession, data_dir: str, name: str,
               columns: Sequence[str] | None = None, spread: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    # counted from the file footers
    return ensure_parallelism(df, df.count()) if spread else df
