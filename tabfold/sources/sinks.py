"""Sinks and model persistence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                 mode: str = "errorifexists", header: bool = False) -> None:
    """A small report as one CSV file per partition value.
    ``partition_by=("variant", "seed")`` lands every run in one table;
    ``mode="overwrite_partitions"`` replaces only the partitions written
    (dynamic partition overwrite), so runs can be repeated independently.
    ``coalesce(1)`` is only for reports (a few rows), never for data."""
    w = df.coalesce(1).write
    if mode == "overwrite_partitions":
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode(mode)
    w = w.option("header", str(header).lower())
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = "bzip2",
                header: bool = True, mode: str = "errorifexists",
                partition_by: Sequence[str] = ()) -> None:
    """The wrangled table, written in parallel (one file per task).
    ``fmt='parquet'`` stages it columnar for the later jobs."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", str(header).lower())
        if compression:
            w = w.option("compression", compression)
        w.csv(path)
    else:
        if compression and fmt == "parquet" and compression != "bzip2":
            w = w.option("compression", compression)
        w.format(fmt).save(path)


def csv_line(cols: Iterable, sep: str = ",", null: str = ""):
    """One delimited text line per row from columns cast to text."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in cols])


def write_lines_with_header(lines: DataFrame, header: Sequence[str], path: str,
                            mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write a one-column text DataFrame so that *every* output file starts
    with the given header lines (multi-row / repeated headers). Each task
    writes its own file in parallel; readers drop the header rows by key."""
    head = list(header)

    def with_header(batches):
        yield pd.DataFrame({"value": head})
        for pdf in batches:
            yield pdf

    out = lines.toDF("value").mapInPandas(with_header, "value string")
    w = out.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def read_collated(spark: SparkSession, path: str) -> DataFrame:
    """Collated result files ``metric, value, seed`` (plus partition columns).
    Columns go by position and lines without a numeric value and seed are
    headers, however those are spelt."""
    raw = spark.read.schema("metric string, _value string, _seed string").csv(path)
    value, seed = F.trim("_value").try_cast("double"), F.trim("_seed").try_cast("int")
    return (raw.withColumns({"metric": F.trim("metric"), "value": value, "seed": seed})
            .filter(F.col("value").isNotNull() & F.col("seed").isNotNull())
            .drop("_value", "_seed"))


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
