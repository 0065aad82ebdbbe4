"""Delimited fixtures derived from the given tables.

The reference reads text inputs (headerless CSV, bzip2 CSV with a header,
a CSV with a three-row header, a CSV with repeated header names). These
writers produce the same shapes from the parquet tables, in parallel (one
file per task, each starting with its own header lines), under the shared
scratch folder; the readers in ``tabfold.sources.delimited`` scan them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.session import scratch_path
from tabfold.sources import sinks

# Three header rows for the 64 embedding slots, built by rule:
# family emb{i // 16}, statistic by (i // 4) % 4, number (i % 4) + 1.
STATISTICS = ("mean", "std", "min", "max")


def embedding_names(d: int = 64) -> list[tuple[str, str, str]]:
    return [(f"emb{i // 16}", STATISTICS[(i // 4) % 4], f"{i % 4 + 1:02d}") for i in range(d)]


def _csv_line(df: DataFrame, cols) -> DataFrame:
    return df.select(F.to_csv(F.struct(*cols)).alias("value"))


def write_multi_header_embeddings(spark: SparkSession, emb: DataFrame, d: int = 64) -> str:
    names = embedding_names(d)
    header = [",".join(["feature"] + [n[0] for n in names]),
              ",".join(["statistics"] + [n[1] for n in names]),
              ",".join(["number"] + [n[2] for n in names]),
              "track_id" + "," * d]
    body = _csv_line(emb, [F.col("vec_id").cast("string")] +
                     [F.col("embedding")[i].cast("string").alias(f"c{i}") for i in range(d)])
    path = scratch_path(spark, "multiheader")
    sinks.write_lines_with_header(body, header, path)
    return path


# Repeated-header layout: blank key header, one 'album' column, eight
# 'track' columns (the 8th holds the genre), one 'artist' column.
REPEATED_HEADER = ",album,track,track,track,track,track,track,track,track,artist"
REPEATED_META = ("title,info,a,b,c,d,e,f,g,genre_top,name", "track_id,,,,,,,,,,")


def write_repeated_header_customers(spark: SparkSession, cust: DataFrame) -> str:
    c = F.col
    cols = [c("c_custkey").cast("string"), c("c_name"), c("c_nationkey").cast("string"),
            c("c_acctbal").cast("string"), c("c_name").alias("n2"),
            c("c_nationkey").cast("string").alias("k2"), c("c_acctbal").cast("string").alias("a2"),
            c("c_name").alias("n3"), c("c_nationkey").cast("string").alias("k3"),
            c("c_mktsegment"), c("c_acctbal").cast("string").alias("a3")]
    body = _csv_line(cust, cols)
    path = scratch_path(spark, "repeated")
    sinks.write_lines_with_header(body, [REPEATED_HEADER, *REPEATED_META], path)
    return path
