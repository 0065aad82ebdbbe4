"""Every line of delimited input accounted for.

``read_multi_header`` drops what has no valid key without a word. Here the
lines are read once and written, parsed, to the scratch folder with their file,
their line number and what is wrong with them; good rows, rejected lines and
the account of all lines come from that one table:
good + rejected + header lines = all lines.

Line numbers need no pass of one task over a file. A split's lines are read in
order by one task, so a line's place in its split comes from the running row id
that is written with it; the lines of the file's earlier splits are added from
one small count per split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.operators.wrangle import broadcast_if_small
from tabfold.session import scratch_path
from tabfold.sources import delimited

HEADER, BLANK, BAD_KEY, WIDTH, BAD_CELL = "header", "blank", "bad key", "width", "bad cell"


@dataclass
class Ingested:
    """``lines``: file, line_no, line, reason (null: good), n_bad_cells and the struct ``row``."""
    lines: DataFrame

    def good(self) -> DataFrame:
        """The rows that passed, in their columns and types."""
        return self.lines.filter(F.col("reason").isNull()).select("row.*")

    def rejected(self) -> DataFrame:
        """(file, line_no, reason, n_bad_cells, line) of every line that is neither good nor header."""
        return self.lines.filter(F.col("reason") != HEADER).select(
            "file", "line_no", "reason", "n_bad_cells", "line")

    def account(self) -> DataFrame:
        """(file, reason, n_lines, n_bad_cells) with reason 'good' for what passed; one aggregation."""
        return (self.lines.groupBy("file", F.coalesce("reason", F.lit("good")).alias("reason"))
                .agg(F.count("*").alias("n_lines"), F.sum("n_bad_cells").alias("n_bad_cells")))


def _numbered(staged: DataFrame) -> DataFrame:
    """``staged`` with line_no, from 1 in each file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged.groupBy("file", "block").agg(
        F.count("*").alias("_n"), F.min("at").alias("_first")).select(
        "file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (staged.join(broadcast_if_small(blocks), ["file", "block"])
            .withColumn("line_no", F.col("at") - F.col("_first") + F.col("_before") + 1)
            .drop("_first", "_before", "at", "block"))


def ingest(spark: SparkSession, path: str, names: Sequence[str], value_type="double",
           header_lines: Sequence[str] = (), key_type: str = "bigint", sep: str = ",",
           strict: bool = False, metadata_key: str | None = None) -> Ingested:
    """Read delimited lines whose first column is an integer key, with every line accounted for.

    A line's reason is the first that holds: ``header`` (one of ``header_lines``,
    or its first cell is ``metadata_key``), ``blank`` (white space only), ``bad
    key`` (not a ``key_type``); with ``strict`` also ``width`` (not as many cells
    as ``names``) and ``bad cell`` (a cell with text that is no ``value_type``).
    Without ``strict`` such rows are good, as in ``read_multi_header``: missing
    and bad cells are null, cells beyond the names are left out. ``n_bad_cells``
    counts cells with text that became null. A lone carriage return at a line's
    end is no part of it. Names may be any, and may repeat only by letter case
    as the session allows. No files or no lines give empty tables.
    """
    vtype = delimited._dtype(value_type)
    cells = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "odd"]])
    text = spark.read.text(path).select(
        F.rtrim("value", F.lit("\r")).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    # only a wrong number of cells makes a line of text cells malformed
    parsed = F.from_csv("line", schema.simpleString(), {"sep": sep, "columnNameOfCorruptRecord": "odd"})
    text = text.withColumn("at", F.monotonically_increasing_id()).withColumn("cells", parsed)

    def cell(c, dtype):
        return F.trim(F.col(f"cells.{c}")).try_cast(dtype)
    first = F.trim("cells.c0")
    key = cell("c0", key_type)
    values = [cell(c, vtype) for c in cells[1:]]
    lost = [(v.isNull() & (F.trim(F.col(f"cells.{c}")) != "")).cast("int")
            for c, v in zip(cells[1:], values, strict=True)]
    lost = [F.coalesce(x, F.lit(0)) for x in lost]
    header = F.col("line").isin(list(header_lines)) if header_lines else F.lit(False)
    if metadata_key is not None:
        header = header | F.coalesce(first == metadata_key, F.lit(False))
    reason = (F.when(header, HEADER).when(F.trim(F.regexp_replace("line", r"\s", "")) == "", BLANK)
              .when(key.isNull(), BAD_KEY))
    n_bad = F.aggregate(F.array(*lost), F.lit(0), lambda a, x: a + x) if lost else F.lit(0)
    n_bad = F.when(reason.isNull(), n_bad).otherwise(0).cast("long")
    if strict:
        reason = reason.when(F.col("cells.odd").isNotNull(), WIDTH).when(n_bad > 0, BAD_CELL)
    row = F.struct(key.alias(names[0]), *[v.alias(n) for v, n in zip(values, names[1:], strict=True)])
    staged = text.select("file", "block", "at", "line", reason.alias("reason"),
                         n_bad.alias("n_bad_cells"), row.alias("row"))
    out = scratch_path(spark, "ingested")
    staged.write.parquet(out)
    return Ingested(_numbered(spark.read.schema(staged.schema).parquet(out)))


def ingest_multi_header(spark: SparkSession, path: str, n_header: int = 3, sep: str = ",",
                        join: str = "_", key_name: str = "track_id", value_type="double",
                        key_type: str = "bigint", header_path: str | None = None,
                        strict: bool = False) -> Ingested:
    """S4 with an account: ``read_multi_header``'s good rows, and what it left out.

    Each file may repeat the header; lines equal to one of the ``n_header`` lines,
    and lines whose key cell is ``key_name`` (metadata), count as header.
    """
    lines = delimited.header_lines(spark, header_path or path, n_header)
    names = delimited.multi_header_names(lines, sep, join, key_name)
    return ingest(spark, path, names, value_type, [x.rstrip("\r") for x in lines], key_type, sep,
                  strict, key_name)
