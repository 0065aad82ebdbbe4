"""Delimited-text scans.

All scans give an explicit schema (no inference pass). Multi-row and
repeated headers are resolved from the first lines of the input only - a
bounded ``take`` - and the body is parsed by Spark's CSV reader in
parallel; header and metadata rows are dropped by a key test, so the files
may be split and may each repeat the header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.functions.exprs import try_long

_TYPES = {
    "double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "string": T.StringType(),
}


def _dtype(t) -> T.DataType:
    return _TYPES[t] if isinstance(t, str) else t


def read_headerless(spark: SparkSession, path: str, names: Sequence[str],
                    types: Sequence | str | T.StructType = "double", sep: str = ",",
                    infer: bool = False) -> DataFrame:
    """Headerless CSV with caller-given column names.

    ``types`` is one type for all columns, one per column, or a full schema;
    ``infer=True`` reproduces ``inferSchema`` (one extra full read).
    """
    reader = spark.read.option("sep", sep).option("header", "false")
    if infer:
        return reader.option("inferSchema", "true").csv(path).toDF(*names)
    if isinstance(types, T.StructType):
        schema = types
    else:
        tlist = [types] * len(names) if isinstance(types, str) or isinstance(types, T.DataType) \
            else list(types)
        schema = T.StructType([T.StructField(n, _dtype(t), True) for n, t in zip(names, tlist)])
    return reader.schema(schema).csv(path)


def read_with_header(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     sep: str = ",", infer: bool = False) -> DataFrame:
    """CSV with one header row; compression (``.bz2``, ``.gz``...) is
    recognised by the file suffix. Give ``schema`` to skip inference."""
    reader = spark.read.option("sep", sep).option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", "true")
    return reader.csv(path)


def safe_names(df: DataFrame, old: str = ".", new: str = "_") -> DataFrame:
    """S3: ``toDF`` with ``.`` replaced by ``_`` in every name."""
    return df.toDF(*[c.replace(old, new) for c in df.columns])


def header_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """First ``n`` lines of the input (bounded driver read)."""
    return [r[0] for r in spark.read.text(path).take(n)]


def _split_line(line: str, sep: str) -> list[str]:
    import csv
    return next(csv.reader([line], delimiter=sep))


def multi_header_names(lines: Sequence[str], sep: str = ",", join: str = "_",
                       key_name: str = "track_id") -> list[str]:
    """Join k header rows column-wise into one name; first column -> key."""
    rows = [_split_line(line, sep) for line in lines]
    width = max(len(r) for r in rows)
    rows = [r + [""] * (width - len(r)) for r in rows]
    names = [join.join(parts).strip() for parts in zip(*rows)]
    names[0] = key_name
    return names


def read_multi_header(spark: SparkSession, path: str, n_header: int = 3, sep: str = ",",
                      join: str = "_", key_name: str = "track_id",
                      value_type="double", key_type: str = "bigint",
                      header_path: str | None = None) -> DataFrame:
    """S4 + S6: CSV whose column names span ``n_header`` rows, followed by
    metadata rows (e.g. ``track_id,,,``).

    Names come from the first ``n_header`` lines (of ``header_path`` if given); the body is read with a
    generated schema (key as text) and only rows whose key parses as an
    integer are kept - a bad key drops its row, a bad cell becomes null.
    """
    lines = header_lines(spark, header_path or path, n_header)
    for line in lines:
        if _split_line(line, sep)[0].strip().lstrip("-").isdigit():
            raise ValueError(f"a data row stands where a header row should: {line[:80]!r}; "
                             "give header_path if only one of the files has the header")
    names = multi_header_names(lines, sep, join, key_name)
    vtype = _dtype(value_type)
    schema = T.StructType([T.StructField(names[0], T.StringType(), True)] +
                          [T.StructField(n, vtype, True) for n in names[1:]])
    body = spark.read.option("sep", sep).option("header", "false").schema(schema).csv(path)
    key = try_long(names[0])
    return (body.filter(key.isNotNull())
                .withColumn(names[0], key.cast(key_type)))


def parse_lines(lines: DataFrame, schema: T.StructType, sep: str = ",",
                col: str = "value") -> DataFrame:
    """Parse already-loaded text lines (a string column) as CSV with the
    JVM's CSV parser (``from_csv``) - the DataFrame form of handing an RDD of
    lines to the CSV reader."""
    parsed = F.from_csv(F.col(col), schema.simpleString(), {"sep": sep})
    return lines.select(parsed.alias("_row")).select("_row.*")


def nth_position(header: Sequence[str], name: str, occurrence: int) -> int:
    """Index of the ``occurrence``-th (1-based) column whose header is ``name``.
    ``track.7`` in pandas numbering is occurrence 8."""
    seen = 0
    for i, h in enumerate(header):
        if h.strip() == name:
            seen += 1
            if seen == occurrence:
                return i
    raise ValueError(f"fewer than {occurrence} columns named {name!r}")


def read_positional(spark: SparkSession, path: str, picks: dict, types: dict | None = None,
                    key: str | None = None, sep: str = ",") -> DataFrame:
    """Select columns by position under a header with repeated names.

    ``picks`` maps output name -> column index, or -> ``(header, occurrence)``
    resolved on the first line (never by Spark's de-duplicated names).
    Rows whose ``key`` column is not an integer (header, metadata rows) are
    dropped.
    """
    header = _split_line(header_lines(spark, path, 1)[0], sep)
    pos = {}
    for out, where in picks.items():
        pos[out] = where if isinstance(where, int) else nth_position(header, *where)
    width = len(header)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(width)])
    body = spark.read.option("sep", sep).option("header", "false").schema(schema).csv(path)
    types = types or {}
    cols = []
    for out, i in pos.items():
        c = F.col(f"_c{i}")
        t = types.get(out)
        if t is not None and t != "string":
            c = c.try_cast(_dtype(t))
        cols.append(c.alias(out))
    out = body.select(*cols)
    if key is not None:
        kt = types.get(key)
        test = F.col(key) if kt not in (None, "string") else try_long(key)
        out = out.filter(test.isNotNull())
    return out
