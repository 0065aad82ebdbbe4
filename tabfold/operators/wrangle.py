"""Projections, predicates and the feature/label join."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.functions.exprs import binary_label

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Bytes a side may hold to be broadcast. They are measured, so a side that
# grows with the data is shuffled instead of shipped to every task.
BROADCAST_MAX_BYTES = 64 << 20
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "bigint": 8,
          "float": 4, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
ROW_OVERHEAD = 16


def measured_bytes(df: DataFrame) -> int | None:
    """Bytes the rows hold, by one partial aggregation; None if a column's type has no measure."""
    width = F.lit(ROW_OVERHEAD)
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in _WIDTH:
            width = width + _WIDTH[t]
        elif t in ("string", "binary"):
            width = width + 8 + F.coalesce(F.octet_length(df[f.name]), F.lit(0))
        else:
            return None
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only for a side measured small; else leave it to the
    planner (sort-merge join, or AQE's runtime conversion)."""
    size = measured_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """P1."""
    return df.drop(*cols)


def feature_cols(df: DataFrame, exclude: Iterable[str] = (), numeric_only: bool = True) -> list[str]:
    """Feature columns by name, not by position (``columns[:-1]``)."""
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if numeric_only and f.dataType.simpleString() not in NUMERIC_TYPES:
            continue
        out.append(f.name)
    return out


def keep_classes(df: DataFrame, col: str, classes: Sequence) -> DataFrame:
    """Set-membership filter (null is not kept)."""
    return df.filter(F.col(col).isin(list(classes)))


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    """P4."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond)


def equal_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """P5: rows where two columns are equal (e.g. 25% == 75%)."""
    return df.filter(F.col(a) == F.col(b))


def with_binary_label(df: DataFrame, source: str, positive, out: str = "label",
                      drop_source: bool = False) -> DataFrame:
    """P6 + P7: ``when(source == positive, '1').otherwise('0')`` cast to int."""
    df = df.withColumn(out, binary_label(source, positive))
    return df.drop(source) if drop_source and source != out else df


def preview(df: DataFrame, cols: Sequence[str] | None = None, n: int = 5,
            order_by: Sequence[str] | None = None) -> DataFrame:
    """The rows ``show(5)`` would print, as a DataFrame. With
    ``order_by`` the preview is the first n rows in that order (a
    distributed top-n), so it is reproducible."""
    out = df.select(*(list(order_by or []) + [c for c in (cols or df.columns)
                                               if c not in (order_by or [])]))
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)


def join_labels(features: DataFrame, labels: DataFrame, key: str = "track_id",
                how: str = "inner", broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Using-join of a feature table with a key -> category table.

    The label side is broadcast only when a count proves it small; a large
    label table is joined by shuffle on the key (AQE splits skewed keys).
    A left join keeps the features as the preserved side, so only the label
    side may be broadcast in either case.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "left_anti"):
        return features.join(labels, [key], how)
    return features.join(broadcast_if_small(labels, broadcast_max_bytes), [key], how)
