"""Column expressions shared by operators and queries.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**32: the hash unit below is an unsigned 32-bit integer.
HASH_SPACE = 4294967296


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(keys: Sequence, *salt) -> Column:
    """md5 hex of ``key1:key2:...:salt...`` (nulls skipped, as concat_ws does)."""
    parts = [_col(k).cast("string") for k in keys]
    parts += [_col(s).cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws(":", *parts))


def hash_unit(keys: Sequence, *salt) -> Column:
    """First 32 bits of the md5 above as a non-negative bigint in [0, 2**32).

    Depends only on the row's key values and the salt, never on partition
    layout, so a split or fold assignment is stable under repartitioning,
    recomputation after executor loss, and added columns.
    """
    return F.conv(F.substring(hash_hex(keys, *salt), 1, 8), 16, 10).cast("bigint")


def binary_label(c, positive, true_value: int = 1, false_value: int = 0) -> Column:
    """``when(c == positive, 1).otherwise(0)`` as int (a null input maps to 0)."""
    return F.when(_col(c) == F.lit(positive), F.lit(true_value)).otherwise(F.lit(false_value)).cast("int")


def planted_label(condition: Column) -> Column:
    """0/1 int label from a boolean rule over feature columns."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("int")


def family(c, sep: str = "_") -> Column:
    """First part of a name split on ``sep`` (``chroma_mean_01`` -> ``chroma``)."""
    return F.split_part(_col(c), F.lit(sep), F.lit(1))


def try_long(c) -> Column:
    """Cast to bigint, null when the text is not an integer."""
    return F.expr(f"try_cast(`{c}` as bigint)") if isinstance(c, str) else c.try_cast("bigint")
