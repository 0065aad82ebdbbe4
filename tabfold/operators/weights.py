"""Class weights from the class histogram.

A class of one percent is outvoted in every leaf and every gradient. Balanced
weights give each class the same total, n / (k * rows of the class) a row, and
go through Spark ML's ``weightCol``: the learners sum weights where they summed
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.operators.wrangle import broadcast_if_small


def class_weights(df: DataFrame, label_col: str, power: float = 1.0,
                  count_col: str | None = None) -> DataFrame:
    """(label, n_rows, weight): weight = (n / (k * n_rows)) ** power, one aggregation.

    ``power`` 1 balances the classes, 0 leaves them as they are, 0.5 goes half
    the way. Null labels are no class. ``count_col``: how many rows a row stands
    for. The window runs over one row per class.
    """
    n = F.lit(1) if count_col is None else F.col(count_col).cast("long")
    counts = (df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
              .agg(F.sum(n).cast("long").alias("n_rows")).filter("n_rows > 0"))
    every = Window.partitionBy(F.lit(0))
    share = F.sum("n_rows").over(every) / (F.count("*").over(every) * F.col("n_rows"))
    return counts.withColumn("weight", F.pow(share, F.lit(float(power))))


def with_class_weights(df: DataFrame, label_col: str, weights: DataFrame | None = None,
                       out: str = "weight", power: float = 1.0) -> DataFrame:
    """``df`` with its rows' class weights; the join is broadcast only if measured small.

    ``weights`` (label, weight) may come from other rows, as from the train rows
    alone; a class that they lack, and a null label, weigh 0.
    """
    if out in df.columns:
        raise ValueError(f"column {out!r} is taken")
    weights = class_weights(df, label_col, power) if weights is None else weights
    side = weights.select(F.col(label_col).alias("_class"), F.col("weight").alias("_weight"))
    joined = df.join(broadcast_if_small(side), F.col(label_col) == F.col("_class"), "left")
    return joined.withColumn(out, F.coalesce("_weight", F.lit(0.0))).drop("_class", "_weight")
