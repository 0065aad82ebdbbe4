"""Scores: accuracy, balanced accuracy, confusion matrix, fold and seed
summaries (SURVEY E1, E2, A9, A6, A7).

All metrics are grouped aggregates over one scored table - train and test
are scored in a single pass grouped by the split column, not two jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfold.operators.sampling import null_safe_join


def _hit(label_col: str, pred_col: str):
    return (F.col(label_col) == F.col(pred_col)).cast("long")


def accuracy(scored: DataFrame, label_col: str = "indexedLabel", pred_col: str = "prediction",
             by: Sequence[str] = ("split",), weight_col: str | None = None) -> DataFrame:
    """``n_rows``, ``n_correct``, ``accuracy`` per group.
    ``weight_col``: how many rows a row stands for."""
    hit, n_rows = _hit(label_col, pred_col), F.count(F.lit(1))
    if weight_col is not None:
        n = F.col(weight_col).cast("long")
        hit, n_rows = hit * n, F.sum(n)
    return (scored.groupBy(*by)
                  .agg(n_rows.alias("n_rows"), F.sum(hit).alias("n_correct"))
                  .withColumn("accuracy", F.col("n_correct") / F.col("n_rows")))


def balanced_accuracy(scored: DataFrame, label_col: str = "indexedLabel",
                      pred_col: str = "prediction", by: Sequence[str] = ("split",),
                      weight_col: str | None = None) -> DataFrame:
    """Unweighted mean of per-class recall (not Spark's weightedRecall).
    ``weight_col``: how many rows a row stands for."""
    n = F.lit(1) if weight_col is None else F.col(weight_col).cast("long")
    hit = _hit(label_col, pred_col) * n
    recall = (scored.groupBy(*by, label_col)
                    .agg((F.sum(hit) / F.sum(n)).alias("_recall"),
                         F.sum(n).cast("long").alias("_n")))
    return (recall.groupBy(*by)
                  .agg(F.avg("_recall").alias("balanced_accuracy"),
                       F.count(F.lit(1)).alias("n_classes"),
                       F.sum("_n").alias("n_rows")))


def confusion_matrix(scored: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     by: Sequence[str] = (), classes: Sequence | None = None) -> DataFrame:
    """Counts per (true, predicted) class, zero-filled, with the rate
    normalised over the true class (``normalize='true'``).

    The classes are those of both columns if not given. Aggregation happens
    first; the zero fill joins the class table to the aggregated true-class
    rows, as many rows as the matrix has.
    """
    # one pass over the scored rows; everything below works on this small
    # aggregate (classes^2 x groups rows)
    counts = scored.groupBy(*by, label_col, pred_col).agg(F.count(F.lit(1)).alias("n")).persist()
    ltype = scored.schema[label_col].dataType
    totals = counts.groupBy(*by, label_col).agg(F.sum("n").alias("_total"))
    if classes is None:
        found = (counts.select(F.col(label_col).alias(pred_col))
                 .union(counts.select(F.col(pred_col).cast(ltype))).distinct())
        grid = totals.withColumn("_all", F.lit(1)).join(
            found.withColumn("_all", F.lit(1)), "_all").drop("_all")
    else:
        grid = totals.withColumn(pred_col, F.explode(F.array(*[F.lit(c).cast(ltype) for c in classes])))
    counts = counts.withColumn(pred_col, F.col(pred_col).cast(ltype))
    out = (null_safe_join(grid, counts, [*by, label_col, pred_col], "left", right_cols=["n"])
               .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
               .withColumn("rate", F.col("n") / F.col("_total"))
               .drop("_total"))
    return out


def fold_summary(scores: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and *population* std of fold scores (numpy's default)."""
    return scores.groupBy(*by).agg(F.avg(value_col).alias("mean"),
                                   F.stddev_pop(value_col).alias("std"),
                                   F.count(F.lit(1)).alias("n"))


def seed_summary(results: DataFrame, value_col: str = "value",
                 by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Max, min, average and sample std over runs."""
    return results.groupBy(*by).agg(F.min(value_col).alias("min"), F.max(value_col).alias("max"),
                                    F.avg(value_col).alias("mean"),
                                    F.stddev_samp(value_col).alias("std"),
                                    F.count(F.lit(1)).alias("n_runs"))


def running_total(df: DataFrame, value_col: str, order_col: str, out: str) -> DataFrame:
    """Cumulative sum over a small ordered table (one row per component
    or feature - the window has no partition key, so the table must be
    bounded, never the data itself)."""
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value_col).over(w))


def share_and_running_total(scores: DataFrame, value_col: str, name_col: str) -> DataFrame:
    """W1 over a score table: ``rank`` (largest first, name breaks ties),
    ``share`` of the total and the running ``cumulative`` share - the table
    behind a cumulative explained-variance (area / scree) plot."""
    order = [F.col(value_col).desc(), F.col(name_col).asc()]
    total = F.sum(value_col).over(Window.partitionBy())
    run = F.sum(value_col).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return scores.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), name_col,
                         (F.col(value_col) / total).alias("share"), (run / total).alias("cumulative"))
