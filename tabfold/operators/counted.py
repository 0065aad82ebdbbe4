"""Equal rows counted once for learners that only sum rows.

Trees see a row through its bins and its label, and add up weights: n equal
rows and one row of weight n make the same sums, gains and leaves. Where the
features take few values, the rows to fit on are as many as there are distinct
ones, however long the table. Counting is one map-side-combined aggregation; a
sketch says first whether it is worth it, and where rows differ they are fitted
as they are.

Linear learners sum rows, too, but their scaling takes weights for reliabilities,
so its deviations, and with them a penalty, would change: a sweep, which counts
equal rows once for all its fits, gives them a penalty that makes up for it. The
other fits leave linear learners on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfold.operators.softmax import SoftmaxBoosting
from tabfold.session import ensure_checkpoint_dir

WORTH = 4               # rows to a distinct one from which on counting is worth a shuffle
PARTITION_ROWS = 1 << 17
PARTITION_VALUES = 1 << 23      # feature values in a partition of a boosted fit, at most about
COUNT, WEIGHT = "_n_equal", "_weight"


def rows_repeat(df: DataFrame, cols: Sequence[str], worth: int = WORTH) -> bool:
    """Whether there are ``worth`` rows or more to a distinct one, by a sketch."""
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.approx_count_distinct(F.xxhash64(*cols)).alias("d")).first()
    return r["n"] >= worth * max(r["d"], 1)


def counts_rows(learner) -> bool:
    """Whether a fit of the learner is a matter of summed weights alone.

    Not if it draws rows, holds some back, or asks for a least number of them.
    """
    if isinstance(learner, SoftmaxBoosting):
        return not {"minInstancesPerNode", "subsamplingRate"} & set(learner.settings)
    if isinstance(learner, OneVsRest):
        return counts_rows(learner.getClassifier())
    if not isinstance(learner, DecisionTreeClassifier | GBTClassifier):
        return False
    if learner.getOrDefault("minInstancesPerNode") != 1:
        return False
    return not isinstance(learner, GBTClassifier) or (
        learner.getOrDefault("subsamplingRate") == 1.0 and not learner.isDefined("validationIndicatorCol"))


def sums_rows(learner) -> bool:
    """Whether a fit on counted rows (``weighted``) is that on the rows: also linear ones."""
    return isinstance(learner, LogisticRegression) or counts_rows(learner)


def weight_of(learner) -> str | None:
    """The learner's own weight column."""
    if isinstance(learner, SoftmaxBoosting):
        return learner.settings["weight_col"]
    return learner.getOrDefault("weightCol") if learner.isDefined("weightCol") else None


def same_penalty(learner: LogisticRegression, rows: DataFrame) -> dict:
    """The parameters whose penalty on counted ``rows`` is the learner's on the rows themselves.

    Penalties are on coefficients times deviations. The library's deviations of
    weighted rows are those of the rows times one factor for all features, as their
    variance divides by n - sum(w^2) / n instead of n - 1.
    """
    reg, net = learner.getOrDefault("regParam"), learner.getOrDefault("elasticNetParam")
    if not reg or not learner.getOrDefault("standardization"):
        return {}
    w = F.col(WEIGHT)
    row = rows.agg(F.sum(w).alias("n"), F.sum(w * w).alias("squares")).first()
    n = row["n"] or 0.0
    rest = n - row["squares"] / n if n else 0.0
    if n <= 1 or rest <= 0:         # one kind of row: no deviation to penalise
        return {}
    factor = ((n - 1) / rest) ** 0.5
    l1, l2 = reg * net / factor, reg * (1 - net) / factor ** 2
    return {learner.regParam: l1 + l2, learner.elasticNetParam: l1 / (l1 + l2)}


def weighted(learner, rows: DataFrame | None = None):
    """The learner with the weights of ``counted_rows``; a linear one asks for the ``rows``."""
    if isinstance(learner, LogisticRegression):
        return learner.copy({learner.weightCol: WEIGHT, **same_penalty(learner, rows)})
    if isinstance(learner, SoftmaxBoosting):
        settings = {k: v for k, v in learner.settings.items() if k != "weight_col"}
        return SoftmaxBoosting(learner.getOrDefault("labelCol"), learner.getOrDefault("featuresCol"),
                               WEIGHT, **settings)
    return learner.copy({learner.weightCol: WEIGHT})


def merged(rows: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``rows``, kept, in partitions of about ``partition_rows``.

    A boosted fit is many short passes, whose time is that of their tasks: few rows
    are merged, without a shuffle. More than the aggregation's partitions should hold
    (as many as the session's shuffles have) are spread, so that what a task of the
    fit reads doesn't grow with them.
    """
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    n_parts = -(-rows.count() // partition_rows) or 1
    spread = n_parts > rows.rdd.getNumPartitions()
    kept = rows.repartition(n_parts) if spread else rows.coalesce(n_parts)
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    rows.unpersist()
    return kept


def is_boosted(learner) -> bool:
    """Whether a fit of the learner is rounds of short passes over its rows."""
    return isinstance(learner, GBTClassifier | OneVsRest | SoftmaxBoosting)


def fewer_parts(rows: DataFrame, n_features: int) -> DataFrame:
    """``rows`` in a partition for each core, and more only as the rows need them; no shuffle.

    A join leaves as many partitions as the session's shuffles have, however few
    its rows; each pass of a boosted fit would then send the driver that many results.
    """
    each = max(1, min(PARTITION_ROWS, PARTITION_VALUES // max(n_features, 1)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(cores, -(-rows.count() // each)))


def cut(rows: DataFrame) -> DataFrame:
    """``rows``, kept, without what they come from.

    Every job of a fit sends its rows' lineage to the tasks; over small rows that is
    most of the job.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    saved = rows.checkpoint()
    rows.unpersist()
    return saved.persist(StorageLevel.MEMORY_AND_DISK)


@contextmanager
def counted_rows(df: DataFrame, cols: Sequence[str], weight_col: str | None = None) -> Iterator[DataFrame]:
    """Distinct ``cols`` (and weights) with their rows' total in column ``WEIGHT``, kept meanwhile."""
    keys = [*cols, weight_col] if weight_col else list(cols)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(COUNT))
    weight = F.col(COUNT) * F.col(weight_col) if weight_col else F.col(COUNT)
    rows = merged(rows.select(*cols, weight.alias(WEIGHT)))
    try:
        yield rows
    finally:
        rows.unpersist()
