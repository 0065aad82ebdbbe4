"""Covariance, PCA, explained variance and scree tables.

The covariance is a distributed Gramian: every Arrow batch contributes
``Xc^T Xc`` of its centred rows (numpy inside the task), and Spark sums the
d*(d+1)/2 partial cells with a map-side-combined aggregation. Only the
d x d result - bounded by the feature count, not the rows - is small.
PCA itself is Spark ML's (d x d eigen-decomposition on the driver, d up to
65535 per Spark's own limit).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fit_pca(train: DataFrame, col: str, out: str, k: int):
    """PCA with k = min(k, d). Spark's projection does not centre."""
    first = train.select(col).first()
    d = first[0].size if first is not None else k
    return PCA(k=min(k, d), inputCol=col, outputCol=out).fit(train)


def _as_array(df: DataFrame, col: str) -> DataFrame:
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType):
        return df.select(F.col(col).cast("array<double>").alias("_x"))
    return df.select(vector_to_array(F.col(col)).alias("_x"))


def column_means(df: DataFrame, col: str) -> tuple[int, np.ndarray]:
    """Count and per-slot mean of an array/vector column, one aggregation."""
    arr = _as_array(df, col)
    d = len(arr.first()[0])
    row = arr.agg(F.count(F.lit(1)).alias("n"),
                  *[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)]).first()
    return int(row["n"]), np.array([row[f"m{i}"] for i in range(d)], dtype=float)


def covariance(df: DataFrame, col: str, ddof: int = 1) -> DataFrame:
    """Sample covariance ``(i, j, cov)`` for all slot pairs, i and j 0-based.

    Two passes: means, then centred partial Gramians per batch. Centring
    first avoids the cancellation of the one-pass ``E[xy] - E[x]E[y]``.
    """
    n, mu = column_means(df, col)
    d = len(mu)
    iu, ju = np.triu_indices(d)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("s", T.DoubleType())])

    def gram(batches):
        acc = np.zeros((d, d))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf["_x"].to_numpy()).astype(float) - mu
            acc += x.T @ x
            seen = True
        if seen:
            yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "s": acc[iu, ju]})

    parts = _as_array(df, col).mapInPandas(gram, schema)
    upper = parts.groupBy("i", "j").agg((F.sum("s") / F.lit(n - ddof)).alias("cov"))
    # both triangles from the aggregated cells: the rows are read once
    cell, mirrored = F.struct("i", "j", "cov"), F.struct(
        F.col("j").alias("i"), F.col("i").alias("j"), "cov")
    both = F.when(F.col("i") == F.col("j"), F.array(cell)).otherwise(F.array(cell, mirrored))
    return upper.select(F.inline(both))


def explained_variance(spark: SparkSession, pca_model, total_variance: float | None = None
                       ) -> DataFrame:
    """F9 + W1 (+ F10 when ``total_variance`` is given):
    ``(component, ratio, cumulative[, eigenvalue])``, component 1-based.
    Spark's ``explainedVariance`` already is the ratio."""
    ratios = [float(v) for v in pca_model.explainedVariance.toArray()]
    rows = [(i + 1, r) for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "component int, ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("cumulative", F.sum("ratio").over(w))
    if total_variance is not None:
        df = df.withColumn("eigenvalue", F.col("ratio") * F.lit(float(total_variance)))
    return df


def total_variance(df: DataFrame, col: str) -> float:
    """Sum of per-slot sample variances = trace of the covariance."""
    arr = _as_array(df, col)
    d = len(arr.first()[0])
    row = arr.agg(*[F.var_samp(F.col("_x")[i]).alias(f"v{i}") for i in range(d)]).first()
    return float(sum(row[f"v{i}"] or 0.0 for i in range(d)))


def loadings(spark: SparkSession, pca_model) -> DataFrame:
    """``(component, slot, loading)`` of a fitted PCA, component 1-based; d x k rows."""
    matrix = pca_model.pc.toArray()
    rows = [(k + 1, i, float(matrix[i, k])) for k in range(matrix.shape[1])
            for i in range(matrix.shape[0])]
    return spark.createDataFrame(rows, "component int, slot int, loading double")


def eigen_certificate(cov: DataFrame, pca_model, total: float) -> DataFrame:
    """F7-F10 checked: ``(component, eigenvalue, residual, overlap)`` of a fitted PCA.

    ``cov``: ``covariance`` of the rows that the PCA was fitted on, ``total``
    their ``total_variance``. ``residual`` is |C v - l v|, ``overlap`` the
    largest of |v.v - 1| and |v.w| over the other components w: both are zero,
    up to rounding, for the eigenpairs of C and for nothing else.
    """
    spark = cov.sparkSession
    v = loadings(spark, pca_model)
    values = explained_variance(spark, pca_model, total).select("component", "eigenvalue")
    image = cov.join(v, cov["j"] == v["slot"]).groupBy("component", "i").agg(
        F.sum(F.col("cov") * F.col("loading")).alias("image"))
    residual = (image.join(v.withColumnRenamed("slot", "i"), ["component", "i"])
                .join(values, "component").groupBy("component", "eigenvalue").agg(
        F.sqrt(F.sum(F.pow(F.col("image") - F.col("eigenvalue") * F.col("loading"), 2))).alias("residual")))
    w = v.select(F.col("component").alias("other"), "slot", F.col("loading").alias("w"))
    dots = v.join(w, "slot").groupBy("component", "other").agg(
        F.sum(F.col("loading") * F.col("w")).alias("dot"))
    own = (F.col("component") == F.col("other")).cast("double")
    overlap = dots.groupBy("component").agg(F.max(F.abs(F.col("dot") - own)).alias("overlap"))
    return residual.join(overlap, "component")


def projector(spark: SparkSession, pca_model, k: int) -> DataFrame:
    """``(i, j, value)`` of the projection onto the first k components: the subspace, free of signs."""
    v = loadings(spark, pca_model).filter(F.col("component") <= k)
    other = v.select("component", F.col("slot").alias("j"), F.col("loading").alias("w"))
    return (v.join(other, "component").groupBy(F.col("slot").alias("i"), "j")
            .agg(F.sum(F.col("loading") * F.col("w")).alias("value")))
