"""Optimality certificates of logistic and lasso fits.

A fit minimises mean log loss + penalty x (alpha |b|_1 + (1 - alpha) / 2 |b|_2^2),
with b the coefficients of the features scaled to unit standard deviation. At
the minimum the scaled gradient of the loss of a nonzero coefficient equals
minus the penalty's slope, and that of a zero one lies within the L1 penalty.
``certificate`` reports both sides per coefficient, from one aggregation over
the rows (vector sums in the JVM, combined map-side), whatever their number.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(intercept)"
SCHEMA = ("feature string, coefficient double, std double, gradient double, slope double, "
          "violation double, optimal boolean")


def certificate(train: DataFrame, model, names, features_col: str = "features",
                label_col: str = "indexedLabel", tolerance: float = 1e-5) -> DataFrame:
    """One row per coefficient: feature, coefficient, std, gradient, slope, violation, optimal.

    ``train``: the rows of the fit, with its vector and 0/1 label. ``gradient``:
    of the mean log loss, for the scaled feature; ``slope``: of the penalty, for
    a zero coefficient the L1 penalty that the gradient may reach. A constant
    feature has std 0; its coefficient must be zero. Binary models only.
    """
    model = model.stages[-1] if hasattr(model, "stages") else model
    if not isinstance(model, LogisticRegressionModel) or model.numClasses != 2:
        raise ValueError("a binary logistic model is needed")
    scored = model.transform(train).select(
        F.col(features_col).alias("x"), F.col(label_col).cast("double").alias("y"),
        vector_to_array("probability")[1].alias("p"))
    # sums of weighted vectors: residuals have both signs, weights may not
    row = scored.agg(
        F.count("*").alias("n"), F.sum(F.col("p") - F.col("y")).alias("r"),
        Summarizer.metrics("std").summary(F.col("x")).alias("all"),
        Summarizer.metrics("sum").summary(F.col("x"), F.col("p")).alias("up"),
        Summarizer.metrics("sum").summary(F.col("x"), F.col("y")).alias("down")).first()
    n, penalty = row["n"], model.getRegParam()
    l1, l2 = penalty * model.getElasticNetParam(), penalty * (1 - model.getElasticNetParam())
    scaled = model.getStandardization()
    rows = [(INTERCEPT, float(model.intercept), None, row["r"] / n, 0.0, abs(row["r"] / n))]
    for i, (name, b) in enumerate(zip(names, model.coefficients.toArray(), strict=True)):
        std = float(row["all"]["std"][i])
        unit = std if scaled else 1.0
        if std == 0:
            rows.append((name, float(b), std, 0.0, l1, abs(float(b))))
            continue
        gradient = float(row["up"]["sum"][i] - row["down"]["sum"][i]) / n / unit
        slope = l1 if b == 0 else math.copysign(l1, b) + l2 * float(b) * unit
        violation = max(0.0, abs(gradient) - l1) if b == 0 else abs(gradient + slope)
        rows.append((name, float(b), std, gradient, slope, violation))
    return train.sparkSession.createDataFrame([(*r, r[-1] <= tolerance) for r in rows], SCHEMA)
