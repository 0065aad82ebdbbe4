"""Feature transformers.

Spark ML estimators are used as they are; the helpers fix the parameters the
reference relies on and add the one variant Spark lacks (population std).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import (
    ElementwiseProduct, IndexToString, StandardScaler, StringIndexer, VectorAssembler,
    VectorIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembler(cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    """F1. ``handle_invalid``: 'error' (raise on null/NaN), 'skip' or 'keep'."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    return assembler(cols, out, handle_invalid).transform(df)


def fit_label_index(df: DataFrame, col: str = "label", out: str = "indexedLabel",
                    handle_invalid: str = "error"):
    """index by descending frequency, ties alphabetical. Numbers are
    indexed as text. Fit on the whole table so every class gets an index."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="frequencyDesc",
                         handleInvalid=handle_invalid).fit(df)


def label_names(label_model, col: str = "prediction", out: str = "predictedLabel") -> IndexToString:
    """Map predicted indices back to the original label text."""
    return IndexToString(inputCol=col, outputCol=out, labels=label_model.labels)


def fit_category_index(df: DataFrame, col: str = "features", out: str = "indexedFeatures",
                       max_categories: int = 4, handle_invalid: str = "error"):
    """features with <= max_categories distinct values become categorical
    (value 0 keeps index 0, the rest ascending); others stay continuous."""
    return VectorIndexer(inputCol=col, outputCol=out, maxCategories=max_categories,
                         handleInvalid=handle_invalid).fit(df)


def fit_scaler(train: DataFrame, col: str = "features", out: str = "normFeatures",
               with_mean: bool = False, with_std: bool = True):
    """F4 (with_mean=False, library default) / F5 (with_mean=True).
    Sample std (n-1); a zero-variance slot maps to 0."""
    return StandardScaler(inputCol=col, outputCol=out, withMean=with_mean,
                          withStd=with_std).fit(train)


class PopulationScaler:
    """standardise with the population std (ddof=0), as the single-machine
    scaler does. ``(x - mean) / std_pop = StandardScaler(x) * sqrt(n / (n - 1))``,
    so it is the Spark scaler followed by a constant ElementwiseProduct."""

    def __init__(self, col: str = "features", out: str = "normFeatures", with_mean: bool = True):
        self.col, self.out, self.with_mean = col, out, with_mean

    def fit(self, train: DataFrame):
        tmp = f"_{self.out}_samp"
        model = StandardScaler(inputCol=self.col, outputCol=tmp, withMean=self.with_mean,
                               withStd=True).fit(train)
        n = train.count()
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        d = len(model.std)
        prod = ElementwiseProduct(scalingVec=Vectors.dense([factor] * d), inputCol=tmp,
                                  outputCol=self.out)
        return _PopulationScalerModel(model, prod, tmp)


class _PopulationScalerModel:
    def __init__(self, model, prod, tmp):
        self.model, self.prod, self.tmp = model, prod, tmp

    def transform(self, df: DataFrame) -> DataFrame:
        return self.prod.transform(self.model.transform(df)).drop(self.tmp)


class CountedScaler:
    """F4 / F5 for rows that stand for ``count_col`` equal ones each.

    The library's weighted variance divides by n - sum(w^2) / n, as for weights
    that are reliabilities; counted rows have n - 1.
    """

    def __init__(self, col: str = "features", out: str = "normFeatures", with_mean: bool = False,
                 count_col: str = "weight"):
        self.col, self.out, self.with_mean, self.count_col = col, out, with_mean, count_col

    def fit(self, train: DataFrame):
        w = F.col(self.count_col)
        row = train.agg(Summarizer.metrics("mean", "variance").summary(F.col(self.col), w).alias("s"),
                        F.sum(w).alias("n"), F.sum(w * w).alias("squares")).first()
        n = row["n"] or 0.0
        # two rows at least, or no deviation
        share = (n - row["squares"] / n) / (n - 1) if n > 1 else 0.0
        std = [max(v * share, 0.0) ** 0.5 for v in row["s"]["variance"].toArray().tolist()]
        mean = row["s"]["mean"].toArray().tolist() if self.with_mean else [0.0] * len(std)
        return _CountedScalerModel(self.col, self.out, mean, std)


class _CountedScalerModel:
    def __init__(self, col, out, mean, std):
        self.col, self.out, self.mean, self.std = col, out, mean, std

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.col))
        slots = [(x[i] - F.lit(m)) * F.lit(1.0 / s if s else 0.0)
                 for i, (m, s) in enumerate(zip(self.mean, self.std, strict=True))]
        return df.withColumn(self.out, array_to_vector(F.array(*slots)))


def flatten(df: DataFrame, col: str, prefix: str, n: int, keep: Sequence[str] = (),
            digits: int | None = None) -> DataFrame:
    """Vector column -> ``prefix0 .. prefix{n-1}`` double columns.

    The vector is converted to an array once, in its own projection; the
    slots are then cheap array lookups (no per-slot conversion, small
    generated code even for hundreds of slots)."""
    arr = df.select(*keep, vector_to_array(F.col(col)).alias("_arr"))
    vals = []
    for i in range(n):
        v = F.col("_arr")[i]
        if digits is not None:
            v = F.round(v, digits)
        vals.append(v.alias(f"{prefix}{i}"))
    return arr.select(*keep, *vals)
