"""Scalers and PCA of every cross-validation fit from one pass.

A fit of fold f sees all rows but the fold's. Counts, sums and Gramians add
up, so one pass over the rows, grouped by fold, gives the moments of all k x r
fits as the total less the held-out fold's, instead of a pass (or three, with
the scaler and PCA) per fit. The rows are shifted by one of them first, which
keeps the digits that plain sums of squares would lose to a large mean.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

@dataclass
class Moments:
    """Count, sum and Gramian of shifted rows."""
    n: int
    total: np.ndarray
    gram: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.gram - other.gram)


@dataclass
class FoldMoments:
    """Per group of ``by`` (a tuple) the moments of its rows."""
    by: Sequence[str]
    shift: np.ndarray
    groups: dict[tuple, Moments]

    def without(self, group: tuple) -> Moments:
        """Of the rows that share all but the last key with the group, less the group's."""
        same = [m for g, m in self.groups.items() if g[:-1] == group[:-1]]
        whole = Moments(sum(m.n for m in same), sum(m.total for m in same), sum(m.gram for m in same))
        return whole - self.groups[group]

    def mean(self, m: Moments) -> np.ndarray:
        return self.shift + m.total / m.n

    def covariance(self, m: Moments, ddof: int = 1) -> np.ndarray:
        return (m.gram - np.outer(m.total, m.total) / m.n) / (m.n - ddof)


def fold_moments(df: DataFrame, col: str, by: Sequence[str] = ("repeat", "fold")) -> FoldMoments:
    """The moments of every fold of ``col`` (array or vector; no nulls), in one pass.

    Each task adds up its rows by group in numpy; Spark sums the cells of
    groups x (1 + d + d(d+1)/2) map-side first. The result is bounded by folds
    and features. Without rows there are no groups.
    """
    by = list(by)
    arrays = df.select(*by, _array(df, col).alias("_x"))
    first = arrays.select("_x").first()
    if first is None:
        return FoldMoments(by, np.zeros(0), {})
    shift = np.array(first[0], float)
    d = len(shift)
    rows, cols = np.triu_indices(d)
    # one cell list: the count, the sums, the upper triangle
    size = 1 + d + len(rows)

    def sums(batches):
        groups: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(by, dropna=False, sort=False):
                x = np.vstack(part["_x"].to_numpy()).astype(float) - shift
                cells = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[rows, cols]])
                groups[key] = groups[key] + cells if key in groups else cells
        for key, cells in groups.items():
            yield pd.DataFrame({**{b: [k] * size for b, k in zip(by, key, strict=True)},
                                "cell": np.arange(size, dtype=np.int32), "s": cells})

    schema = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by) + ", cell int, s double"
    cells = arrays.mapInPandas(sums, schema).groupBy(*by, "cell").agg(F.sum("s").alias("s")).toPandas()
    groups = {}
    for key, part in cells.groupby(by, dropna=False):
        s = part.sort_values("cell")["s"].to_numpy()
        gram = np.zeros((d, d))
        gram[rows, cols] = gram[cols, rows] = s[1 + d:]
        groups[tuple(k.item() if hasattr(k, "item") else k for k in key)] = Moments(int(s[0]), s[1:1 + d], gram)
    return FoldMoments(by, shift, groups)


def _array(df: DataFrame, col: str):
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return vector_to_array(F.col(col))


def fold_scalers(spark: SparkSession, moments: FoldMoments, ddof: int = 1) -> DataFrame:
    """Per fold and slot the mean and deviation of the rows outside the fold (F4, F5, F6 with ddof 0)."""
    out = []
    for group in sorted(moments.groups):
        m = moments.without(group)
        mean, var = moments.mean(m), np.diag(moments.covariance(m, ddof))
        out += [(*group, m.n, i, float(a), float(max(v, 0.0) ** 0.5))
                for i, (a, v) in enumerate(zip(mean, var, strict=True))]
    keys = ", ".join(f"`{b}` int" for b in moments.by)
    return spark.createDataFrame(out, f"{keys}, n_rows long, slot int, mean double, std double")


def fold_correlations(spark: SparkSession, moments: FoldMoments) -> DataFrame:
    """Per fold the correlations (i < j) outside it: the covariance of the standardised rows (F8)."""
    parts = []
    for group in sorted(moments.groups):
        cov = moments.covariance(moments.without(group))
        scale = np.sqrt(np.diag(cov))
        i, j = np.triu_indices(len(cov), 1)
        parts.append(pd.DataFrame({
            **{b: np.int32(g) for b, g in zip(moments.by, group, strict=True)},
            "i": i.astype("int32"), "j": j.astype("int32"), "value": cov[i, j] / (scale[i] * scale[j])}))
    keys = ", ".join(f"`{b}` int" for b in moments.by)
    schema = f"{keys}, i int, j int, value double"
    return spark.createDataFrame(pd.concat(parts) if parts else [], schema)


def fold_spectra(spark: SparkSession, moments: FoldMoments, standardise: bool = True) -> DataFrame:
    """Per fold the PCA's explained-variance ratios and their running total.

    The d x d eigen-decompositions are done on the driver, as the library's
    own PCA does its one.
    """
    out = []
    for group in sorted(moments.groups):
        cov = moments.covariance(moments.without(group))
        if standardise:
            scale = np.sqrt(np.diag(cov))
            scale[scale == 0] = 1.0
            cov = cov / np.outer(scale, scale)
        values = np.linalg.eigvalsh(cov)[::-1]
        ratio = values / values.sum()
        out += [(*group, k + 1, float(r), float(c)) for k, (r, c) in
                enumerate(zip(ratio, np.cumsum(ratio), strict=True))]
    keys = ", ".join(f"`{b}` int" for b in moments.by)
    return spark.createDataFrame(out, f"{keys}, component int, ratio double, cumulative double")
