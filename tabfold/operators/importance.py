"""Feature importance tables.

Spark's tree importances are normalised to sum 1 (the single-machine
library reported raw gain); the ranking is the same notion. A one-vs-rest
model has no importances of its own: the sub-models' vectors are averaged.
Names come from the vector column's ML attribute metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.functions.exprs import family


def slot_names(df: DataFrame, col: str) -> list[str]:
    """Slot names of a vector column from its metadata (index order)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    pairs = [(a["idx"], a.get("name", f"{col}_{a['idx']}")) for group in attrs.values() for a in group]
    if not pairs:
        n = meta.get("num_attrs", 0)
        return [f"{col}_{i}" for i in range(n)]
    return [name for _, name in sorted(pairs)]


def _vector(model) -> np.ndarray:
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if type(model).__name__ == "OneVsRestModel":
        return np.mean([_vector(m) for m in model.models], axis=0)
    return model.featureImportances.toArray()


def importances(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """``(feature, importance)``; one row per feature (bounded by d)."""
    vec = _vector(model)
    if len(names) != len(vec):
        raise ValueError(f"{len(names)} feature names for {len(vec)} importances")
    rows = [(str(n), float(v)) for n, v in zip(names, vec, strict=True)]
    schema = T.StructType([T.StructField("feature", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def top_k(imp: DataFrame, k: int = 50, descending: bool = True, by: str = "importance") -> DataFrame:
    """O2: top (or bottom) k by importance, feature name breaks ties."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return imp.orderBy(order, F.col("feature").asc()).limit(k)


def with_family(imp: DataFrame, sep: str = "_", col: str = "feature") -> DataFrame:
    """``category`` = name before the first separator."""
    return imp.withColumn("category", family(col, sep))


def family_summary(imp: DataFrame, sep: str = "_", by: str = "importance") -> DataFrame:
    """A5: per family the sum, mean and count of importance, largest sum first."""
    return (with_family(imp, sep).groupBy("category")
            .agg(F.sum(by).alias("total"), F.avg(by).alias("mean"),
                 F.count(F.lit(1)).alias("n_features"))
            .orderBy(F.col("total").desc(), "category"))
