"""K-class boosting on shared softmax residuals.

A round fits one regression tree per class, Spark ML's own, to the Newton
step of the multinomial log loss: the target is residual / curvature and the
weight the curvature, so a leaf's weighted mean is the step, and the tree's
splits are those of second-order boosting. Unlike one-vs-rest, the classes
compete in one softmax, and their probabilities sum to 1.

The margins of the train rows are columns that a round adds to; a round's rows
are cached, and every ``checkpoint_every`` rounds they are checkpointed to the
session's checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfold.session import ensure_checkpoint_dir

LEAST_CURVATURE = 1e-6      # keeps the step of a settled row finite


def _probabilities(margins: Sequence[Column]) -> list[Column]:
    """Softmax, shifted by the largest margin so that no power overflows."""
    top = F.greatest(*margins)
    powers = [F.exp(m - top) for m in margins]
    return [p / sum(powers[1:], powers[0]) for p in powers]


@dataclass
class SoftmaxModel:
    """``trees``: all rounds' trees as one pipeline, tree k of round r predicts column _t{r}_{k}."""
    trees: PipelineModel
    prior: list[float]
    rate: float
    n_rounds: int

    @property
    def num_classes(self) -> int:
        return len(self.prior)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds rawPrediction and probability (arrays by class index) and prediction."""
        scored = self.trees.transform(df)
        steps = [[f"_t{r}_{k}" for r in range(self.n_rounds)] for k in range(self.num_classes)]
        margins = [sum([F.col(c) * self.rate for c in s], F.lit(p))
                   for s, p in zip(steps, self.prior, strict=True)]
        raw = scored.withColumn("rawPrediction", F.array(*margins)).drop(*[c for s in steps for c in s])
        at = [F.col("rawPrediction")[k] for k in range(self.num_classes)]
        return raw.withColumn("probability", F.array(*_probabilities(at))).withColumn(
            "prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def importances(self) -> list[float]:
        """Mean of the trees' normalised importances, by slot."""
        parts = [t.featureImportances.toArray() for t in self.trees.stages]
        return (sum(parts) / len(parts)).tolist()


def fit(train: DataFrame, features_col: str = "indexedFeatures", label_col: str = "indexedLabel",
        n_rounds: int = 20, rate: float = 0.3, max_depth: int = 5, seed: int = 2342,
        checkpoint_every: int = 10, weight_col: str | None = None, **params) -> SoftmaxModel:
    """Boost ``n_rounds`` rounds of one tree per class; class indices are 0, 1, ...

    Classes start at the log of their shares. A class index without rows (below
    the largest) starts at a share of 1e-9. ``weight_col`` gives rows' weights (a
    row of weight 0 counts for nothing). ``params`` go to the trees.
    """
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    counts = dict(train.groupBy(F.col(label_col).cast("int")).agg(F.sum(weight)).collect())
    n, n_classes = sum(counts.values()), max(counts, default=-1) + 1
    if n_classes < 2:
        raise ValueError("at least two classes are needed")
    prior = [math.log(max(counts.get(k, 0) / n, 1e-9)) for k in range(n_classes)]
    ensure_checkpoint_dir(train.sparkSession)
    margins = [f"_f{k}" for k in range(n_classes)]
    rows = train.select(features_col, F.col(label_col).cast("int").alias("_y"), weight.alias("_n"),
                        *[F.lit(p).alias(m) for p, m in zip(prior, margins, strict=True)])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    stages = []
    try:
        for r in range(n_rounds):
            shares = _probabilities([F.col(m) for m in margins])
            curved = [F.greatest(p * (1 - p) * (n_classes / (n_classes - 1)), F.lit(LEAST_CURVATURE))
                      for p in shares]
            step = rows.select("*", *[(c * F.col("_n")).alias(f"_w{k}") for k, c in enumerate(curved)], *[
                (((F.col("_y") == k).cast("double") - p) / c).alias(f"_g{k}")
                for k, (p, c) in enumerate(zip(shares, curved, strict=True))])

            def one(k, step=step, r=r):
                return DecisionTreeRegressor(
                    featuresCol=features_col, labelCol=f"_g{k}", weightCol=f"_w{k}", maxDepth=max_depth,
                    seed=seed, predictionCol=f"_t{r}_{k}", **params).fit(step)
            with ThreadPoolExecutor(n_classes) as pool:
                trees = list(pool.map(one, range(n_classes)))
            stages += trees
            moved = PipelineModel(trees).transform(rows).select(features_col, "_y", "_n", *[
                (F.col(m) + F.col(f"_t{r}_{k}") * rate).alias(m) for k, m in enumerate(margins)])
            if r + 1 < n_rounds:
                if (r + 1) % checkpoint_every == 0:
                    moved = moved.checkpoint()
                moved = moved.persist(StorageLevel.MEMORY_AND_DISK)
                moved.count()
                rows.unpersist()
                rows = moved
    finally:
        rows.unpersist()
    return SoftmaxModel(PipelineModel(stages), prior, rate, n_rounds)


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol):
    """``fit`` as a pipeline stage, for the same calls as Spark ML's learners."""

    def __init__(self, labelCol: str = "indexedLabel", featuresCol: str = "indexedFeatures",
                 weightCol: str | None = None, **params):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.settings = {**params, "weight_col": weightCol}

    def _fit(self, dataset: DataFrame) -> SoftmaxStage:
        return SoftmaxStage(fit(dataset, self.getFeaturesCol(), self.getLabelCol(), **self.settings))


class SoftmaxStage(Model):
    """A fitted ``SoftmaxModel`` inside a PipelineModel."""

    def __init__(self, model: SoftmaxModel):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)
