"""Learners, pipelines, scoring and model summaries.

Spark ML's distributed learners are used as they are: tree learners
aggregate per-level histograms across executors, L-BFGS/OWL-QN aggregate
gradients with treeAggregate. Only parameters are chosen here.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabfold.operators.softmax import SoftmaxBoosting


def decision_tree(label_col: str = "indexedLabel", features_col: str = "indexedFeatures", **params):
    """M1: library defaults (maxDepth 5, maxBins 32, gini)."""
    return DecisionTreeClassifier(labelCol=label_col, featuresCol=features_col, **params)


def logistic(label_col: str = "indexedLabel", features_col: str = "features",
             reg_param: float = 0.0, elastic_net: float = 0.0, **params):
    """M2: no penalty by default. M3: ``reg_param`` > 0 with ``elastic_net``
    in [0, 1] (1 = lasso)."""
    return LogisticRegression(labelCol=label_col, featuresCol=features_col, regParam=reg_param,
                              elasticNetParam=elastic_net, **params)


def lasso(label_col: str = "indexedLabel", features_col: str = "features", reg_param: float = 0.1,
          **params):
    """M3 as published: L1 with regParam 0.1."""
    return logistic(label_col, features_col, reg_param=reg_param, elastic_net=1.0, **params)


def boosted(label_col: str = "indexedLabel", features_col: str = "indexedFeatures",
            max_iter: int = 20, **params):
    """M4: binary gradient-boosted trees, defaults 20 rounds, depth 5.
    Intermediate predictions are checkpointed every ``checkpointInterval``
    rounds into the session's checkpoint dir, which cuts the lineage."""
    return GBTClassifier(labelCol=label_col, featuresCol=features_col, maxIter=max_iter, **params)


def boosted_multiclass(label_col: str = "indexedLabel", features_col: str = "indexedFeatures",
                       max_iter: int = 20, parallelism: int = 1, **params):
    """M5: k-class boosting as one-vs-rest GBT (GBT alone is binary).
    ``parallelism`` fits the k binary models concurrently on one session."""
    weight = {k: params.pop(k) for k in ("weightCol",) if k in params}
    gbt = GBTClassifier(maxIter=max_iter, **params)
    return OneVsRest(classifier=gbt, labelCol=label_col, featuresCol=features_col,
                     parallelism=parallelism, **weight)


def boosted_softmax(label_col: str = "indexedLabel", features_col: str = "indexedFeatures",
                    max_iter: int = 20, **params):
    """M5: k-class boosting in one softmax (``tabfold.operators.softmax``)."""
    return SoftmaxBoosting(labelCol=label_col, featuresCol=features_col, n_rounds=max_iter, **params)


LEARNERS = {
    "tree": decision_tree,
    "logistic": logistic,
    "lasso": lasso,
    "gbt": boosted,
    "ovr_gbt": boosted_multiclass,
    "softmax": boosted_softmax,
}


def pipeline(*stages) -> Pipeline:
    """M6: fitted indexers may be passed as stages; ``fit`` then only applies
    them and trains the learner."""
    return Pipeline(stages=list(stages))


def fit(stages, train: DataFrame) -> PipelineModel:
    return pipeline(*stages).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """M7: ``prediction`` (+ ``probability``/``rawPrediction``) for every row."""
    return model.transform(df)


SUMMARY_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("num_trees", T.IntegerType()),
    T.StructField("total_nodes", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("num_features", T.IntegerType()),
    T.StructField("num_classes", T.IntegerType()),
])


def _learner(model):
    if isinstance(model, PipelineModel):
        return model.stages[-1]
    return model


def _summary_rows(name: str, m) -> list[tuple]:
    cls = type(m).__name__
    if hasattr(m, "models") and cls == "OneVsRestModel":
        rows = []
        for i, sub in enumerate(m.models):
            rows += _summary_rows(f"{name}[{i}]", sub)
        return rows
    n_classes = getattr(m, "numClasses", None)
    if hasattr(m, "trees"):
        trees = m.trees
        return [(name or cls, len(trees), int(m.totalNumNodes), max(t.depth for t in trees),
                 int(m.numFeatures), n_classes)]
    if hasattr(m, "depth"):
        return [(name or cls, 1, int(m.numNodes), int(m.depth), int(m.numFeatures), n_classes)]
    return [(name or cls, 0, 0, 0, int(m.numFeatures), n_classes)]


def model_summary(spark: SparkSession, model, name: str = "") -> DataFrame:
    """M8: what ``print(model)`` says, as a table (one row per (sub-)model)."""
    return spark.createDataFrame(_summary_rows(name, _learner(model)), SUMMARY_SCHEMA)
