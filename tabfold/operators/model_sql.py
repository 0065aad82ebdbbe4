"""Fitted models as tables and as SQL.

``node_table`` lists the nodes of a tree learner, ``prediction_sql`` compiles
a learner to one SQL expression over the feature columns that Spark, DuckDB
and most other engines evaluate alike, and ``raw_gain`` sums the gains of the
splits into unnormalised importances. All of them are bounded by the model
(trees x nodes), never by the data; the nodes are read from the saved model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.session import scratch_path

NODE_SCHEMA = ("part int, tree int, weight double, node long, feature int, threshold double, "
               "left_values array<double>, left long, right long, prediction double, impurity double, "
               "gain double, n_rows long")


def learner_of(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def node_rows(spark: SparkSession, model) -> list[tuple]:
    """The rows of ``node_table``."""
    model = learner_of(model)
    if hasattr(model, "models"):            # one-vs-rest: a part per class
        return [(part, *row[1:]) for part, m in enumerate(model.models)
                for row in node_rows(spark, m)]
    path = scratch_path(spark, "nodes")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:
        data = data.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    weights = list(getattr(model, "treeWeights", [1.0]))
    saved: dict[int, dict[int, object]] = {}
    for row in data.collect():
        saved.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    out = []
    for tree, nodes in sorted(saved.items()):
        todo = [(0, 1)]
        while todo:
            at, node = todo.pop()
            n = nodes[at]
            split, leaf = n["split"], n["leftChild"] < 0
            values = list(split["leftCategoriesOrThreshold"])
            continuous = not leaf and split["numCategories"] < 0
            out.append((0, tree, float(weights[tree]), node,
                        None if leaf else int(split["featureIndex"]),
                        float(values[0]) if continuous else None,
                        None if leaf or continuous else [float(v) for v in values],
                        None if leaf else 2 * node, None if leaf else 2 * node + 1,
                        float(n["prediction"]), float(n["impurity"]),
                        None if leaf else float(n["gain"]), int(n["rawCount"])))
            if not leaf:
                todo += [(n["leftChild"], 2 * node), (n["rightChild"], 2 * node + 1)]
    return out


def node_table(spark: SparkSession, model) -> DataFrame:
    """M8 in full: one row per node of a tree, boosted or one-vs-rest boosted model.

    ``part``: the class of a one-vs-rest model, else 0. Nodes are numbered as
    in a heap: the root is 1, the children of n are 2n and 2n + 1. A row goes
    left if its feature is at most ``threshold``, or is one of ``left_values``
    (a categorical split); leaves have neither. ``prediction`` is a class
    index, or a boosted tree's value.
    """
    return spark.createDataFrame(sorted(node_rows(spark, model), key=lambda r: r[:2] + r[3:4]),
                                 NODE_SCHEMA)


def _number(x: float) -> str:
    """A literal that is a double in every engine, digit for digit."""
    return f"{x:.17e}"


def tree_sql(rows: Sequence[tuple], slots: Sequence[str]) -> str:
    """Nested CASE over the nodes of one tree; ``slots``: SQL of each feature."""
    nodes = {r[3]: r for r in rows}

    def case(node: int) -> str:
        _, _, _, _, feature, threshold, values, left, right, prediction, *_ = nodes[node]
        if feature is None:
            return _number(prediction)
        if values is None:
            test = f"{slots[feature]} <= {_number(threshold)}"
        elif values:
            test = f"{slots[feature]} IN ({', '.join(map(_number, values))})"
        else:
            test = "1 = 0"
        return f"CASE WHEN {test} THEN {case(left)} ELSE {case(right)} END"
    return case(1)


def _linear_sql(coefficients: Sequence[float], intercept: float, slots: Sequence[str]) -> str:
    return " + ".join([_number(float(intercept))] + [
        f"{_number(float(c))} * {s}" for c, s in zip(coefficients, slots, strict=True) if c])


def _margins(spark: SparkSession, model, slots: Sequence[str]) -> list[str]:
    """Per part the boosted margin."""
    trees: dict[int, dict[int, list]] = {}
    for row in node_rows(spark, model):
        trees.setdefault(row[0], {}).setdefault(row[1], []).append(row)
    return [" + ".join(f"{_number(rows[0][2])} * ({tree_sql(rows, slots)})"
                       for _, rows in sorted(parts.items())) for _, parts in sorted(trees.items())]


def _largest(values: Sequence[str]) -> str:
    """The index of the first largest of several expressions."""
    cases = [f"WHEN {' AND '.join(f'({v}) >= ({w})' for w in values if w is not v)} THEN {i}.0e0"
             for i, v in enumerate(values[:-1])]
    return f"CASE {' '.join(cases)} ELSE {len(values) - 1}.0e0 END"


def index_sql(spark: SparkSession, model, slots: Sequence[str]) -> str:
    """SQL of the learner's class index."""
    model = learner_of(model)
    if hasattr(model, "coefficientMatrix"):
        if model.numClasses == 2:
            margin = _linear_sql(model.coefficients.toArray(), model.intercept, slots)
            return f"CASE WHEN {margin} > 0 THEN 1.0e0 ELSE 0.0e0 END"
        rows = model.coefficientMatrix.toArray()
        return _largest([_linear_sql(r, b, slots) for r, b in
                         zip(rows, model.interceptVector.toArray(), strict=True)])
    if hasattr(model, "models"):
        return _largest(_margins(spark, model, slots))
    if hasattr(model, "treeWeights"):
        return f"CASE WHEN {_margins(spark, model, slots)[0]} > 0 THEN 1.0e0 ELSE 0.0e0 END"
    return tree_sql(node_rows(spark, model), slots)


def slot_sql(columns: Sequence[str], category_maps: Mapping[int, Mapping[float, int]]) -> list[str]:
    """SQL of each slot: the column as a double, or its category index."""
    out = []
    for i, c in enumerate(columns):
        x = f"CAST({c} AS DOUBLE)"
        if i in category_maps:
            cases = " ".join(f"WHEN {x} = {_number(float(v))} THEN {k}.0e0"
                             for v, k in category_maps[i].items())
            x = f"(CASE {cases} END)"
        out.append(x)
    return out


def prediction_sql(spark: SparkSession, model: PipelineModel, feature_cols: Sequence[str],
                   labels: Sequence[str] | None = None) -> str:
    """M7 outside Spark ML: SQL of a pipeline's prediction over its feature columns.

    ``model`` ends in a tree, boosted, one-vs-rest boosted or logistic learner;
    a category indexer before it is compiled in. ``labels`` (of the label
    indexer) turn the class index into the label's text.
    """
    maps = {}
    for stage in model.stages[:-1]:
        if hasattr(stage, "categoryMaps"):
            maps = {int(i): {float(v): int(k) for v, k in m.items()}
                    for i, m in stage.categoryMaps.items()}
    index = index_sql(spark, model, slot_sql(feature_cols, maps))
    if labels is None:
        return index
    return f"CASE ({index}) " + " ".join(
        f"WHEN {i}.0e0 THEN '" + str(v).replace("'", "''") + "'" for i, v in enumerate(labels)) + " END"


def raw_gain(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """E4 unnormalised: per feature the splits and the sum of gain x rows, features without a split too."""
    spark = nodes.sparkSession
    sums = nodes.filter("feature is not null").groupBy("feature").agg(
        F.count("*").alias("n_splits"), F.sum(F.col("gain") * F.col("n_rows")).alias("gain"))
    every = spark.createDataFrame([(i, str(n)) for i, n in enumerate(names)], "slot int, feature string")
    return every.join(sums.withColumnRenamed("feature", "slot"), "slot", "left").select(
        "feature", F.coalesce("n_splits", F.lit(0)).alias("n_splits"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"))
