"""One result whatever the layout, the bucket size or the nulls."""

import pytest
from pyspark.sql import functions as F

from tabfold.operators import evaluate, importance, models, sampling, wrangle
from tabfold.sources import delimited


def test_hot_key_folds_do_not_depend_on_layout_or_bucket_size(spark):
    """Half the rows share a key but differ; some are equal in every column."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 3).alias("c"), (F.col("id") % 1500).alias("x"))

    def folds(data, rows_per_bucket):
        out = sampling.stratified_folds(data, ["k"], "c", 10, 2, seed=3, keep=["x"],
                                        rows_per_bucket=rows_per_bucket, hot_factor=2)
        return sorted(map(tuple, out.select("k", "c", "x", "repeat", "fold").collect()))

    want = folds(df, 1 << 20)
    assert folds(df, 64) == want
    assert folds(df.repartition(7), 64) == want


def test_equal_rows_are_cut_and_stay_balanced(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.lit("a").alias("c"))
    out = sampling.stratified_folds(df, ["k"], "c", 10, 1, seed=3, rows_per_bucket=64, hot_factor=2)
    assert [r["count"] for r in out.groupBy("fold").count().collect()] == [300] * 10


def test_copies_go_to_both_sides_whatever_the_layout(spark):
    """Half the rows are equal; the split is near 70 % and independent of layout and chunk."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("x"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise("a").alias("c"))

    def split(data, chunk):
        rows = sampling.numbered_copies(data, chunk=chunk)
        return sorted(map(str, sampling.hash_split(rows, ["x", "_copy"], 1).collect()))

    want = split(df, 1 << 16)
    assert len(want) == 4000 and split(df.repartition(7), 100) == want
    assert abs(sum("train" in r for r in want) / 4000 - 0.7) < 0.03
    copies = [r for r in want if "x=-1," in r]
    assert abs(sum("train" in r for r in copies) / len(copies) - 0.7) < 0.04


def test_collated_results_whatever_their_header(spark, tmp_dir):
    import os

    from tabfold.sources import sinks
    for name, head in (("a", "metric,value,seed"), ("b", "Metric, Value, SEED")):
        os.makedirs(f"{tmp_dir}/runs/model={name}")
        with open(f"{tmp_dir}/runs/model={name}/x.csv", "w") as f:
            f.write(f"{head}\nTest accuracy, 0.5,1\nTest accuracy,1.0, 2\n")
    got = sinks.read_collated(spark, f"{tmp_dir}/runs")
    summary = {r["model"]: r for r in evaluate.seed_summary(got).collect()}
    assert {m: (r["mean"], r["n_runs"]) for m, r in summary.items()} == {"a": (0.75, 2), "b": (0.75, 2)}


def test_null_class_counts(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), (None, None), ("a", None)],
                               "label string, prediction string")
    got = {(r["label"], r["prediction"]): (r["n"], r["rate"])
           for r in evaluate.confusion_matrix(df).collect()}
    assert got == {(x, y): (1, 0.5) for x in ("a", None) for y in ("a", None)}


def test_one_vs_rest_takes_weights(spark):
    df = spark.range(60).select((F.col("id") % 3).cast("double").alias("y"), F.lit(1.0).alias("w"),
                                (F.col("id") % 3).cast("double").alias("x"))
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    model = models.boosted_multiclass("y", "f", max_iter=1, weightCol="w").fit(data)
    assert model.transform(data).filter("prediction <> y").count() == 0


def test_importances_need_a_name_each(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    data = spark.createDataFrame([(0.0, Vectors.dense(0, 1)), (1.0, Vectors.dense(1, 1))], ["y", "f"])
    model = DecisionTreeClassifier(labelCol="y", featuresCol="f").fit(data)
    with pytest.raises(ValueError):
        importance.importances(spark, model, ["only"])


def test_header_in_another_file(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write("1,2.5\n2,3.5\n" * 20)
    with open(f"{tmp_dir}/in/b.csv", "w") as f:
        f.write("t,a\n,x\n,y\ntrack_id,\n3,4.5\n")
    with pytest.raises(ValueError):
        delimited.read_multi_header(spark, f"{tmp_dir}/in")
    df = delimited.read_multi_header(spark, f"{tmp_dir}/in", header_path=f"{tmp_dir}/in/b.csv")
    assert df.columns == ["track_id", "a_x_y"] and df.count() == 41


def test_size_check_measures_and_meets_in_no_single_task(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("s"))
    assert wrangle.measured_bytes(df) == 100 * (16 + 8 + 8 + 10_000)
    assert wrangle.broadcast_if_small(df, max_bytes=100_000) is df
    assert wrangle.measured_bytes(spark.range(3).select(F.array("id").alias("a"))) is None
