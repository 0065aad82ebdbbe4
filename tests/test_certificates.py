"""Compiled models against DuckDB, certificates on right and wrong fits, exact-size splits."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import SF0001
from tabfold.operators import (evaluate, importance, model_sql, models, optimality,
                               reduce as red, sampling)
from tabfold.plans import certificates as cert
from tabfold.plans import experiment as ex
from tabfold.sources.tables import read_table

FEATURES = ("l_discount", "l_tax", "l_linenumber", "kind")


@pytest.fixture(scope="module")
def rows(spark):
    """lineitem with a three-valued feature (a categorical split) and an oblique label."""
    return spark.read.parquet(f"{SF0001}/lineitem.parquet").select(
        "*", F.expr("CAST(l_orderkey % 3 AS INT) AS kind"),
        F.expr(f"{cert.OBLIQUE} + CAST(l_orderkey % 3 = 1 AS INT) AS three")).withColumn(
        "two", F.expr("CAST(three > 0 AS INT)")).withColumn("uid", F.monotonically_increasing_id()).persist()


@pytest.mark.parametrize("learner,label,params", [
    ("tree", "three", {}), ("gbt", "two", {"max_iter": 4}), ("ovr_gbt", "three", {"max_iter": 2}),
    ("logistic", "two", {}), ("logistic", "three", {}), ("lasso", "two", {"reg_param": 0.01})])
def test_duckdb_scores_rows_as_the_model_does(spark, rows, learner, label, params):
    prep = ex.prepare(rows, FEATURES, label, ["uid"])
    model, scored = ex.fit_and_score(prep, ex.learner_for(learner, **params))
    sql = model_sql.prediction_sql(spark, model, FEATURES, prep.label_model.labels)
    want = dict(scored.select("uid", "predictedLabel").collect())
    assert len(set(want.values())) > 1
    flat = rows.select("uid", *FEATURES).toPandas()     # noqa: F841  read by DuckDB
    got = dict(duckdb.sql(f"SELECT uid, {sql} FROM flat").fetchall())
    assert got == want
    prep.data.unpersist()


def test_raw_gain_normalises_to_importances(spark, rows):
    prep = ex.prepare(rows, FEATURES, "three", ["uid"])
    model, _ = ex.fit_and_score(prep, ex.learner_for("tree"))
    nodes = model_sql.node_table(spark, model)
    gains = {r["feature"]: r["gain"] for r in model_sql.raw_gain(nodes, FEATURES).collect()}
    shares = {r["feature"]: r["importance"] for r in importance.importances(spark, model, FEATURES).collect()}
    total = sum(gains.values())
    assert total > 1 and all(math.isclose(gains[f] / total, shares[f], abs_tol=1e-12) for f in FEATURES)
    # the children of a split hold its rows
    by = {r["node"]: r for r in nodes.collect()}
    assert all(r["left"] is None or by[r["left"]]["n_rows"] + by[r["right"]]["n_rows"] == r["n_rows"]
               for r in by.values())
    assert any(r["left_values"] for r in by.values())     # kind is split by values


@pytest.mark.parametrize("reg,alpha,standardization", [(0.0, 0.0, True), (0.03, 1.0, True), (0.05, 0.3, True),
                                                       (0.01, 1.0, False)])
def test_certificate_tells_a_minimum(spark, rows, reg, alpha, standardization):
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def found(**params):
        fit = models.logistic("two", reg_param=reg, elastic_net=alpha, standardization=standardization,
                              **params).fit(data)
        return {r["feature"]: r for r in
                optimality.certificate(data, fit, FEATURES, label_col="two").collect()}
    done = found(maxIter=500, tol=1e-14)
    assert set(done) == {optimality.INTERCEPT, *FEATURES}
    assert all(r["optimal"] for r in done.values()), done
    early = found(maxIter=1)
    assert not all(r["optimal"] for r in early.values())


def test_eigen_certificate_tells_eigenpairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    data = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    from pyspark.ml.functions import array_to_vector
    vectors = data.select(array_to_vector("x").alias("features"))
    pca = red.fit_pca(vectors, "features", "pca", 4)
    cov, total = red.covariance(vectors, "features"), red.total_variance(vectors, "features")
    good = red.eigen_certificate(cov, pca, total).collect()
    assert len(good) == 4 and all(r["residual"] < 1e-9 and r["overlap"] < 1e-9 for r in good)
    other = cov.withColumn("cov", F.when(F.col("i") == 0, F.col("cov") * 2).otherwise(F.col("cov")))
    assert max(r["residual"] for r in red.eigen_certificate(other, pca, total).collect()) > 1e-3
    whole = {(r["i"], r["j"]): r["value"] for r in red.projector(spark, pca, 4).collect()}
    assert all(math.isclose(v, i == j, abs_tol=1e-9) for (i, j), v in whole.items())


@pytest.mark.parametrize("n", [0, 1, 2, 7, 999])
def test_exact_split_to_the_row(spark, n):
    data = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    for fraction in (0.0, 0.3, 0.5, 1.0):
        for layout in (1, 5):
            got = sampling.exact_split(data.repartition(layout), 7, fraction, digits=1)
            sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
            assert sizes.get("test", 0) == math.ceil(fraction * n - 1e-9)
            assert sum(sizes.values()) == n
    a = sampling.exact_split(data, 7).collect()
    assert sorted(a) == sorted(sampling.exact_split(data.repartition(3), 7, digits=2).collect())


def test_exact_split_by_a_key(spark):
    data = spark.range(500).withColumn("x", F.lit("a"))
    got = sampling.exact_split(data, 1, 0.3, keys=["id"])
    assert got.columns == ["id", "x", "split"]
    assert got.filter("split = 'test'").count() == 150


def test_collapsed_cross_validation_scores_alike(spark, rows):
    prep = ex.prepare(rows.select("uid", "l_tax", "l_linenumber", "three"), ("l_tax", "l_linenumber"),
                      "three", ["uid"])

    def scores(**params):
        cv = ex.cross_validate(prep, "tree", 3, 1, seed=1, keys=["uid"], **params)
        return sorted((r["fold"], r["n_rows"], round(r["balanced_accuracy"], 12)) for r in cv.collect())
    assert scores(collapse=True) == scores()
    with pytest.raises(ValueError):
        scores(collapse=True, variant="scaled")


def test_small_scan_of_several_splits_is_spread(spark, tmp_dir):
    path = f"{tmp_dir}/t.parquet"
    spark.range(200_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")    # several splits, one row group
    try:
        df = read_table(spark, tmp_dir, "t", spread=True)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert read_table(spark, tmp_dir, "t").rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.2 * min(sizes)


def test_confusion_matrix_of_any_number_of_classes(spark):
    scored = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), (None, "a")],
                                   "label string, prediction string")
    got = {(r["label"], r["prediction"]): r["n"] for r in evaluate.confusion_matrix(scored).collect()}
    assert got[("a", "b")] == 1 and got[("b", "a")] == 0 and got[(None, "a")] == 1
    assert len(got) == 3 * 4


