"""K-class boosting in one softmax."""

import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabfold.operators import softmax


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select(
        (F.col("id") % 30).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        (F.xxhash64("id") % 10).alias("noise"))
    label = F.when(F.col("a") < 8, 0).when(F.col("a") < 20, 1).otherwise(2)
    df = df.withColumn("rule", label).withColumn(
        "y", F.when(F.col("noise") == 0, (label + 1) % 3).otherwise(label).cast("double"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).persist()


def _loss(scored):
    p = F.element_at("probability", F.col("y").cast("int") + 1)
    return scored.agg(F.avg(-F.log(p))).first()[0]


def test_softmax_sees_through_noise_and_loss_falls(rows):
    def fitted(n):
        return softmax.fit(rows, "features", "y", n_rounds=n, checkpoint_every=2, max_depth=2)
    model = fitted(4)
    scored = model.transform(rows)
    assert scored.filter(F.col("prediction") != F.col("rule")).count() == 0
    sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p).alias("s")).collect()
    assert all(math.isclose(r["s"], 1, abs_tol=1e-12) for r in sums)
    assert _loss(scored) < _loss(fitted(1).transform(rows)) < math.log(3)
    share = model.importances()
    assert math.isclose(sum(share), 1) and share[0] > 0.9


def test_first_step_is_newton(rows):
    """A stump-less tree (depth 0) leaves the prior: the mean residual of the shares is zero."""
    model = softmax.fit(rows, "features", "y", n_rounds=1, max_depth=0)
    shares = {int(r["y"]): r["count"] / 900 for r in rows.groupBy("y").count().collect()}
    got = model.transform(rows).first()["probability"]
    assert all(math.isclose(got[k], shares[k], abs_tol=1e-9) for k in shares)


def test_one_class_is_refused(rows):
    with pytest.raises(ValueError):
        softmax.fit(rows.withColumn("y", F.lit(0.0)), "features", "y")
