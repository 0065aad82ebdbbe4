"""Moments of all folds from one pass against a fit per fold."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabfold.operators import features, foldwise, reduce as red


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(5)
    # a mean far from zero, a constant column, folds of unequal size, two repeats
    x = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) + 1e6
    x[:, 4] = 3.0
    rows = [(int(r), int((i + r * (i // 5)) % 4 % 3), x[i].tolist()) for r in range(2) for i in range(90)]
    return spark.createDataFrame(rows, "repeat int, fold int, x array<double>").withColumn(
        "v", array_to_vector("x")).repartition(5).persist()


@pytest.mark.parametrize("col", ["x", "v"])
def test_scalers_equal_those_fitted_per_fold(spark, folds, col):
    moments = foldwise.fold_moments(folds, col)
    got = {(r["repeat"], r["fold"], r["slot"]): r for r in foldwise.fold_scalers(spark, moments).collect()}
    assert len(got) == 2 * 3 * 5
    for repeat in range(2):
        for fold in range(3):
            seen = folds.filter((F.col("repeat") == repeat) & (F.col("fold") != fold))
            fit = features.fit_scaler(seen, "v", "out", with_mean=True)
            for slot in range(5):
                r = got[repeat, fold, slot]
                assert r["n_rows"] == seen.count()
                assert np.isclose(r["mean"], fit.mean[slot], rtol=1e-12)
                assert np.isclose(r["std"], fit.std[slot], rtol=1e-9, atol=1e-9)


def test_spectra_equal_those_fitted_per_fold(spark, folds):
    moments = foldwise.fold_moments(folds, "v")
    got = {(r["repeat"], r["fold"], r["component"]): r["ratio"]
           for r in foldwise.fold_spectra(spark, moments).collect()}
    for fold in range(3):
        seen = folds.filter((F.col("repeat") == 1) & (F.col("fold") != fold))
        scaled = features.fit_scaler(seen, "v", "out", with_mean=True).transform(seen)
        want = red.fit_pca(scaled, "out", "pca", 5).explainedVariance.toArray()
        assert np.allclose([got[1, fold, k + 1] for k in range(5)], want, atol=1e-8)


def test_layout_does_not_matter_and_no_rows_give_no_folds(spark, folds):
    def spread(n):
        m = foldwise.fold_moments(folds.repartition(n), "v")
        return foldwise.fold_correlations(spark, m).filter("j < 4").orderBy("repeat", "fold", "i", "j").collect()
    for a, b in zip(spread(1), spread(7), strict=True):
        assert a[:4] == b[:4] and np.isclose(a["value"], b["value"], atol=1e-9)
    none = foldwise.fold_moments(folds.limit(0), "x")
    assert none.groups == {} and foldwise.fold_scalers(spark, none).count() == 0
    assert foldwise.fold_correlations(spark, none).count() == 0
