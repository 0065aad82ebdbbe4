"""Profile (A1-A4, A8), metrics (E1, E2, A9, A6, A7), covariance (F7),
scalers (F4-F6) - checked against DuckDB or by hand."""

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector, vector_to_array

from tabfold.operators import evaluate, features, profile
from tabfold.operators import reduce as red
from conftest import SF0001


def _quantiles_duck(values, probs):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    return [con.execute(f"SELECT quantile_cont(v, {p}) FROM t").fetchall()[0][0] for p in probs]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_exact_quantiles_property(spark, values):
    long = spark.createDataFrame([("a", float(v)) for v in values], "feature string, value double")
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    want = _quantiles_duck(values, probs)
    for kw in ({}, {"max_candidates": 2, "accuracy": 20}):
        got = {r.q: r.quantile for r in profile.exact_quantiles(long, probs, **kw).collect()}
        assert [round(got[i], 9) for i in range(len(probs))] == [round(w, 9) for w in want]


def test_skewed_feature_quantiles(spark):
    """One value holds a third of the rows: refinement stops, result exact."""
    vals = [7.0] * 3000 + [float(i) for i in range(6000)]
    long = spark.createDataFrame([("a", v) for v in vals], "feature string, value double")
    got = {r.q: r.quantile for r in profile.exact_quantiles(long, max_candidates=100, accuracy=200).collect()}
    want = _quantiles_duck(vals, (0.25, 0.5, 0.75))
    assert [round(got[i], 9) for i in range(3)] == [round(w, 9) for w in want]


def test_profile_paths_agree(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    cols = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    long = profile.long_format(li, cols)
    a = {r.feature: tuple(round(x, 9) for x in r[1:]) for r in profile.feature_profile(long).collect()}
    b = {r.feature: tuple(round(x, 9) for x in r[1:])
         for r in profile.feature_profile(long, max_candidates=20).collect()}
    assert a == b
    con = duckdb.connect()
    for c in cols:
        want = con.execute(f"SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) "
                           f"FROM read_parquet('{SF0001}/lineitem.parquet')").fetchone()[0]
        assert a[c][4:7] == tuple(round(x, 9) for x in want)
    approx = profile.feature_profile(long, approx=True).collect()
    assert len(approx) == 4


def test_feature_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (3.0, None, None)],
                               "x double, y double, z double")
    got = {r.feature: r for r in profile.feature_profile(
        profile.long_format(df, ["x", "y", "z"])).collect()}
    assert (got["x"]["count"], got["x"].p50) == (2, 2.0)
    for c in "yz":
        assert got[c]["count"] == 0 and got[c].p50 is None and got[c]["mean"] is None
    empty = profile.long_format(df.limit(0), ["x"])
    assert profile.feature_profile(empty).collect() == []


def test_low_spread_and_histograms(spark):
    df = spark.createDataFrame([(0.0, "a"), (0.0, "a"), (0.0, None), (0.0, None), (1.0, "b")],
                               "x double, c string")
    prof = profile.feature_profile(profile.long_format(df, ["x"]))
    assert [r.feature for r in profile.low_spread(prof).collect()] == ["x"]
    h = profile.class_histogram(df, "c").collect()
    assert [(r.c, r["count"]) for r in h] == [("a", 2), (None, 2), ("b", 1)]
    assert profile.class_histogram(df, "c", keep_null=False).count() == 2
    assert profile.row_count(df).first().n_rows == 5


def test_metrics_by_hand(spark):
    rows = [("s", 0, 0), ("s", 0, 1), ("s", 1, 1), ("s", 1, 1), ("s", 1, 1), ("s", 2, 0)]
    df = spark.createDataFrame(rows, "split string, label int, prediction int")
    acc = evaluate.accuracy(df, "label", "prediction").first()
    assert (acc.n_rows, acc.n_correct) == (6, 4)
    bal = evaluate.balanced_accuracy(df, "label", "prediction").first()
    assert bal.balanced_accuracy == pytest.approx((0.5 + 1.0 + 0.0) / 3)
    cm = {(r.label, r.prediction): (r.n, r.rate) for r in
          evaluate.confusion_matrix(df, "label", "prediction", by=["split"]).collect()}
    assert len(cm) == 9 and cm[(2, 2)] == (0, 0.0) and cm[(0, 1)] == (1, 0.5)


def test_fold_and_seed_summaries(spark):
    df = spark.createDataFrame([("m", "acc", 0.5), ("m", "acc", 1.0)], "model string, metric string, value double")
    s = evaluate.seed_summary(df).first()
    assert (s["min"], s["max"], s["mean"], s.n_runs) == (0.5, 1.0, 0.75, 2)
    assert s["std"] == pytest.approx(np.std([0.5, 1.0], ddof=1))
    f = evaluate.fold_summary(df, "value").first()
    assert f["std"] == pytest.approx(np.std([0.5, 1.0]))     # population, numpy's default


def test_covariance_matches_numpy(spark):
    e = spark.read.parquet(f"{SF0001}/embeddings.parquet")
    x = np.array([r.embedding for r in e.collect()], dtype=float)
    cov = {(r.i, r.j): r.cov for r in red.covariance(e.repartition(3), "embedding").collect()}
    want = np.cov(x, rowvar=False)
    assert max(abs(cov[(i, j)] - want[i, j]) for i in range(64) for j in range(64)) < 1e-12


def test_scalers(spark):
    e = spark.read.parquet(f"{SF0001}/embeddings.parquet").select(array_to_vector("embedding").alias("features"))
    x = np.array([r.features.toArray() for r in e.collect()])
    for kind, want in (("unit", x / x.std(0, ddof=1)), ("std", (x - x.mean(0)) / x.std(0, ddof=1)),
                       ("pop", (x - x.mean(0)) / x.std(0))):
        if kind == "pop":
            m = features.PopulationScaler().fit(e)
        else:
            m = features.fit_scaler(e, with_mean=(kind == "std"))
        got = np.array([r[0] for r in m.transform(e).select(vector_to_array("normFeatures")).collect()])
        assert np.allclose(got, want, atol=1e-9), kind


def test_category_index_zero_first(spark):
    df = spark.createDataFrame([(3.0,), (-1.0,), (0.0,), (3.0,)], "v double")
    d = features.assemble(df, ["v"])
    m = features.fit_category_index(d, max_categories=4)
    assert m.categoryMaps == {0: {0.0: 0, -1.0: 1, 3.0: 2}}


def test_label_index_ties_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "label string")
    assert features.fit_label_index(df).labels == ["c", "a", "b"]
