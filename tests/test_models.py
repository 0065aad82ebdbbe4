"""Learners on planted labels (P), the label-column trap, summaries,
persistence and importances (M1-M8, S10, E4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfold.operators import evaluate, importance, models
from tabfold.plans import catalog as C
from tabfold.plans import experiment as ex
from tabfold.sources import sinks
from conftest import SF0001


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF0001}/lineitem.parquet")


def _prep(lineitem, rule, seed=23):
    return ex.prepare(lineitem.withColumn("label", F.expr(rule)), C.LI_FEATURES, "label", C.LI_KEYS, seed)


def _all_correct(scored):
    acc = {r["split"]: r["accuracy"] for r in evaluate.accuracy(scored).collect()}
    assert acc == {"train": 1.0, "test": 1.0}


@pytest.mark.parametrize("name,rule,params", [
    ("tree", C.RULE_TREE, {}),
    ("logistic", C.RULE_LINEAR, {}),
    ("lasso", C.RULE_LINEAR, {}),
    ("gbt", C.RULE_TREE, {"max_iter": 3}),
    ("ovr_gbt", C.RULE_BANDS, {"max_iter": 3}),
])
def test_planted_exact(lineitem, name, rule, params):
    prep = _prep(lineitem, rule)
    _, scored = ex.fit_and_score(prep, ex.learner_for(name, **params))
    _all_correct(scored)


def test_tree_other_seeds(lineitem):
    for seed in (1, 42):
        prep = _prep(lineitem, C.RULE_TREE, seed)
        _all_correct(ex.fit_and_score(prep, ex.learner_for("tree"))[1])


def test_majority_class_one_not_inverted(spark):
    """Trap 2.11-1: train and evaluate on the same label column. With class 1
    the majority, the index of class 1 is 0; a perfect model must score 1."""
    rows = [(i, float(i % 4 != 0), float(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, y double").withColumn("label", F.col("y").cast("int"))
    prep = ex.prepare(df, ["x"], "label", ["k"], seed=1)
    assert prep.label_model.labels[0] == "1"
    _, scored = ex.fit_and_score(prep, ex.learner_for("logistic"))
    _all_correct(scored)


def test_model_summary_and_reload(spark, lineitem, tmp_dir):
    prep = _prep(lineitem, C.RULE_TREE)
    model, scored = ex.fit_and_score(prep, ex.learner_for("tree"))
    s = models.model_summary(spark, model, "tree").first()
    assert s.num_trees == 1 and s.depth <= 5 and s.num_features == 3
    sinks.save_model(model, f"{tmp_dir}/m")
    again = sinks.load_model(f"{tmp_dir}/m").transform(prep.data)
    cols = [*C.LI_KEYS, "prediction"]
    assert again.select(*cols).exceptAll(scored.select(*cols)).count() == 0


def test_importances_sum_to_one_and_planted_first(spark, lineitem):
    prep = _prep(lineitem, C.RULE_TREE)
    model, _ = ex.fit_and_score(prep, ex.learner_for("gbt", max_iter=3))
    names = importance.slot_names(prep.data, "features")
    assert names == list(C.LI_FEATURES)
    imp = importance.importances(spark, model, names)
    vals = {r.feature: r.importance for r in imp.collect()}
    assert abs(sum(vals.values()) - 1.0) < 1e-9
    assert vals["l_tax"] < min(vals["l_linenumber"], vals["l_discount"])
    top = importance.top_k(imp, 2).collect()
    assert {r.feature for r in top} == {"l_linenumber", "l_discount"}


def test_ovr_importances_averaged(spark, lineitem):
    prep = _prep(lineitem, C.RULE_BANDS)
    model, _ = ex.fit_and_score(prep, ex.learner_for("ovr_gbt", max_iter=2))
    imp = importance.importances(spark, model, list(C.LI_FEATURES)).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9
    assert max(imp, key=lambda r: r.importance).feature == "l_linenumber"


def test_family_summary(spark):
    imp = spark.createDataFrame([("chroma_mean_01", 0.5), ("chroma_std_01", 0.2), ("mfcc_mean_01", 0.3)],
                                "feature string, importance double")
    rows = {r.category: (round(r.total, 9), round(r["mean"], 9), r.n_features)
            for r in importance.family_summary(imp).collect()}
    assert rows == {"chroma": (0.7, 0.35, 2), "mfcc": (0.3, 0.3, 1)}


def test_variant_compare_exact(lineitem):
    prep = _prep(lineitem, C.RULE_TREE)
    out = ex.variant_compare(prep, ("raw", "scaled", "standardised"), "gbt", max_iter=3)
    assert out.filter("label <> prediction").count() == 0
    assert {r.variant for r in out.select("variant").distinct().collect()} == {"raw", "scaled", "standardised"}


@pytest.mark.parametrize("variant", ["pca", "scaled_pca"])
def test_pca_variants_high_accuracy(lineitem, variant):
    prep = _prep(lineitem, C.RULE_TREE)
    data, cat = ex.variant_data(prep, variant)
    _, scored = ex.fit_and_score(prep, ex.learner_for("gbt", max_iter=5), data, cat)
    acc = {r["split"]: r["accuracy"] for r in evaluate.accuracy(scored).collect()}
    assert acc["test"] >= 0.95


def test_cross_validate_small(lineitem):
    prep = _prep(lineitem, C.RULE_TREE)
    scores = ex.cross_validate(prep, "tree", n_folds=3, n_repeats=1, seed=1, keys=C.LI_KEYS).collect()
    assert len(scores) == 3 and all(r.balanced_accuracy == 1.0 for r in scores)
    n_train = prep.data.filter("split = 'train'").count()
    assert sum(r.n_rows for r in scores) == n_train


def test_seed_sweep_and_summary(lineitem):
    df = lineitem.withColumn("label", F.expr(C.RULE_TREE))
    sweep = ex.seed_sweep(df, C.LI_FEATURES, "label", C.LI_KEYS, "tree", (1, 2), with_time=True)
    metrics = {r.metric for r in sweep.collect()}
    assert {"train_accuracy", "test_accuracy", "train_rows", "test_rows", "run_minutes"} <= metrics
    summ = {r.metric: r for r in evaluate.seed_summary(sweep).collect()}
    assert summ["test_accuracy"]["min"] == 1.0 and summ["test_accuracy"].n_runs == 2


def test_job_report(spark, lineitem, tmp_dir):
    from tabfold.plans import jobs
    rep = jobs.run_job(spark, lineitem, f"{tmp_dir}/out", "tree", "5", C.LI_FEATURES, "label",
                       C.RULE_TREE, C.LI_KEYS, phases=True)
    vals = {r.ValueType: r.Value for r in rep.collect()}
    assert vals["Train accuracy"] == 1.0 and vals["Test accuracy"] == 1.0 and vals["Run time"] > 0
    parts = [vals[f"Run time: {p}"] for p in ("prepare", "fit", "evaluate")]
    assert all(p >= 0 for p in parts) and sum(parts) <= vals["Run time"] + 1e-9


def test_fit_on_train_keeps_unseen(spark, lineitem):
    """Indexers fitted on train rows only; unseen test values are kept, not fatal."""
    df = lineitem.withColumn("label", F.expr(C.RULE_TREE))
    prep = ex.prepare(df, C.LI_FEATURES, "label", C.LI_KEYS, 23, max_categories=10, fit_on="train")
    _, scored = ex.fit_and_score(prep, ex.learner_for("tree"))
    assert scored.count() == df.count()


def test_pca_components_orthonormal(spark):
    from pyspark.ml.functions import array_to_vector
    from tabfold.operators import reduce as red
    e = spark.read.parquet(f"{SF0001}/embeddings.parquet").select(array_to_vector("embedding").alias("f"))
    m = red.fit_pca(e, "f", "p", 10)
    pc = m.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(10), atol=1e-9)
    full = red.fit_pca(e, "f", "p", 500)           # k > d is clamped to d
    assert full.getK() == 64
    ev = red.explained_variance(spark, full, red.total_variance(e, "f")).orderBy("component").collect()
    assert abs(ev[-1].cumulative - 1.0) < 1e-9
    assert abs(sum(r.eigenvalue for r in ev) - red.total_variance(e, "f")) < 1e-9


@pytest.mark.parametrize("name", ["tree", "logistic", "gbt"])
def test_optional_weight_column(spark, lineitem, name):
    """No class weights by default; a weight column passes through to the learner."""
    df = lineitem.withColumn("label", F.expr(C.RULE_LINEAR if name == "logistic" else C.RULE_TREE))
    prep = ex.prepare(df, C.LI_FEATURES, "label", C.LI_KEYS, 23)
    weighted = prep.data.withColumn("w", F.when(F.col("label") == 1, 2.0).otherwise(1.0))
    params = {"max_iter": 2} if name == "gbt" else {}
    learner = ex.learner_for(name, weightCol="w", **params)
    assert learner.getOrDefault("weightCol") == "w"
    _, scored = ex.fit_and_score(prep, learner, data=weighted)
    _all_correct(scored)
