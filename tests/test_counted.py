"""Equal rows are fitted once, with their number as the weight; tables are spread and kept once."""

import pytest
from pyspark.sql import functions as F

from tabfold.operators import counted, features, models
from tabfold.plans import catalog as C
from tabfold.plans import experiment as ex
from tabfold.sources import tables


@pytest.fixture(scope="module")
def prep(spark):
    """6000 rows of 60 kinds; one label in nine is another."""
    df = spark.range(6000).select(
        F.col("id").alias("k"), (F.col("id") % 12).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        F.when(F.col("id") % 9 == 0, 2).when(F.col("id") % 12 < 5, 1).otherwise(0).alias("label"))
    return ex.prepare(df, ["a", "b"], "label", ["k"])


@pytest.mark.parametrize("learner,params", [("tree", {}), ("ovr_gbt", {"max_iter": 2}),
                                            ("softmax", {"max_iter": 2})])
def test_fit_sees_equal_rows_once_and_scores_alike(prep, monkeypatch, learner, params):
    seen, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda s, rows: (seen.append(rows.count()), fit(s, rows))[1])

    def predictions(**kw):
        _, scored = ex.fit_and_score(prep, ex.learner_for(learner, **params), **kw)
        return sorted(map(tuple, scored.select("k", "prediction").collect()))
    assert predictions(count_equal=True) == predictions()
    assert seen[0] < 200 and seen[1] > 4000


def test_own_weights_are_multiplied(prep):
    balanced = ex.balanced(prep)

    def predictions(**kw):
        _, scored = ex.fit_and_score(balanced, ex.learner_for("tree", weightCol="weight"), **kw)
        return sorted(map(tuple, scored.select("k", "prediction").collect()))
    assert predictions(count_equal=True) == predictions()
    with counted.counted_rows(balanced.data, ["features", "label"], "weight") as rows:
        total = rows.agg(F.sum(counted.WEIGHT)).first()[0]
        assert rows.rdd.getNumPartitions() == 1
    assert total == pytest.approx(balanced.data.agg(F.sum("weight")).first()[0])


def test_only_learners_of_summed_weights_and_rows_that_repeat(spark, prep):
    for name, params in (("logistic", {}), ("lasso", {}), ("tree", {"minInstancesPerNode": 2}),
                         ("gbt", {"subsamplingRate": 0.5}), ("ovr_gbt", {"subsamplingRate": 0.5}),
                         ("softmax", {"minInstancesPerNode": 2})):
        assert not counted.counts_rows(ex.learner_for(name, **params))
    assert prep.rows_repeat()
    assert not counted.rows_repeat(spark.range(1000), ["id"])
    assert not counted.rows_repeat(spark.range(0), ["id"])


@pytest.mark.parametrize("variant,per_fold", [("raw", False), ("scaled", False), ("standardised", True)])
def test_cross_validation_of_counted_variants(prep, monkeypatch, variant, per_fold):
    seen, merged = [], counted.merged
    monkeypatch.setattr(counted, "merged", lambda df, *a: (seen.append(df.count()), merged(df, *a))[1])

    def scores(**kw):
        cv = ex.cross_validate(prep, "tree", 3, 1, keys=["k"], variant=variant, fit_per_fold=per_fold, **kw)
        return sorted((r["fold"], r["n_rows"], round(r["balanced_accuracy"], 12)) for r in cv.collect())
    assert scores(collapse=None) == scores()
    assert len(seen) == 1 and seen[0] < 600


@pytest.mark.parametrize("with_mean", [False, True])
def test_counted_scaler_is_that_of_the_rows(spark, with_mean):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense(1.0, 7.0, 1e6), 3.0), (Vectors.dense(2.0, 7.0, 1e6 + 1), 1.0),
            (Vectors.dense(0.0, 7.0, 1e6 + 5), 5.0)]
    df = spark.createDataFrame(rows, ["features", "n"])
    whole = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    want = features.fit_scaler(whole, with_mean=with_mean).transform(df)
    got = features.CountedScaler(with_mean=with_mean, count_col="n").fit(df).transform(df)

    def values(x):
        return [v for r in x.select(vector_to_array("normFeatures")).collect() for v in r[0]]
    assert values(got) == pytest.approx(values(want), rel=1e-9)
    one = features.CountedScaler(count_col="n").fit(df.limit(1).withColumn("n", F.lit(1.0)))
    assert one.std == [0.0, 0.0, 0.0]


def test_many_counted_rows_are_spread(spark, monkeypatch):
    """More distinct rows than the aggregation's partitions should hold."""
    rows = spark.range(4000).select((F.col("id") % 1000).alias("x"), F.lit(0).alias("y"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr(counted.merged, "__defaults__", (100,))
    try:
        with counted.counted_rows(rows, ["x", "y"]) as kept:
            sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
            assert kept.agg(F.sum(counted.WEIGHT)).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(sizes) == 1000 and max(sizes) <= 120


def test_parts_of_a_spread_scan_stay_small(spark, tmp_dir, monkeypatch):
    spark.range(200_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(f"{tmp_dir}/t.parquet")
    monkeypatch.setattr(tables, "PART_BYTES", 50_000)
    n = tables.read_table(spark, tmp_dir, "t", spread=True).rdd.getNumPartitions()
    assert n > spark.sparkContext.defaultParallelism and n > 20


def test_parts_of_a_large_scan_stay_small(spark, tmp_dir, monkeypatch):
    """More than a split per core, all in one row group: one task would keep every row."""
    spark.range(200_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(f"{tmp_dir}/t.parquet")
    monkeypatch.setattr(tables, "PART_BYTES", 50_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = tables.read_table(spark, tmp_dir, "t", spread=True)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 200_000 and max(sizes) < 10_000


def test_parts_of_a_well_compressed_scan_stay_small(spark, tmp_dir, monkeypatch):
    spark.range(200_000).select(F.lit(7).alias("x")).coalesce(1).write.parquet(f"{tmp_dir}/t.parquet")
    monkeypatch.setattr(tables, "PART_ROWS", 4_000)
    df = tables.read_table(spark, tmp_dir, "t", spread=True)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 5_000


def test_profile_rounds_read_kept_rows(spark, monkeypatch):
    plans, made = [], C.profile.feature_profile

    def watched(long, **kw):
        plans.append(long._jdf.queryExecution().toString())
        return made(long, **kw)
    monkeypatch.setattr(C.profile, "feature_profile", watched)
    assert C.q_feature_profile_bracketed(spark, "/root/testdata/sf0.001").count() == len(C.PROFILE_COLS)
    assert "InMemoryRelation" in plans[0]


def test_variants_share_the_folds_of_a_repeat(prep, monkeypatch):
    ranked, folds = [], ex.sampling.stratified_folds
    monkeypatch.setattr(ex.sampling, "stratified_folds",
                        lambda *a, **kw: (ranked.append(kw["repeat_ids"]), folds(*a, **kw))[1])
    variants = [("scaled", False), ("standardised", True)]
    for collapse in (None, False):
        got = ex.cross_validate_variants(prep, variants, "tree", 3, 2, keys=["k"], collapse=collapse)
        got = sorted(map(tuple, got.collect()))
        assert ranked == [[0], [1]]
        want = sorted((v, alone, *r) for v, alone in variants for r in ex.cross_validate(
            prep, "tree", 3, 2, keys=["k"], variant=v, fit_per_fold=alone, collapse=collapse).collect())
        assert got == want and len(got) == 12
        ranked.clear()


def test_counted_folds_are_fitted_without_their_lineage(prep, monkeypatch):
    plans, fit = [], models.fit

    def watched(stages, rows):
        plans.append(rows._jdf.queryExecution().toString())
        return fit(stages, rows)
    monkeypatch.setattr(models, "fit", watched)
    ex.cross_validate(prep, "tree", 3, 2, keys=["k"], collapse=True)
    assert len(plans) == 6
    assert all("Scan ExistingRDD" in p and "Aggregate" not in p and "Window" not in p for p in plans)


def test_boosted_fit_has_no_more_partitions_than_its_rows_need(spark, prep, monkeypatch):
    cores, seen, fit = spark.sparkContext.defaultParallelism, [], models.fit
    monkeypatch.setattr(models, "fit", lambda s, rows: (seen.append(rows.rdd.getNumPartitions()), fit(s, rows))[1])
    wide = prep.data.repartition(3 * cores)

    def predictions(data, name="ovr_gbt"):
        params = {"max_iter": 2} if name == "ovr_gbt" else {}
        _, scored = ex.fit_and_score(prep, ex.learner_for(name, **params), data)
        return sorted(map(tuple, scored.select("k", "prediction").collect()))
    assert predictions(wide) == predictions(prep.data)
    assert seen[0] <= cores
    monkeypatch.setattr(counted, "PARTITION_VALUES", 2 * 4000 // (2 * cores))
    predictions(wide)
    assert cores < seen[2] <= 3 * cores
    predictions(wide, "tree")
    assert seen[3] == 3 * cores


@pytest.fixture(scope="module")
def kinds(prep):
    """The rows of ``prep`` with their columns."""
    return prep.data.select("k", "label", (F.col("k") % 12).cast("double").alias("a"),
                            (F.col("k") % 5).cast("double").alias("b"))


def _runs(sweep):
    return sorted((r["seed"], r["metric"], r["value"]) for r in sweep.collect())


def _runs_on_rows(prep, name, seeds, **params):
    """Each seed fitted and scored on the rows as they are."""
    out = []
    for seed in seeds:
        data = ex.sampling.hash_split(prep.data.drop("split"), ["k"], seed)
        _, scored = ex.fit_and_score(prep, ex.learner_for(name, **params), data)
        for r in ex.evaluate.accuracy(scored).collect():
            out += [(seed, f"{r['split']}_accuracy", r["accuracy"]),
                    (seed, f"{r['split']}_rows", float(r["n_rows"]))]
    return sorted(out)


@pytest.mark.parametrize("name,params", [("tree", {}), ("logistic", {}), ("lasso", {"reg_param": 0.05}),
                                         ("logistic", {"reg_param": 0.02, "elastic_net": 0.4})])
def test_sweep_fits_and_scores_equal_rows_once(prep, kinds, monkeypatch, name, params):
    want = _runs_on_rows(prep, name, (1, 2), **params)
    seen, fit, predict = [], models.fit, models.predict
    monkeypatch.setattr(models, "fit", lambda s, rows: (seen.append(rows.count()), fit(s, rows))[1])
    monkeypatch.setattr(models, "predict", lambda m, df: (seen.append(df.count()), predict(m, df))[1])
    assert _runs(ex.seed_sweep(kinds, ["a", "b"], "label", ["k"], name, (1, 2), **params)) == want
    assert len(seen) == 4 and max(seen) < 400


def test_sweeps_share_one_table(kinds, monkeypatch):
    names, split, indexed = ["tree", "lasso"], [], []
    want = {n: _runs(ex.seed_sweep(kinds, ["a", "b"], "label", ["k"], n, (1, 2))) for n in names}
    hash_split, fit_label_index = ex.sampling.hash_split, features.fit_label_index
    monkeypatch.setattr(ex.sampling, "hash_split",
                        lambda df, k, seed, *a, **kw: (split.append(seed), hash_split(df, k, seed, *a, **kw))[1])
    monkeypatch.setattr(features, "fit_label_index",
                        lambda *a, **kw: (indexed.append(a), fit_label_index(*a, **kw))[1])
    got = {n: _runs(s) for n, s in ex.seed_sweeps(kinds, ["a", "b"], "label", ["k"], names, (1, 2))}
    assert got == want
    assert split == [1, 2] and len(indexed) == 1


def _lineitem(spark, tmp_dir):
    (spark.range(400).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 3 / 100).alias("l_discount"), (F.col("id") % 2 / 100).alias("l_tax"))
     .write.parquet(f"{tmp_dir}/lineitem.parquet"))


def test_whole_sweep_prepares_its_rows_once(spark, tmp_dir, monkeypatch):
    _lineitem(spark, tmp_dir)
    indexed, fitted, fit_label_index, fit = [], [], features.fit_label_index, models.fit
    monkeypatch.setattr(features, "fit_label_index",
                        lambda *a, **kw: (indexed.append(a), fit_label_index(*a, **kw))[1])
    monkeypatch.setattr(models, "fit", lambda s, rows: (fitted.append(s), fit(s, rows))[1])
    rows = C.q_seed_summary_all(spark, tmp_dir).collect()
    assert len(rows) == 12 and all(r["n_runs"] == len(C.SWEEP) for r in rows)
    assert len(indexed) == 1 and len(fitted) == len(C.SWEEP) * len(C.SWEEP_LEARNERS)


def test_whole_sweep_is_that_of_the_rows(spark, tmp_dir, monkeypatch):
    _lineitem(spark, tmp_dir)
    monkeypatch.setattr(C, "SWEEP", (1, 2))
    li = spark.read.parquet(f"{tmp_dir}/lineitem.parquet").withColumn("label", F.expr(C._noisy(C.RULE_LINEAR)))
    base, want = ex.prepare(li, C.LI_FEATURES, "label", C.LI_KEYS), []
    for name in C.SWEEP_LEARNERS:
        for seed in C.SWEEP:
            data = ex.sampling.hash_split(base.data.drop("split"), C.LI_KEYS, seed)
            _, scored = ex.fit_and_score(base, ex.learner_for(name), data)
            for r in ex.evaluate.accuracy(scored).collect():
                want += [(name, seed, f"{r['split']}_accuracy", round(r["accuracy"], 8)),
                         (name, seed, f"{r['split']}_rows", float(r["n_rows"]))]
    seen, fit = [], models.fit
    monkeypatch.setattr(models, "fit", lambda s, rows: (seen.append(rows.count()), fit(s, rows))[1])
    got = C.q_seed_sweep_all(spark, tmp_dir).collect()
    assert sorted((r["model"], r["seed"], r["metric"], round(r["value"], 8)) for r in got) == sorted(want)
    assert len(seen) == 6 and max(seen) <= 84


@pytest.mark.parametrize("kinds_of", [5, 400])
def test_sweep_of_rows_without_a_feature_fails(spark, kinds_of):
    rows = spark.range(400).select(
        F.col("id").alias("k"), (F.col("id") % 2).alias("label"),
        F.when(F.col("id") > 0, F.col("id") % kinds_of).cast("double").alias("a"))
    with pytest.raises(Exception, match="handleInvalid|VectorAssembler"):
        ex.seed_sweep(rows, ["a"], "label", ["k"], "logistic", (1,))


def test_sweep_of_rows_that_differ_or_have_weights(spark, prep, kinds):
    some = spark.range(600).select(
        F.col("id").alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") % 5 + 1).alias("b"),
        F.when(F.col("id") % 9 == 0, 1 - (F.col("id") > 300).cast("int"))
        .otherwise((F.col("id") > 300).cast("int")).alias("label"))
    alone = ex.prepare(some, ["a", "b"], "label", ["k"])
    assert not alone.rows_repeat()
    for name in ("tree", "logistic"):
        assert _runs(ex.seed_sweep(some, ["a", "b"], "label", ["k"], name, (1,))) == _runs_on_rows(
            alone, name, (1,))
    for name in ("tree", "lasso"):
        assert _runs(ex.seed_sweep(kinds, ["a", "b"], "label", ["k"], name, (1,), weightCol="k")) == (
            _runs_on_rows(prep, name, (1,), weightCol="k"))


@pytest.mark.parametrize("reg,net,scaled", [(0.1, 1.0, True), (0.2, 0.0, True), (0.05, 0.3, True),
                                            (0.05, 0.3, False), (0.0, 0.0, True)])
def test_linear_fit_on_counted_rows_has_the_penalty_of_the_rows(spark, reg, net, scaled):
    """Few kinds of very uneven numbers: weighted deviations are far from the rows'."""
    rows = features.assemble(spark.range(900).select(
        F.when(F.col("id") < 700, 0.0).when(F.col("id") < 850, 1.0).otherwise(9.0).alias("a"),
        (F.col("id") % 2 * 1000).cast("double").alias("b"),
        (F.col("id") % 5 < F.when(F.col("id") < 700, 1).otherwise(3)).cast("double").alias("indexedLabel")),
        ["a", "b"])
    learner = ex.learner_for("logistic", reg_param=reg, elastic_net=net, standardization=scaled, tol=1e-10,
                             maxIter=500)
    want = learner.fit(rows)
    with counted.counted_rows(rows, ["features", "indexedLabel"]) as few:
        assert few.count() == 12
        got = counted.weighted(learner, few).fit(few)
    assert list(got.coefficients) == pytest.approx(list(want.coefficients), rel=1e-4, abs=1e-9)
    assert got.intercept == pytest.approx(want.intercept, rel=1e-4)
    with counted.counted_rows(rows.limit(1), ["features", "indexedLabel"]) as one:
        assert counted.same_penalty(learner, one) == {}
