"""The README quick start runs end to end (bzip2 wrangled table written from
lineitem as a stand-in, small rounds for speed)."""

from pyspark.sql import functions as F

from tabfold.operators import evaluate, profile
from tabfold.plans import experiment as ex
from tabfold.sources import delimited, sinks
from conftest import SF0001


def test_readme_quick_start(spark, tmp_dir):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    rule = (F.col("l_linenumber") > 3) & (F.col("l_discount") < 0.055)
    wide = li.select(F.col("l_discount").alias("a.b.1"), F.col("l_tax").alias("a.c.2"),
                     F.col("l_linenumber").cast("double").alias("a.d.3"),
                     F.when(rule, "Rock").otherwise("Experimental").alias("Genre"))
    sinks.write_table(wide, f"{tmp_dir}/mfa_wrangled.bz2", "csv", compression="bzip2", header=True)
    data = delimited.safe_names(delimited.read_with_header(spark, f"{tmp_dir}/mfa_wrangled.bz2",
                                                           infer=True))
    data = data.filter(data.Genre.isin("Rock", "Experimental"))
    data = data.withColumn("label", (data.Genre == "Rock").cast("int")).drop("Genre")
    feats = [c for c in data.columns if c != "label"]
    assert feats == ["a_b_1", "a_c_2", "a_d_3"]
    prep = ex.prepare(data, feats, "label", keys=feats, seed=23)
    compare = ex.variant_compare(prep, ("raw", "scaled"), learner="gbt", max_iter=3)
    assert compare.filter("label <> prediction").count() == 0
    prof = profile.feature_profile(profile.long_format(data, feats))
    assert prof.count() == 3
    cv = ex.cross_validate(prep, "ovr_gbt", n_folds=3, n_repeats=1, seed=1, keys=feats, max_iter=2)
    assert cv.count() == 3
    _, scored = ex.fit_and_score(prep, ex.learner_for("gbt", max_iter=3))
    assert {r.balanced_accuracy for r in evaluate.balanced_accuracy(scored).collect()} == {1.0}
