"""Registered queries and their DuckDB oracles.

Each query takes ``(spark, data_dir)`` and returns a DataFrame over whole
tables. Oracles are SQL over the same parquet tables; computed doubles are
rounded to ``DIGITS`` on both sides. Model queries use *planted* labels -
a rule over low-cardinality columns that the learner recovers exactly - so
the oracle is the rule itself (predictions == labels on every row).
Queries without an exact oracle (random split, PCA spectrum and variant,
model summaries, importances) are rows-only.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfold.operators import (
    evaluate, features, importance, models, profile, reduce as red, sampling, wrangle,
)
from tabfold.plans import experiment as ex
from tabfold.plans import fixtures, jobs
from tabfold.session import scratch_path
from tabfold.sources import delimited, sinks
from tabfold.sources.local import small_table
from tabfold.sources.tables import read_table

DIGITS = 9

# ---------------------------------------------------------------- constants
LI_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LI_FEATURES = ("l_discount", "l_tax", "l_linenumber")
SEED = 23
# planted labels (SQL, valid in Spark and DuckDB)
RULE_TREE = "CAST(CASE WHEN l_linenumber > 3 AND l_discount < 0.055 THEN 1 ELSE 0 END AS INTEGER)"
RULE_LINEAR = "CAST(CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS INTEGER)"
RULE_BANDS = ("CAST(CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 5 THEN 1 "
              "ELSE 2 END AS INTEGER)")
# a fixed rule "prediction" of l_returnflag, for the metric queries
RULE_PRED = "CASE WHEN l_discount < 0.04 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END"
PROFILE_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax")


def _t(spark, d, name, spread=False):
    return read_table(spark, d, name, spread=spread)


def _sql_split(keys, seed, frac: float = 0.7) -> str:
    """SQL twin of ``sampling.hash_split``; ``seed`` is an int (a literal) or
    the name of a seed column."""
    k = ", ".join(keys)
    s = f"'{seed}'" if isinstance(seed, int) else seed
    return (f"(CASE WHEN ('0x' || substr(md5(concat_ws(':', {k}, {s})), 1, 8))::UBIGINT"
            f" < {frac} * 4294967296 THEN 'train' ELSE 'test' END)")


# Computed doubles are compared at 9 significant digits (absolute 1e-9 below
# 1): k = min(9, 8 - floor(log10|x|)) decimals, applied as round(x * 10^k) /
# 10^k (or round(x / 10^-k) * 10^-k for k < 0). Powers of ten are exact
# doubles, so Spark and DuckDB perform the same IEEE operations; a mean near
# 5e4 keeps 9 digits, not 14 - below the summation-order noise of engines.


def _sig_k(x, digits=DIGITS):
    return F.least(F.lit(digits), F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))).cast("int")


def _sig_apply(x, k, p):
    scaled = F.when(k >= 0, F.round(x * p, 0) / p).otherwise(F.round(x / p, 0) * p)
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).otherwise(scaled)


def _r(c, digits=DIGITS):
    x = F.col(c) if isinstance(c, str) else c
    k = _sig_k(x, digits)
    return _sig_apply(x, k, F.pow(F.lit(10.0), F.abs(k)))


def _sql_sig(x: str, digits: int = DIGITS) -> str:
    k = f"least({digits}, {digits - 1} - floor(log10(abs({x}))))"
    p = f"power(10.0, abs({k}))"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 THEN {x} "
            f"WHEN {k} >= 0 THEN round({x} * {p}, 0) / {p} "
            f"ELSE round({x} / {p}, 0) * {p} END)")


# ------------------------------------------------------------ planted models

def _planted_prep(spark, d, rule, seed=SEED):
    li = _t(spark, d, "lineitem", spread=True)
    df = li.withColumn("label", F.expr(rule))
    return ex.prepare(df, LI_FEATURES, "label", LI_KEYS, seed=seed)


def _planted(rule, learner, **params):
    def q(spark, d):
        prep = _planted_prep(spark, d, rule)
        _, scored = ex.fit_and_score(prep, ex.learner_for(learner, **params), count_equal=True)
        return ex.confusion_counts(scored, "label")
    return q


def _sql_planted(rule, seed=SEED):
    return (f"SELECT split, label, label AS prediction, count(*) AS n_rows FROM ("
            f"SELECT {_sql_split(LI_KEYS, seed)} AS split, {rule} AS label FROM lineitem) t "
            f"GROUP BY split, label")


def q_model_reload_predict(spark, d):
    prep = _planted_prep(spark, d, RULE_TREE)
    model, _ = ex.fit_and_score(prep, ex.learner_for("tree"))
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    loaded = sinks.load_model(path)
    scored = features.label_names(prep.label_model).transform(models.predict(loaded, prep.data))
    return ex.confusion_counts(scored, "label")


def q_tree_job(spark, d):
    out = scratch_path(spark, "report")
    li = _t(spark, d, "lineitem")
    jobs.run_job(spark, li, out, "tree", SEED, LI_FEATURES, "label", RULE_TREE, LI_KEYS)
    schema = T.StructType([T.StructField("ValueType", T.StringType()),
                           T.StructField("Value", T.DoubleType())])
    back = spark.read.schema(schema).csv(out)
    return back.filter(F.col("ValueType") != "Run time").select("model", "seed", "ValueType",
                                                                 _r("Value").alias("Value"))


SQL_TREE_JOB = (f"SELECT 'tree' AS model, CAST({SEED} AS INTEGER) AS seed, "
                f"CASE split WHEN 'train' THEN 'Train accuracy' ELSE 'Test accuracy' END AS ValueType, "
                f"round(avg(CASE WHEN label = label THEN 1.0 ELSE 0.0 END), {DIGITS})::DOUBLE AS Value "
                f"FROM (SELECT {_sql_split(LI_KEYS, SEED)} AS split, {RULE_TREE} AS label "
                f"FROM lineitem) t GROUP BY split")


def q_variant_compare(spark, d):
    prep = _planted_prep(spark, d, RULE_TREE)
    return ex.variant_compare(prep, ("raw", "scaled", "standardised"), "gbt")


SQL_VARIANT_COMPARE = " UNION ALL ".join(
    f"SELECT '{v}' AS variant, * FROM ({_sql_planted(RULE_TREE)})"
    for v in ("raw", "scaled", "standardised"))


def q_variant_pca(spark, d):
    """PCA variants (centred as the notebook, uncentred as the Spark job):
    the planted rule becomes oblique after rotation, so accuracy is high but
    not exact - rows-only."""
    prep = _planted_prep(spark, d, RULE_TREE)
    out = None
    for v in ("pca", "scaled_pca"):
        data, cat = ex.variant_data(prep, v)
        _, scored = ex.fit_and_score(prep, ex.learner_for("gbt"), data, cat, count_equal=True)
        part = evaluate.accuracy(scored).withColumn("variant", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


SWEEP = ex.SWEEP_SEEDS


def _sweep(spark, d):
    li = _t(spark, d, "lineitem", spread=True).withColumn("label", F.expr(RULE_TREE))
    return ex.seed_sweep(li, LI_FEATURES, "label", LI_KEYS, "tree", SWEEP, parallelism=4)


def q_seed_sweep(spark, d):
    return _sweep(spark, d)


def q_seed_summary(spark, d):
    s = evaluate.seed_summary(_sweep(spark, d))
    return s.withColumn("mean", _r("mean")).withColumn("std", _r("std"))


_SWEEP_BASE = (f"WITH s AS (SELECT v.seed, {_sql_split(LI_KEYS, 'v.seed')} AS split "
               f"FROM lineitem, (VALUES {', '.join(f'({x})' for x in SWEEP)}) v(seed)), "
               f"r AS (SELECT 'tree' AS model, CAST(seed AS INTEGER) AS seed, split || '_rows' AS metric, "
               f"CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY seed, split "
               f"UNION ALL SELECT 'tree', CAST(seed AS INTEGER), split || '_accuracy', 1.0::DOUBLE "
               f"FROM s GROUP BY seed, split) ")
SQL_SEED_SWEEP = _SWEEP_BASE + "SELECT * FROM r"
SQL_SEED_SUMMARY = (_SWEEP_BASE + f"SELECT model, metric, min(value) AS min, max(value) AS max, "
                    f"round(avg(value), {DIGITS}) AS mean, round(stddev_samp(value), {DIGITS}) AS std, "
                    f"count(*) AS n_runs FROM r GROUP BY model, metric")


def _cv(spark, d):
    prep = _planted_prep(spark, d, RULE_TREE)
    return ex.cross_validate(prep, "tree", 10, 3, seed=1, keys=LI_KEYS, parallelism=4,
                             collapse=None)


def q_cv_scores(spark, d):
    return _cv(spark, d).withColumn("balanced_accuracy", _r("balanced_accuracy"))


def q_cv_summary(spark, d):
    scores = _cv(spark, d)
    long = scores.select(
        F.explode(F.array(
            F.struct(F.lit("balanced_accuracy").alias("metric"),
                     F.col("balanced_accuracy").alias("value")),
            F.struct(F.lit("n_rows").alias("metric"), F.col("n_rows").cast("double").alias("value")),
        )).alias("m")).select("m.*")
    s = evaluate.fold_summary(long, "value", ["metric"])
    return s.withColumn("mean", _r("mean")).withColumn("std", _r("std"))


_CV_BASE = (f"WITH t AS (SELECT {', '.join(LI_KEYS)}, {RULE_TREE} AS label FROM lineitem "
            f"WHERE {_sql_split(LI_KEYS, SEED)} = 'train'), "
            f"f AS (SELECT CAST(r.rep AS INTEGER) AS repeat, CAST((row_number() OVER ("
            f"PARTITION BY label, r.rep ORDER BY md5(concat_ws(':', {', '.join(LI_KEYS)}, '1', r.rep)), "
            f"{', '.join(LI_KEYS)}) - 1) % 10 AS INTEGER) AS fold FROM t, range(3) r(rep)), "
            f"c AS (SELECT repeat, fold, count(*) AS n_rows, 1.0::DOUBLE AS balanced_accuracy "
            f"FROM f GROUP BY repeat, fold) ")
SQL_CV_SCORES = _CV_BASE + "SELECT * FROM c"
SQL_CV_SUMMARY = (_CV_BASE + f"SELECT 'balanced_accuracy' AS metric, round(avg(balanced_accuracy), {DIGITS}) AS mean, "
                  f"round(stddev_pop(balanced_accuracy), {DIGITS}) AS std, count(*) AS n FROM c "
                  f"UNION ALL SELECT 'n_rows', round(avg(n_rows), {DIGITS}), "
                  f"round(stddev_pop(n_rows), {DIGITS}), count(*) FROM c")


# bands with the next band's label for one key in eight
_FLIPPED = (f"substr(md5(concat_ws(':', {', '.join(f'CAST({k} AS STRING)' for k in LI_KEYS)}, "
            f"'noise')), 1, 1) < '2'")
NOISY_BANDS = f"CAST(CASE WHEN {_FLIPPED} THEN ({RULE_BANDS} + 1) % 3 ELSE {RULE_BANDS} END AS INTEGER)"
# variant, and whether its scaler is fitted without the held-out fold
CV_VARIANTS = (("scaled", False), ("standardised", True))


def _cv_bands(spark, d, run, **params):
    prep = _planted_prep(spark, d, NOISY_BANDS)
    try:
        cv = run(prep, n_folds=10, n_repeats=3, seed=1, keys=LI_KEYS, parallelism=10, **params)
    finally:
        prep.data.unpersist()
    return cv.withColumn("balanced_accuracy", _r("balanced_accuracy"))


def q_cv_ovr_gbt(spark, d):
    """E3 with the 3-class booster: 3 x 10 folds, 20 rounds, noisy bands."""
    # few distinct feature values: equal rows are counted; 20 rounds need no checkpoint
    return _cv_bands(spark, d, ex.cross_validate, learner="ovr_gbt", collapse=True,
                     checkpointInterval=-1)


def q_cv_variants(spark, d):
    """E3 on preprocessing variants: scaler fitted once, and without the held-out fold."""
    return _cv_bands(spark, d, ex.cross_validate_variants, variants=CV_VARIANTS, learner="tree",
                     collapse=None)


def _sql_cv_bands():
    """What a learner that sees through the noise scores: the clean rule, per held-out fold."""
    return (f"WITH t AS (SELECT {', '.join(LI_KEYS)}, {NOISY_BANDS} AS label, {RULE_BANDS} AS rule "
            f"FROM lineitem WHERE {_sql_split(LI_KEYS, SEED)} = 'train'), "
            f"f AS (SELECT rule, label, CAST(r.rep AS INTEGER) AS repeat, CAST((row_number() OVER ("
            f"PARTITION BY label, r.rep ORDER BY md5(concat_ws(':', {', '.join(LI_KEYS)}, '1', r.rep)), "
            f"{', '.join(LI_KEYS)}) - 1) % 10 AS INTEGER) AS fold FROM t, range(3) r(rep)), "
            f"c AS (SELECT repeat, fold, label, count(*) AS n, "
            f"sum(CASE WHEN label = rule THEN 1 ELSE 0 END) / count(*) AS recall "
            f"FROM f GROUP BY repeat, fold, label) "
            f"SELECT repeat, fold, CAST(sum(n) AS BIGINT) AS n_rows, "
            f"{_sql_sig('avg(recall)')} AS balanced_accuracy FROM c GROUP BY repeat, fold")


SQL_CV_VARIANTS = " UNION ALL ".join(
    f"SELECT '{v}' AS variant, {str(alone).lower()} AS fit_per_fold, * FROM ({_sql_cv_bands()})"
    for v, alone in CV_VARIANTS)


def q_model_summary(spark, d):
    """M8: what printing the fitted tree and boosted models shows, as rows."""
    prep = _planted_prep(spark, d, RULE_TREE)
    out = None
    for name in ("tree", "gbt"):
        model, _ = ex.fit_and_score(prep, ex.learner_for(name), count_equal=True)
        part = models.model_summary(spark, model, name)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------ noisy labels, whole jobs

def _noisy(rule):
    """The rule's label, turned over for one key in eight (SQL for both engines)."""
    keys = ", ".join(f"CAST({k} AS STRING)" for k in LI_KEYS)
    return (f"CAST(CASE WHEN substr(md5(concat_ws(':', {keys}, 'noise')), 1, 1) < '2' "
            f"THEN 1 - {rule} ELSE {rule} END AS INTEGER)")


def _sql_noisy(rule, seed=SEED):
    """What a learner that sees through the noise predicts: the clean rule."""
    return (f"SELECT split, label, prediction, count(*) AS n_rows FROM ("
            f"SELECT {_sql_split(LI_KEYS, seed)} AS split, {_noisy(rule)} AS label, "
            f"{rule} AS prediction FROM lineitem) t GROUP BY split, label, prediction")


def _sql_noisy_report(model, rule):
    return (f"SELECT '{model}' AS model, CAST({SEED} AS INTEGER) AS seed, "
            f"CASE split WHEN 'train' THEN 'Train accuracy' ELSE 'Test accuracy' END AS ValueType, "
            f"round(sum(CASE WHEN label = prediction THEN n_rows ELSE 0 END) / sum(n_rows), {DIGITS}) "
            f"AS Value FROM ({_sql_noisy(rule)}) r GROUP BY split")


def q_logistic_job(spark, d):
    """E8 for the binary job: headerless CSV, class text 'normal' against the rest."""
    cols = list(dict.fromkeys([*LI_KEYS, *LI_FEATURES]))
    li = _t(spark, d, "lineitem").withColumn(
        "class", F.expr(f"CASE WHEN {_noisy(RULE_LINEAR)} = 1 THEN 'normal' ELSE 'other' END"))
    li = li.select(*cols, "class")
    path, out = scratch_path(spark, "connections"), scratch_path(spark, "report")
    li.write.csv(path)
    jobs.run_job(spark, delimited.read_headerless(spark, path, li.columns, li.schema), out, "logistic",
                 SEED, LI_FEATURES, "class", jobs.is_class("class", jobs.NORMAL), LI_KEYS)
    back = spark.read.schema("ValueType string, Value double").csv(out)
    return back.filter(F.col("ValueType") != "Run time").select(
        "model", "seed", "ValueType", _r("Value").alias("Value"))


GBM_VARIANTS = ("raw", "scaled", "scaled_pca")
GENRE = (f"CASE WHEN l_quantity < 5 THEN 'Electronic' WHEN {RULE_TREE} = 1 THEN 'Rock' "
         f"ELSE 'Experimental' END")


def q_gbm_job(spark, d):
    """E6 + E8: bzip2 CSV with dotted names -> safe names -> two genres -> 0/1
    label -> boosted trees on three variants -> a report per variant, read
    back. The rule is oblique after PCA, so that variant's accuracies count as
    0.99 from 0.99 on; the others are exact."""
    cols = list(dict.fromkeys([*LI_KEYS, *LI_FEATURES]))
    li = _t(spark, d, "lineitem").withColumn("Genre", F.expr(GENRE)).select(*cols, "Genre")
    path, out = scratch_path(spark, "wrangled") + ".bz2", scratch_path(spark, "report")
    sinks.write_table(li.toDF(*[c.replace("_", ".", 1) for c in li.columns]), path)
    table = delimited.safe_names(delimited.read_with_header(spark, path, infer=True))
    jobs.run_job(spark, table, out, "gbt", SEED, LI_FEATURES, "Genre", jobs.is_class("Genre", "Rock"),
                 LI_KEYS, classes=("Rock", "Experimental"), variants=GBM_VARIANTS)
    back = spark.read.schema("ValueType string, Value double").csv(out)
    value = F.when((F.col("variant") == "scaled_pca") & (F.col("Value") >= 0.99), 0.99).otherwise(
        _r("Value"))
    return back.filter(F.col("ValueType") != "Run time").select(
        "model", "variant", "seed", "ValueType", value.alias("Value"))


SQL_GBM_JOB = (f"SELECT 'gbt' AS model, v.variant, CAST({SEED} AS INTEGER) AS seed, "
               f"CASE split WHEN 'train' THEN 'Train accuracy' ELSE 'Test accuracy' END AS ValueType, "
               f"CASE WHEN v.variant = 'scaled_pca' THEN 0.99::DOUBLE ELSE 1.0::DOUBLE END AS Value "
               f"FROM (SELECT DISTINCT {_sql_split(LI_KEYS, SEED)} AS split FROM lineitem "
               f"WHERE {GENRE} <> 'Electronic') t, "
               f"(VALUES {', '.join(f'({v!r})' for v in GBM_VARIANTS)}) v(variant)")

SEGMENTS = ("BUILDING", "MACHINERY")


def q_wrangle_job(spark, d):
    """Both raw files -> join -> class filter -> bzip2 CSV, read back."""
    feats = fixtures.write_multi_header_embeddings(spark, _t(spark, d, "embeddings"), _width(spark, d))
    tracks = fixtures.write_repeated_header_customers(spark, _t(spark, d, "customer"))
    return jobs.wrangle_job(spark, feats, tracks, scratch_path(spark, "wrangled") + ".bz2",
                            classes=SEGMENTS, value_type="float")


def _sql_wrangle_job():
    return (f"SELECT e.*, c_mktsegment AS Genre FROM ({_sql_multiheader()}) e "
            f"JOIN customer ON c_custkey = track_id WHERE c_mktsegment IN {SEGMENTS}")


SWEEP_LEARNERS = ("tree", "logistic", "lasso")


def _sweep_all(spark, d):
    """E7 for the three published learners, written as collated results and read back."""
    li = _t(spark, d, "lineitem", spread=True).withColumn("label", F.expr(_noisy(RULE_LINEAR)))
    path = scratch_path(spark, "collated")
    for _, runs in ex.seed_sweeps(li, LI_FEATURES, "label", LI_KEYS, SWEEP_LEARNERS, SWEEP,
                                  parallelism=4):
        sinks.write_report(runs.select("metric", "value", "seed", "model"), path, ("model",),
                           "overwrite_partitions", header=True)
    return sinks.read_collated(spark, path)


def q_seed_sweep_all(spark, d):
    return _sweep_all(spark, d).withColumn("value", _r("value"))


def q_seed_summary_all(spark, d):
    s = evaluate.seed_summary(_sweep_all(spark, d))
    return s.withColumns({c: _r(c) for c in ("min", "max", "mean", "std")})


_SWEEP_ALL = (f"WITH s AS (SELECT v.seed, {_sql_split(LI_KEYS, 'v.seed')} AS split, "
              f"{_noisy(RULE_LINEAR)} = {RULE_LINEAR} AS hit "
              f"FROM lineitem, (VALUES {', '.join(f'({x})' for x in SWEEP)}) v(seed)), "
              f"a AS (SELECT CAST(seed AS INTEGER) AS seed, split, count(*) AS n, "
              f"sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*) AS acc FROM s GROUP BY seed, split), "
              f"r AS (SELECT m.model, seed, split || '_rows' AS metric, CAST(n AS DOUBLE) AS value "
              f"FROM a, (VALUES {', '.join(f'({m!r})' for m in SWEEP_LEARNERS)}) m(model) "
              f"UNION ALL SELECT m.model, seed, split || '_accuracy', acc "
              f"FROM a, (VALUES {', '.join(f'({m!r})' for m in SWEEP_LEARNERS)}) m(model)) ")
SQL_SEED_SWEEP_ALL = _SWEEP_ALL + f"SELECT model, seed, metric, round(value, {DIGITS}) AS value FROM r"
SQL_SEED_SUMMARY_ALL = (
    _SWEEP_ALL + f"SELECT model, metric, round(min(value), {DIGITS}) AS min, "
    f"round(max(value), {DIGITS}) AS max, round(avg(value), {DIGITS}) AS mean, "
    f"round(stddev_samp(value), {DIGITS}) AS std, count(*) AS n_runs FROM r GROUP BY model, metric")


# ------------------------------------------------------------ splits, folds


def q_random_split_parts(spark, d):
    """K1(a): the parts of ``randomSplit`` cover the table and share no row."""
    train, test = sampling.random_split(_t(spark, d, "orders"), (0.7, 0.3), "23")
    both = train.select("o_orderkey", F.lit(1).alias("t")).unionByName(
        test.select("o_orderkey", F.lit(0).alias("t")))
    keys = both.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_shared"),
                    F.avg("t").between(0.6, 0.8).alias("share_ok"))


SQL_RANDOM_SPLIT_PARTS = ("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_shared, "
                          "true AS share_ok FROM orders")


def q_copy_split(spark, d):
    """K1 without a key: half the rows are copies of few; rows per side are near 70 %."""
    o = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.lit("copy")).otherwise(
        F.col("o_orderkey").cast("string")).alias("k"), "o_orderstatus")
    rows = sampling.numbered_copies(o, chunk=64)
    return sampling.hash_split(rows, ["k", "o_orderstatus", "_copy"], SEED)


SQL_COPY_SPLIT = ("WITH o AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'copy' "
                  "ELSE CAST(o_orderkey AS VARCHAR) END AS k, o_orderstatus FROM orders), "
                  "n AS (SELECT *, row_number() OVER (PARTITION BY k, o_orderstatus) - 1 AS _copy FROM o) "
                  f"SELECT *, {_sql_split(['k', 'o_orderstatus', '_copy'], SEED)} AS split FROM n")


# split seeds of the jobs (1, 23, 42) and of the single-machine notebook (2342)
SPLIT_SEEDS = (1, 23, 42, 2342)


def q_hash_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    o = o.withColumn("seed", F.explode(F.array(*[F.lit(x) for x in SPLIT_SEEDS])))
    return o.withColumn("split", sampling.split_column(["o_orderkey"], F.col("seed")))


SQL_HASH_SPLIT = (f"SELECT o_orderkey, CAST(v.seed AS INTEGER) AS seed, "
                  f"{_sql_split(['o_orderkey'], 'v.seed')} AS split "
                  f"FROM orders, (VALUES {', '.join(f'({x})' for x in SPLIT_SEEDS)}) v(seed)")


def q_random_split(spark, d):
    o = _t(spark, d, "orders")
    train, test = sampling.random_split(o, (0.7, 0.3), "23")
    return (train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
                 .groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")))


def q_stratified_folds(spark, d):
    o = _t(spark, d, "orders")
    return sampling.stratified_folds(o, ["o_orderkey"], "o_orderstatus", 10, 3, seed=1)


SQL_STRATIFIED_FOLDS = ("SELECT o_orderkey, o_orderstatus, CAST(r.rep AS INTEGER) AS repeat, "
                        "CAST((row_number() OVER (PARTITION BY o_orderstatus, r.rep ORDER BY "
                        "md5(concat_ws(':', o_orderkey, '1', r.rep)), o_orderkey) - 1) % 10 AS INTEGER) AS fold "
                        "FROM orders, range(3) r(rep)")


# ------------------------------------------------------------ features

def q_assemble(spark, d):
    li = wrangle.drop_columns(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_shipdate")
    cols = wrangle.feature_cols(li, exclude=LI_KEYS)
    out = features.assemble(li, cols)
    return features.flatten(out, "features", "f", len(cols), keep=LI_KEYS)


SQL_ASSEMBLE = (f"SELECT {', '.join(LI_KEYS)}, l_quantity AS f0, l_extendedprice AS f1, "
                f"l_discount AS f2, l_tax AS f3 FROM lineitem")


def q_label_index(spark, d):
    li = _t(spark, d, "lineitem").select("l_returnflag")
    m = features.fit_label_index(li, "l_returnflag", "label_index")
    return m.transform(li).groupBy("l_returnflag", "label_index").agg(F.count(F.lit(1)).alias("n_rows"))


SQL_LABEL_INDEX = ("SELECT l_returnflag, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 "
                   "AS DOUBLE) AS label_index, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag")


def q_category_index(spark, d):
    li = _t(spark, d, "lineitem")
    cols = ["l_linenumber", "l_tax", "l_discount"]
    df = features.assemble(li, cols)
    m = features.fit_category_index(df, "features", "indexed", max_categories=10)
    return features.flatten(m.transform(df), "indexed", "c", 3, keep=LI_KEYS)


SQL_CATEGORY_INDEX = (f"SELECT {', '.join(LI_KEYS)}, "
                      "CAST(dense_rank() OVER (ORDER BY (l_linenumber <> 0), l_linenumber) - 1 AS DOUBLE) AS c0, "
                      "CAST(dense_rank() OVER (ORDER BY (l_tax <> 0), l_tax) - 1 AS DOUBLE) AS c1, "
                      "l_discount AS c2 FROM lineitem")

EMB_D = 64      # the given tables' width: what the static SQL of the oracles names


def _width(spark, d):
    """Slots of the widest embedding; queries read it, they don't assume it."""
    return _t(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0


def _emb_vectors(spark, d):
    e = _t(spark, d, "embeddings")
    e = e.select("vec_id", array_to_vector(F.col("embedding")).alias("features"))
    return sampling.hash_split(e, ["vec_id"], SEED)


def _scaled(kind):
    """Scaler fitted on train rows, applied to all; long output
    ``(vec_id, slot, value)`` - one expression whatever the dimension."""
    def q(spark, d):
        e = _emb_vectors(spark, d)
        train = e.filter(F.col("split") == "train")
        if kind == "pop":
            m = features.PopulationScaler("features", "normFeatures", with_mean=True).fit(train)
        else:
            m = features.fit_scaler(train, "features", "normFeatures", with_mean=(kind == "std"))
        long = m.transform(e).select("vec_id", F.posexplode(vector_to_array("normFeatures"))
                                     .alias("slot", "value"))
        return long.select("vec_id", "slot", _r("value").alias("value"))
    return q


def _sql_scaled(kind):
    sd = "stddev_pop" if kind == "pop" else "stddev_samp"
    center = "- m" if kind in ("std", "pop") else ""
    return (f"WITH e AS (SELECT vec_id, embedding, {_sql_split(['vec_id'], SEED)} AS split FROM embeddings), "
            f"u AS (SELECT vec_id, split, unnest(generate_series(0, len(embedding) - 1)) AS slot, "
            f"unnest(embedding)::DOUBLE AS x FROM e), "
            f"st AS (SELECT slot, avg(x) AS m, {sd}(x) AS d FROM u WHERE split = 'train' GROUP BY slot) "
            f"SELECT u.vec_id, CAST(u.slot AS INTEGER) AS slot, "
            f"round(CASE WHEN d = 0 THEN 0.0 ELSE (x {center}) / d END, {DIGITS}) AS value "
            f"FROM u JOIN st USING (slot)")


def q_covariance(spark, d):
    e = _emb_vectors(spark, d).filter(F.col("split") == "train")
    return red.covariance(e, "features").withColumn("cov", _r("cov"))


SQL_COVARIANCE = (f"WITH e AS (SELECT vec_id, embedding FROM embeddings "
                  f"WHERE {_sql_split(['vec_id'], SEED)} = 'train'), "
                  f"u AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, "
                  f"unnest(embedding)::DOUBLE AS x FROM e) "
                  f"SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, "
                  f"round(covar_samp(a.x, b.x), {DIGITS}) AS cov FROM u a JOIN u b USING (vec_id) "
                  f"GROUP BY a.i, b.i")


def q_pca_variance(spark, d):
    e = _emb_vectors(spark, d)
    train = e.filter(F.col("split") == "train")
    sc = features.fit_scaler(train, "features", "normFeatures", with_mean=True)
    scaled_train = sc.transform(train)
    pca = red.fit_pca(scaled_train, "normFeatures", "pca", _width(spark, d))
    total = red.total_variance(scaled_train, "normFeatures")
    spectrum = red.explained_variance(spark, pca, total)
    return spectrum.select("component", *[_r(c).alias(c) for c in ("ratio", "cumulative", "eigenvalue")])


def q_pca_power_sums(spark, d):
    """F7-F10 against SQL: the eigenvalues' power sums are the traces of the
    matrix's powers (p = 1, 2, 3), and a full rotation keeps the rows' squared
    norms (p = 0)."""
    e = _emb_vectors(spark, d).filter(F.col("split") == "train")
    scaled = features.fit_scaler(e, "features", "normFeatures", with_mean=True).transform(e)
    pca = red.fit_pca(scaled, "normFeatures", "pca", _width(spark, d))
    spectrum = red.explained_variance(spark, pca, red.total_variance(scaled, "normFeatures"))
    powers = (spectrum.select(F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("p"), "eigenvalue")
              .groupBy("p").agg(F.sum(F.pow("eigenvalue", "p")).alias("value")))
    norms = pca.transform(scaled).select(F.explode(vector_to_array("pca")).alias("x")).agg(
        F.lit(0).alias("p"), F.sum(F.col("x") * F.col("x")).alias("value"))
    return powers.unionByName(norms).withColumn("value", _r("value"))


SQL_PCA_POWER_SUMS = (
    f"WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE {_sql_split(['vec_id'], SEED)} = 'train'), "
    f"u AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, "
    f"unnest(embedding)::DOUBLE AS x FROM e), "
    f"c AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i), "
    f"st AS (SELECT i, avg(x) AS m, stddev_samp(x) AS d FROM u GROUP BY i), "
    f"p AS (SELECT 0 AS p, sum(power((x - m) / d, 2)) AS value FROM u JOIN st USING (i) "
    f"UNION ALL SELECT 1, sum(r) FROM c WHERE i = j UNION ALL SELECT 2, sum(r * r) FROM c "
    f"UNION ALL SELECT 3, sum(a.r * b.r * c2.r) FROM c a JOIN c b ON a.j = b.i "
    f"JOIN c c2 ON b.j = c2.i AND c2.j = a.i) "
    f"SELECT p, round(value, {DIGITS}) AS value FROM p")


# ------------------------------------------------------------ sources, sinks

def q_csv_headerless_scan(spark, d):
    cust = _t(spark, d, "customer")
    path = scratch_path(spark, "headerless")
    cust.write.option("header", "false").csv(path)
    return delimited.read_headerless(spark, path, cust.columns, cust.schema)


def q_csv_header_bz2_roundtrip(spark, d):
    o = _t(spark, d, "orders")
    path = scratch_path(spark, "bz2") + ".bz2"
    sinks.write_table(o, path, "csv", compression="bzip2", header=True)
    return delimited.read_with_header(spark, path, schema=o.schema)


def q_safe_names(spark, d):
    p = _t(spark, d, "part")
    dotted = p.toDF(*[c.replace("_", ".", 1) for c in p.columns])
    path = scratch_path(spark, "dotted")
    sinks.write_table(dotted, path, "csv", compression=None, header=True)
    back = delimited.safe_names(delimited.read_with_header(spark, path))
    return back.select(*[F.col(f.name).cast(f.dataType) for f in p.schema.fields])


def q_multiheader_scan(spark, d):
    e = _t(spark, d, "embeddings")
    path = fixtures.write_multi_header_embeddings(spark, e, _width(spark, d))
    return delimited.read_multi_header(spark, path, 3, ",", "_", "track_id", value_type="float")


def q_csv_lines_parse(spark, d):
    """Text lines of the multi-row-header fixture, metadata lines dropped
    by their key, parsed with the generated schema."""
    e = _t(spark, d, "embeddings")
    path = fixtures.write_multi_header_embeddings(spark, e, _width(spark, d))
    names = delimited.multi_header_names(delimited.header_lines(spark, path, 3), key_name="track_id")
    schema = T.StructType([T.StructField(names[0], T.LongType())] +
                          [T.StructField(n, T.FloatType()) for n in names[1:]])
    lines = spark.read.text(path)
    body = lines.filter(F.split_part("value", F.lit(","), F.lit(1)).try_cast("bigint").isNotNull())
    return delimited.parse_lines(body, schema)


def _sql_multiheader():
    names = ["_".join(n) for n in fixtures.embedding_names(EMB_D)]
    cols = ", ".join(f"embedding[{i + 1}] AS {n}" for i, n in enumerate(names))
    return f"SELECT vec_id AS track_id, {cols} FROM embeddings"


def q_family_profile(spark, d):
    wide = q_multiheader_scan(spark, d)
    long = profile.long_format(wide, [c for c in wide.columns if c != "track_id"])
    fam = importance.with_family(long)
    return fam.groupBy("category").agg(F.count("value").alias("n_values"),
                                       _r(F.avg("value")).alias("mean"),
                                       F.countDistinct("feature").alias("n_features"))


SQL_FAMILY_PROFILE = ("WITH u AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i, "
                      "unnest(embedding)::DOUBLE AS x FROM embeddings) "
                      f"SELECT 'emb' || CAST(i // 16 AS VARCHAR) AS category, count(x) AS n_values, "
                      f"round(avg(x), {DIGITS}) AS mean, count(DISTINCT i) AS n_features "
                      f"FROM u WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY i // 16")


def q_positional_scan(spark, d):
    c = _t(spark, d, "customer")
    path = fixtures.write_repeated_header_customers(spark, c)
    return delimited.read_positional(spark, path, {"track_id": 0, "Genre": ("track", 8)},
                                     types={"track_id": "int"}, key="track_id")


SQL_POSITIONAL = "SELECT CAST(c_custkey AS INTEGER) AS track_id, c_mktsegment AS Genre FROM customer"


def _rule_scored(spark, d):
    li = _t(spark, d, "lineitem")
    li = sampling.hash_split(li, LI_KEYS, SEED)
    return li.select("split", F.col("l_returnflag").alias("label"),
                     F.expr(RULE_PRED).alias("prediction"))


_SQL_RULE = (f"SELECT {_sql_split(LI_KEYS, SEED)} AS split, l_returnflag AS label, "
             f"{RULE_PRED} AS prediction FROM lineitem")


def q_report_sink(spark, d):
    acc = evaluate.accuracy(_rule_scored(spark, d), "label", "prediction").collect()
    rows = [("rule", "Train accuracy" if r["split"] == "train" else "Test accuracy",
             float(r["accuracy"])) for r in acc]
    rep = small_table(spark, rows, "model string, ValueType string, Value double")
    path = scratch_path(spark, "report")
    sinks.write_report(rep, path, partition_by=("model",))
    back = spark.read.schema("ValueType string, Value double").csv(path)
    return back.select("model", "ValueType", _r("Value").alias("Value"))


SQL_REPORT_SINK = (f"SELECT 'rule' AS model, CASE split WHEN 'train' THEN 'Train accuracy' "
                   f"ELSE 'Test accuracy' END AS ValueType, "
                   f"round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), {DIGITS})::DOUBLE AS Value "
                   f"FROM ({_SQL_RULE}) t GROUP BY split")


# ------------------------------------------------------------ metrics

def q_accuracy(spark, d):
    return evaluate.accuracy(_rule_scored(spark, d), "label", "prediction").withColumn(
        "accuracy", _r("accuracy"))


SQL_ACCURACY = (f"SELECT split, count(*) AS n_rows, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) "
                f"AS n_correct, round(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*), {DIGITS}) AS accuracy "
                f"FROM ({_SQL_RULE}) t GROUP BY split")


def q_balanced_accuracy(spark, d):
    return evaluate.balanced_accuracy(_rule_scored(spark, d), "label", "prediction").withColumn(
        "balanced_accuracy", _r("balanced_accuracy"))


SQL_BALANCED_ACCURACY = (f"SELECT split, round(avg(recall), {DIGITS}) AS balanced_accuracy, count(*) AS n_classes, "
                         f"CAST(sum(n) AS BIGINT) AS n_rows FROM ("
                         f"SELECT split, label, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*) AS recall, "
                         f"count(*) AS n "
                         f"FROM ({_SQL_RULE}) t GROUP BY split, label) r GROUP BY split")


def q_confusion_matrix(spark, d):
    cm = evaluate.confusion_matrix(_rule_scored(spark, d), "label", "prediction", by=["split"])
    return cm.withColumn("rate", _r("rate"))


SQL_CONFUSION = (f"WITH t AS ({_SQL_RULE}), cls AS (SELECT label AS c FROM t UNION SELECT prediction FROM t), "
                 f"tot AS (SELECT split, label, count(*) AS total FROM t GROUP BY split, label), "
                 f"cnt AS (SELECT split, label, prediction, count(*) AS n FROM t GROUP BY ALL) "
                 f"SELECT tot.split, tot.label, cls.c AS prediction, coalesce(cnt.n, 0) AS n, "
                 f"round(coalesce(cnt.n, 0) / tot.total, {DIGITS}) AS rate FROM tot CROSS JOIN cls "
                 f"LEFT JOIN cnt ON cnt.split = tot.split AND cnt.label = tot.label AND cnt.prediction = cls.c")


def q_preview(spark, d):
    li = _t(spark, d, "lineitem")
    scored = li.select(*LI_KEYS, F.col("l_returnflag").alias("label"),
                       F.expr(RULE_PRED).alias("prediction"))
    return wrangle.preview(scored, ["prediction", "label"], 5, order_by=list(LI_KEYS))


SQL_PREVIEW = (f"SELECT {', '.join(LI_KEYS)}, {RULE_PRED} AS prediction, l_returnflag AS label "
               f"FROM lineitem ORDER BY {', '.join(LI_KEYS)} LIMIT 5")


# ------------------------------------------------------------ wrangling

def q_isin_filter(spark, d):
    o = _t(spark, d, "orders")
    return wrangle.keep_classes(o, "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


SQL_ISIN = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')"


def q_binary_label(spark, d):
    o = wrangle.keep_classes(_t(spark, d, "orders"), "o_orderstatus", ["F", "O"])
    o = wrangle.with_binary_label(o, "o_orderstatus", "F", "label", drop_source=True)
    return o.select("o_orderkey", "o_totalprice", "label")


SQL_BINARY_LABEL = ("SELECT o_orderkey, o_totalprice, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) "
                    "AS label FROM orders WHERE o_orderstatus IN ('F', 'O')")


def _docs_labels(spark, d, how):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = _t(spark, d, "labels")
    return wrangle.join_labels(docs, labels, "doc_id", how)


def q_feature_label_join(spark, d):
    return _docs_labels(spark, d, "inner")


SQL_JOIN = ("SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d "
            "JOIN labels l ON d.doc_id = l.doc_id")


def q_class_histogram(spark, d):
    return profile.class_histogram(_t(spark, d, "events"), "event_type")


SQL_CLASS_HISTOGRAM = "SELECT event_type, count(*) AS count FROM events GROUP BY event_type"


def q_class_histogram_null(spark, d):
    return profile.class_histogram(_docs_labels(spark, d, "left"), "quality", keep_null=True)


SQL_CLASS_HISTOGRAM_NULL = ("SELECT l.quality, count(*) AS count FROM documents d LEFT JOIN labels l "
                            "ON d.doc_id = l.doc_id GROUP BY l.quality")


def q_notnull_filter(spark, d):
    return wrangle.drop_null(_docs_labels(spark, d, "left"), "quality").select("doc_id", "quality")


SQL_NOTNULL = ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
               "WHERE l.quality IS NOT NULL")


def q_row_count(spark, d):
    return profile.row_count(_t(spark, d, "lineitem"))


SQL_ROW_COUNT = "SELECT count(*) AS n_rows FROM lineitem"


# ------------------------------------------------------------ profile

PROFILE_OUT = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _rounded_profile(p):
    return p.select("feature", "count", *[_r(c).alias(c) for c in PROFILE_OUT[1:]])


def _line_profile(spark, d, **params):
    # every round reads the rows: they are spread and kept once
    li = _t(spark, d, "lineitem", spread=True).select(*PROFILE_COLS).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rounded_profile(profile.feature_profile(profile.long_format(li, PROFILE_COLS), **params))
    finally:
        li.unpersist()


def q_feature_profile(spark, d):
    return _line_profile(spark, d)


def q_feature_profile_bracketed(spark, d):
    """The same with small cells, so that the rounds that large tables need run."""
    return _line_profile(spark, d, max_candidates=1000)


def q_profile_sparse(spark, d):
    """Features with nulls, one of them with nothing else."""
    j = _docs_labels(spark, d, "left").withColumn("missing", F.expr("nullif(n_chars, n_chars)"))
    return _rounded_profile(profile.feature_profile(profile.long_format(j, SPARSE_COLS)))


def _sql_profile(long_sql, where=""):
    return (f"SELECT feature, count(value) AS count, round(avg(value), {DIGITS}) AS mean, "
            f"round(stddev_samp(value), {DIGITS}) AS std, round(min(value), {DIGITS}) AS min, "
            f"round(quantile_cont(value, 0.25), {DIGITS}) AS p25, round(quantile_cont(value, 0.5), {DIGITS}) AS p50, "
            f"round(quantile_cont(value, 0.75), {DIGITS}) AS p75, round(max(value), {DIGITS}) AS max "
            f"FROM (SELECT feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS value "
            f"FROM ({long_sql}) x) t GROUP BY feature {where}")


SQL_FEATURE_PROFILE = _sql_profile(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in PROFILE_COLS))


def q_embedding_profile(spark, d):
    e = _t(spark, d, "embeddings")
    long = profile.array_long_format(e, "embedding")
    return _rounded_profile(profile.feature_profile(long))


SQL_EMBEDDING_PROFILE = _sql_profile(
    "SELECT 'f' || CAST(unnest(generate_series(0, len(embedding) - 1)) AS VARCHAR) AS feature, "
    "unnest(embedding)::DOUBLE AS value FROM embeddings")

LOW_SPREAD_COLS = ("quality", "toxic", "n_chars")
SPARSE_COLS = (*LOW_SPREAD_COLS, "missing")
SQL_PROFILE_SPARSE = _sql_profile(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({x} AS DOUBLE) AS value FROM documents d LEFT JOIN labels l "
    f"ON d.doc_id = l.doc_id"
    for c, x in zip(SPARSE_COLS, (*LOW_SPREAD_COLS, "nullif(n_chars, n_chars)"), strict=True)))


def q_low_spread(spark, d):
    j = _docs_labels(spark, d, "inner")
    prof = profile.feature_profile(profile.long_format(j, LOW_SPREAD_COLS))
    return _rounded_profile(profile.low_spread(prof))


SQL_LOW_SPREAD = ("SELECT * FROM (" + _sql_profile(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM documents d JOIN labels l "
    f"ON d.doc_id = l.doc_id" for c in LOW_SPREAD_COLS)) + ") p WHERE p25 = p75")


# ------------------------------------------------------------ importance

def _importance_model(spark, d):
    wide = q_multiheader_scan(spark, d)
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), "label")
    data = wide.join(labels, "track_id").withColumn("label", (F.col("label") >= 5).cast("int"))
    feats = [c for c in wide.columns if c != "track_id"]
    prep = ex.prepare(data, feats, "label", ["track_id"], seed=SEED)
    model, scored = ex.fit_and_score(prep, ex.learner_for("gbt"))
    names = importance.slot_names(prep.data, "features")
    return importance.importances(spark, model, names)


def q_importance_top(spark, d):
    imp = _importance_model(spark, d)
    return importance.top_k(imp, 50)


def q_importance_family(spark, d):
    imp = _importance_model(spark, d)
    top = importance.family_summary(importance.top_k(imp, 50)).withColumn("part", F.lit("top50"))
    low = importance.family_summary(importance.top_k(imp, 50, descending=False)) \
        .withColumn("part", F.lit("bottom50"))
    return top.unionByName(low)


USED_FEATURES = ("l_linenumber", "l_discount")
IDLE_FEATURES = ("l_tax", "l_quantity", "l_extendedprice")


def q_importance_planted(spark, d):
    """E4 and M8 on the planted rule, raw and scaled: the rule's features and no
    others carry importance, named whatever the variant; sums and model sizes."""
    li = _t(spark, d, "lineitem", spread=True).withColumn("label", F.expr(RULE_TREE))
    prep = ex.prepare(li, USED_FEATURES + IDLE_FEATURES, "label", LI_KEYS, seed=SEED)
    out = None
    for variant in ("raw", "scaled"):
        data, cat = ex.variant_data(prep, variant)
        model, _ = ex.fit_and_score(prep, ex.learner_for("tree"), data, cat)
        imp = importance.importances(spark, model, ex.variant_names(prep, variant))
        total = imp.agg(_r(F.sum("importance")).alias("total"))
        size = models.model_summary(spark, model, "tree").select(
            "model", "num_trees", "total_nodes", "depth", "num_features", "num_classes")
        part = (imp.select(F.lit(variant).alias("variant"), "feature",
                           (F.col("importance") > 0).alias("used"))
                .join(F.broadcast(total)).join(F.broadcast(size)))     # one row each
        out = part if out is None else out.unionByName(part)
    prep.data.unpersist()
    return out


SQL_IMPORTANCE_PLANTED = (
    f"SELECT v.variant, f.feature, f.used, 1.0::DOUBLE AS total, 'tree' AS model, "
    f"CAST(1 AS INTEGER) AS num_trees, CAST(5 AS INTEGER) AS total_nodes, CAST(2 AS INTEGER) AS depth, "
    f"CAST({len(USED_FEATURES + IDLE_FEATURES)} AS INTEGER) AS num_features, "
    f"CAST(count(DISTINCT {RULE_TREE}) AS INTEGER) AS num_classes FROM lineitem, "
    f"(VALUES ('raw'), ('scaled')) v(variant), (VALUES "
    + ", ".join(f"('{f}', {f in USED_FEATURES})" for f in USED_FEATURES + IDLE_FEATURES)
    + ") f(feature, used) GROUP BY v.variant, f.feature, f.used")


# ---------------------------------------- data-derived score tables

def _emb_names(d):
    return ["_".join(n) for n in fixtures.embedding_names(d)]


def _variance_scores(spark, d):
    """Per-slot sample variance of the embeddings as a score table
    ``(feature, importance)``, slots named like the wide audio table."""
    e = _t(spark, d, "embeddings")
    long = profile.array_long_format(e, "embedding", names=_emb_names(_width(spark, d)))
    return long.groupBy("feature").agg(F.var_samp("value").alias("importance"))


def q_top_variance(spark, d):
    top = importance.top_k(_variance_scores(spark, d), 50)
    return top.withColumn("importance", _r("importance"))


def q_top_variance_family(spark, d):
    scores = _variance_scores(spark, d)
    top = importance.family_summary(importance.top_k(scores, 50)).withColumn("part", F.lit("top50"))
    low = importance.family_summary(importance.top_k(scores, 50, descending=False)) \
        .withColumn("part", F.lit("bottom50"))
    out = top.unionByName(low)
    return out.withColumn("total", _r("total")).withColumn("mean", _r("mean"))


def q_variance_share(spark, d):
    scores = _variance_scores(spark, d)
    return (evaluate.share_and_running_total(scores, "importance", "feature")
            .select("rank", "feature", _r("share").alias("share"), _r("cumulative").alias("cumulative")))


_SQL_SCORES = ("WITH u AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS i, "
               "unnest(embedding)::DOUBLE AS x FROM embeddings), "
               "s AS (SELECT 'emb' || CAST(i // 16 AS VARCHAR) || '_' || "
               "list_extract(['mean', 'std', 'min', 'max'], CAST((i // 4) % 4 + 1 AS INTEGER)) || '_' || "
               "lpad(CAST(i % 4 + 1 AS VARCHAR), 2, '0') AS feature, var_samp(x) AS importance "
               "FROM u WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY i) ")
SQL_TOP_VARIANCE = (_SQL_SCORES + f"SELECT feature, round(importance, {DIGITS}) AS importance FROM s "
                    f"ORDER BY importance DESC, feature LIMIT 50")


def _sql_family(order):
    return (f"SELECT split_part(feature, '_', 1) AS category, sum(importance) AS total, "
            f"avg(importance) AS mean, count(*) AS n_features FROM "
            f"(SELECT * FROM s ORDER BY importance {order}, feature LIMIT 50) t GROUP BY 1")


SQL_TOP_VARIANCE_FAMILY = (_SQL_SCORES + f"SELECT category, round(total, {DIGITS}) AS total, "
                           f"round(mean, {DIGITS}) AS mean, n_features, part FROM ("
                           f"SELECT *, 'top50' AS part FROM ({_sql_family('DESC')}) UNION ALL "
                           f"SELECT *, 'bottom50' AS part FROM ({_sql_family('ASC')}))")
SQL_VARIANCE_SHARE = (_SQL_SCORES + f"SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, "
                      f"feature, round(importance / sum(importance) OVER (), {DIGITS}) AS share, "
                      f"round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING "
                      f"AND CURRENT ROW) / sum(importance) OVER (), {DIGITS}) AS cumulative FROM s")


# ------------------------------------------------------------ registry

QUERIES = {
    # learners on planted labels (exact oracle)
    "tree_planted": _planted(RULE_TREE, "tree"),
    "logit_planted": _planted(RULE_LINEAR, "logistic"),
    "lasso_planted": _planted(RULE_LINEAR, "lasso"),
    "gbt_planted": _planted(RULE_TREE, "gbt"),
    "ovr_gbt_planted": _planted(RULE_BANDS, "ovr_gbt", parallelism=3),
    "model_reload_predict": q_model_reload_predict,
    "tree_job": q_tree_job,
    "variant_compare": q_variant_compare,
    "variant_pca": q_variant_pca,
    "seed_sweep": q_seed_sweep,
    "seed_summary": q_seed_summary,
    "cv_scores": q_cv_scores,
    "cv_summary": q_cv_summary,
    "cv_ovr_gbt": q_cv_ovr_gbt,
    "cv_variants": q_cv_variants,
    "model_summary": q_model_summary,
    # noisy labels, whole jobs
    "tree_noisy": _planted(_noisy(RULE_TREE), "tree"),
    "logit_noisy": _planted(_noisy(RULE_LINEAR), "logistic"),
    "lasso_noisy": _planted(_noisy(RULE_LINEAR), "lasso"),
    "gbt_noisy": _planted(_noisy(RULE_TREE), "gbt"),
    "logistic_job": q_logistic_job,
    "gbm_job": q_gbm_job,
    "wrangle_job": q_wrangle_job,
    "seed_sweep_all": q_seed_sweep_all,
    "seed_summary_all": q_seed_summary_all,
    "random_split_parts": q_random_split_parts,
    "copy_split": q_copy_split,
    "pca_power_sums": q_pca_power_sums,
    "feature_profile_bracketed": q_feature_profile_bracketed,
    "profile_sparse": q_profile_sparse,
    "importance_planted": q_importance_planted,
    # splits and folds
    "hash_split": q_hash_split,
    "random_split": q_random_split,
    "stratified_folds": q_stratified_folds,
    # feature transformers and reduction
    "assemble": q_assemble,
    "label_index": q_label_index,
    "category_index": q_category_index,
    "scale_unit": _scaled("unit"),
    "standardise": _scaled("std"),
    "standardise_pop": _scaled("pop"),
    "covariance": q_covariance,
    "pca_variance": q_pca_variance,
    # sources and sinks
    "csv_headerless_scan": q_csv_headerless_scan,
    "csv_header_bz2_roundtrip": q_csv_header_bz2_roundtrip,
    "safe_names": q_safe_names,
    "multiheader_scan": q_multiheader_scan,
    "csv_lines_parse": q_csv_lines_parse,
    "positional_scan": q_positional_scan,
    "report_sink": q_report_sink,
    # metrics
    "accuracy": q_accuracy,
    "balanced_accuracy": q_balanced_accuracy,
    "confusion_matrix": q_confusion_matrix,
    "preview": q_preview,
    # wrangling
    "isin_filter": q_isin_filter,
    "binary_label": q_binary_label,
    "feature_label_join": q_feature_label_join,
    "class_histogram": q_class_histogram,
    "class_histogram_null": q_class_histogram_null,
    "notnull_filter": q_notnull_filter,
    "row_count": q_row_count,
    # profile
    "feature_profile": q_feature_profile,
    "embedding_profile": q_embedding_profile,
    "low_spread": q_low_spread,
    "family_profile": q_family_profile,
    # importance
    "importance_top": q_importance_top,
    "importance_family": q_importance_family,
    "top_variance": q_top_variance,
    "top_variance_family": q_top_variance_family,
    "variance_share": q_variance_share,
}

def _plus_zero_rounds(sql: str) -> str:
    """``round(x, d)`` -> ``(round(x, d) + 0.0)``: DuckDB keeps -0.0 after
    rounding, Spark returns 0.0; adding +0.0 maps -0.0 to 0.0 (IEEE)."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, quote = 0, j + 5, None
        while k < len(sql):
            ch = sql[k]
            if quote:
                quote = None if ch == quote else quote
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _plus_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


ORACLES = {
    "tree_planted": _sql_planted(RULE_TREE),
    "logit_planted": _sql_planted(RULE_LINEAR),
    "lasso_planted": _sql_planted(RULE_LINEAR),
    "gbt_planted": _sql_planted(RULE_TREE),
    "ovr_gbt_planted": _sql_planted(RULE_BANDS),
    "model_reload_predict": _sql_planted(RULE_TREE),
    "tree_job": SQL_TREE_JOB,
    "variant_compare": SQL_VARIANT_COMPARE,
    "seed_sweep": SQL_SEED_SWEEP,
    "seed_summary": SQL_SEED_SUMMARY,
    "cv_scores": SQL_CV_SCORES,
    "cv_summary": SQL_CV_SUMMARY,
    "cv_ovr_gbt": _sql_cv_bands(),
    "cv_variants": SQL_CV_VARIANTS,
    "hash_split": SQL_HASH_SPLIT,
    "stratified_folds": SQL_STRATIFIED_FOLDS,
    "assemble": SQL_ASSEMBLE,
    "label_index": SQL_LABEL_INDEX,
    "category_index": SQL_CATEGORY_INDEX,
    "scale_unit": _sql_scaled("unit"),
    "standardise": _sql_scaled("std"),
    "standardise_pop": _sql_scaled("pop"),
    "covariance": SQL_COVARIANCE,
    "csv_headerless_scan": "SELECT * FROM customer",
    "csv_header_bz2_roundtrip": "SELECT * FROM orders",
    "safe_names": "SELECT * FROM part",
    "multiheader_scan": _sql_multiheader(),
    "csv_lines_parse": _sql_multiheader(),
    "positional_scan": SQL_POSITIONAL,
    "report_sink": SQL_REPORT_SINK,
    "accuracy": SQL_ACCURACY,
    "balanced_accuracy": SQL_BALANCED_ACCURACY,
    "confusion_matrix": SQL_CONFUSION,
    "preview": SQL_PREVIEW,
    "isin_filter": SQL_ISIN,
    "binary_label": SQL_BINARY_LABEL,
    "feature_label_join": SQL_JOIN,
    "class_histogram": SQL_CLASS_HISTOGRAM,
    "class_histogram_null": SQL_CLASS_HISTOGRAM_NULL,
    "notnull_filter": SQL_NOTNULL,
    "row_count": SQL_ROW_COUNT,
    "feature_profile": SQL_FEATURE_PROFILE,
    "embedding_profile": SQL_EMBEDDING_PROFILE,
    "low_spread": SQL_LOW_SPREAD,
    "family_profile": SQL_FAMILY_PROFILE,
    "top_variance": SQL_TOP_VARIANCE,
    "top_variance_family": SQL_TOP_VARIANCE_FAMILY,
    "variance_share": SQL_VARIANCE_SHARE,
    "tree_noisy": _sql_noisy(RULE_TREE),
    "logit_noisy": _sql_noisy(RULE_LINEAR),
    "lasso_noisy": _sql_noisy(RULE_LINEAR),
    "gbt_noisy": _sql_noisy(RULE_TREE),
    "logistic_job": _sql_noisy_report("logistic", RULE_LINEAR),
    "gbm_job": SQL_GBM_JOB,
    "wrangle_job": _sql_wrangle_job(),
    "seed_sweep_all": SQL_SEED_SWEEP_ALL,
    "seed_summary_all": SQL_SEED_SUMMARY_ALL,
    "random_split_parts": SQL_RANDOM_SPLIT_PARTS,
    "copy_split": SQL_COPY_SPLIT,
    "pca_power_sums": SQL_PCA_POWER_SUMS,
    "feature_profile_bracketed": SQL_FEATURE_PROFILE,
    "profile_sparse": SQL_PROFILE_SPARSE,
    "importance_planted": SQL_IMPORTANCE_PLANTED,
}


def _sig_rounds(sql: str) -> str:
    """``round(x, 9)`` -> the same significant-digit rounding as ``_r``."""
    out, i, low, tag = [], 0, sql.lower(), "round("
    while True:
        j = low.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + len(tag)])
            i = j + len(tag)
            continue
        depth, k, quote, comma = 0, j + len(tag) - 1, None, None
        while k < len(sql):
            ch = sql[k]
            if quote:
                quote = None if ch == quote else quote
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[j + len(tag):comma], sql[comma + 1:k].strip()
        inner = _sig_rounds(inner)
        if digits != str(DIGITS):
            out.append(sql[i:j] + f"round({inner}, {digits})")
        else:
            out.append(sql[i:j] + _sql_sig(f"(({inner})::DOUBLE)"))
        i = k + 1


ORACLES = {k: _plus_zero_rounds(_sig_rounds(v)) for k, v in ORACLES.items()}
