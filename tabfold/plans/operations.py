"""Registered queries around a long experiment: sweeps that are resumed, lines that
are rejected, classes that are rare, tables that are wide."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import weights
from tabfold.plans import catalog as C
from tabfold.plans import experiment as ex
from tabfold.plans import ledger
from tabfold.session import scratch_path
from tabfold.sources import rejects, sinks

# ------------------------------------------------------------ E7 resumed sweep

BEFORE_LOSS = 4    # seeds of the job that was lost


def q_sweep_resumed(spark, d):
    """A sweep of four seeds, then one of all ten on the same ledger, which fits the other six."""
    li = C._t(spark, d, "lineitem", spread=True).withColumn("label", F.expr(C._noisy(C.RULE_LINEAR)))
    path = scratch_path(spark, "ledger")
    for attempt, seeds in (("first", C.SWEEP[:BEFORE_LOSS]), ("second", C.SWEEP)):
        runs = ledger.resumable_sweep(li, C.LI_FEATURES, "label", C.LI_KEYS, path, ("tree",), seeds,
                                      attempt, parallelism=4)
    return runs.withColumn("value", C._r("value"))


_FIRST = ", ".join(str(s) for s in C.SWEEP[:BEFORE_LOSS])
SQL_SWEEP_RESUMED = (C._SWEEP_ALL + f"SELECT model, seed, metric, round(value, {C.DIGITS}) AS value, "
                     f"CASE WHEN seed IN ({_FIRST}) THEN 'first' ELSE 'second' END AS attempt "
                     f"FROM r WHERE model = 'tree'")

# ------------------------------------------------------------ S4 / S6 rejected lines

REJECT_HEADER = ("feature,part,supp,line", "statistics,key,key,number", "number,01,02,03", "track_id,,,")
_KEY = "CAST(l_orderkey * 8 + l_linenumber AS STRING)"
_DAMAGE = f"substr(md5(concat({_KEY}, ':damage')), 1, 1)"
# what a line's first hex digit of its hash does to it (SQL for both engines)
_LINE = (f"CASE {_DAMAGE} WHEN '0' THEN concat({_KEY}, 'x,', p, ',', s, ',', n) "
         f"WHEN '1' THEN concat({_KEY}, ',', p, ',', s) "
         f"WHEN '2' THEN concat({_KEY}, ',', p, ',', s, ',', n, ',9') "
         f"WHEN '3' THEN concat({_KEY}, ',n/a,', s, ',', n) "
         f"WHEN '4' THEN concat(',', p, ',', s, ',', n) "
         f"WHEN '5' THEN concat({_KEY}, ',,', s, ',', n) "
         f"WHEN '6' THEN '   ' WHEN '7' THEN concat({_KEY}, ',n/a,', s) "
         f"ELSE concat({_KEY}, ',', p, ',', s, ',', n) END")
_TEXTS = "CAST(l_partkey AS STRING) AS p, CAST(l_suppkey AS STRING) AS s, CAST(l_linenumber AS STRING) AS n"


def _ingested(spark, d):
    li = C._t(spark, d, "lineitem", spread=True)
    lines = li.selectExpr("l_orderkey", "l_linenumber", *_TEXTS.split(", ")).select(F.expr(_LINE).alias("value"))
    path = scratch_path(spark, "damaged")
    sinks.write_lines_with_header(lines, REJECT_HEADER, path)
    return rejects.ingest_multi_header(spark, path, strict=True)


def q_csv_rejects(spark, d):
    """Every line of the body, with what it was read as and why it was rejected."""
    lines = _ingested(spark, d).lines.filter("reason IS NULL OR reason <> 'header'")
    return lines.select("line", F.coalesce("reason", F.lit("good")).alias("reason"), "n_bad_cells",
                        "row.track_id", F.col("row.part_key_01").alias("part"),
                        F.col("row.supp_key_02").alias("supp"),
                        F.col("row.line_number_03").alias("line_number"))


def q_csv_line_account(spark, d):
    """Lines by reason (headers: per file), all lines, and files whose line numbers have gaps."""
    read = _ingested(spark, d)
    account = read.account()
    by_reason = account.groupBy("reason").agg(
        (F.sum("n_lines") / F.when(F.col("reason") == "header", F.count("*")).otherwise(1)).alias("n_lines"),
        F.sum("n_bad_cells").alias("n_bad_cells"))
    body = account.filter("reason <> 'header'").agg(
        F.lit("all of the body").alias("reason"), F.sum("n_lines").cast("double").alias("n_lines"),
        F.sum("n_bad_cells").alias("n_bad_cells"))
    files = read.lines.groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("last"),
                                           F.min("line_no").alias("first"), F.sum("line_no").alias("s"))
    gaps = files.agg(F.lit("files with gaps").alias("reason"), F.count_if(
        (F.col("first") != 1) | (F.col("last") != F.col("n"))
        | (F.col("s") * 2 != F.col("n") * (F.col("n") + 1))).cast("double").alias("n_lines"),
        F.lit(0).cast("long").alias("n_bad_cells"))
    return by_reason.unionByName(body).unionByName(gaps)


_REASONS = (f"CASE WHEN {_DAMAGE} IN ('0', '4') THEN 'bad key' WHEN {_DAMAGE} IN ('1', '2', '7') THEN 'width' "
            f"WHEN {_DAMAGE} = '3' THEN 'bad cell' WHEN {_DAMAGE} = '6' THEN 'blank' ELSE 'good' END")
_SQL_LINES = (f"SELECT {_LINE} AS line, {_REASONS} AS reason, "
              f"CAST(CASE WHEN {_DAMAGE} IN ('3', '7') THEN 1 ELSE 0 END AS BIGINT) AS n_bad_cells, "
              f"CASE WHEN {_DAMAGE} NOT IN ('0', '4', '6') THEN l_orderkey * 8 + l_linenumber END AS track_id, "
              f"CASE WHEN {_DAMAGE} NOT IN ('3', '5', '6', '7') THEN CAST(p AS DOUBLE) END AS part, "
              f"CASE WHEN {_DAMAGE} <> '6' THEN CAST(s AS DOUBLE) END AS supp, "
              f"CASE WHEN {_DAMAGE} NOT IN ('1', '6', '7') THEN CAST(n AS DOUBLE) END AS line_number "
              f"FROM (SELECT l_orderkey, l_linenumber, {_TEXTS} FROM lineitem)")
SQL_CSV_LINE_ACCOUNT = (
    f"WITH x AS ({_SQL_LINES}) "
    "SELECT reason, CAST(count(*) AS DOUBLE) AS n_lines, CAST(sum(n_bad_cells) AS BIGINT) AS n_bad_cells "
    "FROM x GROUP BY reason UNION ALL SELECT 'header', 4.0::DOUBLE, 0 "
    "UNION ALL SELECT 'all of the body', count(*)::DOUBLE, CAST(sum(n_bad_cells) AS BIGINT) FROM x "
    "UNION ALL SELECT 'files with gaps', 0.0::DOUBLE, 0")

# ------------------------------------------------------------ class weights

# about one row in a hundred: a quarter of the rows of one line number
_QUARTER = (f"substr(md5(concat_ws(':', {', '.join(f'CAST({k} AS STRING)' for k in C.LI_KEYS)}, "
            f"'rare')), 1, 1) < '4'")
RARE = f"CAST(CASE WHEN l_linenumber = 7 AND {_QUARTER} THEN 1 ELSE 0 END AS INTEGER)"
RARE_BANDS = (f"CAST(CASE WHEN l_linenumber = 7 AND {_QUARTER} THEN 1 WHEN l_linenumber <= 2 THEN 2 "
              f"ELSE 0 END AS INTEGER)")
# learner, label, parameters
WEIGHTED = (("tree", RARE, {}), ("logistic", RARE, {}), ("gbt", RARE, {"max_iter": 3}),
            ("ovr_gbt", RARE_BANDS, {"max_iter": 3}), ("softmax", RARE_BANDS, {"max_iter": 3}))


def q_class_weights(spark, d):
    """Weights of the train rows' classes, whole and half the way, and the weight each class ends with."""
    prep = C._planted_prep(spark, d, RARE_BANDS)
    train = prep.data.filter("split = 'train'")
    out = None
    for power in (0.0, 0.5, 1.0):
        table = weights.class_weights(train, "label", power)
        total = (weights.with_class_weights(train, "label", table).groupBy("label")
                 .agg(F.sum("weight").alias("total")))
        part = table.join(total, "label").select(
            F.lit(power).alias("power"), "label", "n_rows", C._r("weight").alias("weight"),
            C._r("total").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


SQL_CLASS_WEIGHTS = (
    f"WITH c AS (SELECT label, count(*) AS n_rows FROM (SELECT {RARE_BANDS} AS label, "
    f"{C._sql_split(C.LI_KEYS, C.SEED)} AS split FROM lineitem) WHERE split = 'train' GROUP BY label), "
    "w AS (SELECT label, n_rows, CAST(power AS DOUBLE) AS power, power((SELECT sum(n_rows) FROM c)::DOUBLE / "
    "((SELECT count(*) FROM c) * n_rows), CAST(power AS DOUBLE)) AS weight "
    "FROM c, (VALUES (0.0), (0.5), (1.0)) p(power)) "
    f"SELECT power, label, n_rows, {C._sql_sig('weight')} AS weight, "
    f"{C._sql_sig('(weight * n_rows)')} AS total FROM w")


def q_weighted_recall(spark, d):
    """M1-M5: a class of one percent, learned with and without weights."""
    rows = []
    for rule in (RARE, RARE_BANDS):
        plain = C._planted_prep(spark, d, rule)
        for weighted, prep in ((False, plain), (True, ex.balanced(plain))):
            extra = {"weightCol": "weight"} if weighted else {}
            for learner, _, params in (x for x in WEIGHTED if x[1] == rule):
                _, scored = ex.fit_and_score(prep, ex.learner_for(learner, **params, **extra),
                                             count_equal=True)
                # one row per split and pair of classes
                rows += [(learner, weighted, *r) for r in ex.confusion_counts(scored, "label").collect()]
        plain.data.unpersist()
    return spark.createDataFrame(rows, "learner string, weighted boolean, split string, label int, "
                                       "prediction int, n_rows long")


def _sql_weighted_recall():
    """Without weights the rare class is outvoted; with them all of its cell is called rare."""
    parts = []
    for learner, rule, _ in WEIGHTED:
        rest = "0" if rule == RARE else "CASE WHEN l_linenumber <= 2 THEN 2 ELSE 0 END"
        for weighted, says in ((False, rest), (True, f"CASE WHEN l_linenumber = 7 THEN 1 ELSE {rest} END")):
            parts.append(f"SELECT '{learner}' AS learner, {str(weighted).lower()} AS weighted, "
                         f"{C._sql_split(C.LI_KEYS, C.SEED)} AS split, {rule} AS label, "
                         f"CAST({says} AS INTEGER) AS prediction FROM lineitem")
    return (f"SELECT learner, weighted, split, label, prediction, count(*) AS n_rows FROM "
            f"({' UNION ALL '.join(parts)}) GROUP BY ALL")


QUERIES = {
    "sweep_resumed": q_sweep_resumed,
    "csv_rejects": q_csv_rejects,
    "csv_line_account": q_csv_line_account,
    "class_weights": q_class_weights,
    "weighted_recall": q_weighted_recall,
}

ORACLES = {
    "sweep_resumed": SQL_SWEEP_RESUMED,
    "csv_rejects": _SQL_LINES,
    "csv_line_account": SQL_CSV_LINE_ACCOUNT,
    "class_weights": SQL_CLASS_WEIGHTS,
    "weighted_recall": _sql_weighted_recall(),
}
ORACLES = {k: C._plus_zero_rounds(C._sig_rounds(v)) for k, v in ORACLES.items()}
