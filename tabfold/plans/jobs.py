"""End-to-end job: input table + seed -> report table.

    spark-submit --py-files tabfold.zip tabfold/plans/jobs.py <input> <output> <seed> --model tree --csv
    spark-submit --py-files tabfold.zip tabfold/plans/jobs.py <input> <output> <seed> --model logistic --csv --binary

(``tabfold.zip`` is the zipped package; ``python -m tabfold.plans.jobs`` runs
the same locally.) ``input`` is a parquet table (default) or a headerless CSV (``--csv``; the 42
connection columns unless ``--names``); the label is a column, a SQL
expression, or ``--binary`` (normal vs. the rest). The report
``(ValueType, Value)`` - train accuracy, test accuracy, run time in minutes -
is written with ``partitionBy(model, seed)`` so every run of a sweep lands in
one table.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.operators import sampling, wrangle
from tabfold.plans import experiment as ex
from tabfold.sources import delimited, sinks
from tabfold.sources.tables import ensure_parallelism

# Column names of the headerless connection table the jobs
# read (41 numeric features, then the class label), in file order.
CONNECTION_FEATURES = (
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
)
CONNECTION_COLUMNS = CONNECTION_FEATURES + ("label",)
# the binary job's positive class
NORMAL = "normal"


def is_class(col: str, name: str) -> str:
    """SQL: 1 for rows of the class, else 0."""
    text = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST(CASE WHEN `{col}` = '{text}' THEN 1 ELSE 0 END AS INTEGER)"


def run_job(spark: SparkSession, source: DataFrame | str, output: str | None, model: str = "tree",
            seed=23, feature_cols: Sequence[str] | None = None, label_col: str = "label",
            label_expr: str | None = None, keys: Sequence[str] | None = None,
            max_categories: int = 4, mode: str = "overwrite_partitions", phases: bool = False,
            fit_on: str = "all", classes: Sequence[str] | None = None,
            variants: Sequence[str] | None = None, **params) -> DataFrame:
    """Report rows: train accuracy, test accuracy, total run time in minutes;
    with ``phases=True`` also ``Run time: prepare|fit|evaluate`` (SURVEY
    2.11-6: phases timed separately, not one timer started anywhere).

    ``classes`` keeps rows of those labels only (before ``label_expr``).
    ``variants`` runs the model on each preprocessing variant of one prepared
    table, one report each, in a column and sink partition ``variant``; the
    time to prepare counts in each. Without ``keys`` rows are split by their
    content and copy number, so copies of a row go to both sides.
    """
    t0 = time.time()
    df = spark.read.parquet(source) if isinstance(source, str) else source
    df = ensure_parallelism(df)
    if classes is not None:
        df = wrangle.keep_classes(df, label_col, classes)
    if label_expr is not None:
        df = df.withColumn(label_col, F.expr(label_expr))
    if feature_cols is None:
        feature_cols = wrangle.feature_cols(df, exclude=[label_col, *(keys or [])])
    if not keys:
        df = sampling.numbered_copies(df.select(*feature_cols, label_col))
        keys = [*feature_cols, label_col, "_copy"]
    ready = ex.Timer()
    prep = ready.run("prepare", ex.prepare, df, feature_cols, label_col, list(keys), seed=seed,
                     max_categories=max_categories, fit_on=fit_on)
    prepared = time.time() - t0
    reports = []
    for variant in variants or ("raw",):
        timer, t1 = ex.Timer(dict(ready.phases)), time.time()
        data, cat = timer.run("prepare", ex.variant_data, prep, variant)
        used = params if variant == "raw" else {"features_col": "indexedFeatures", **params}
        _, scored = timer.run("fit", ex.fit_and_score, prep, ex.learner_for(model, **used), data, cat,
                               count_equal=True)
        rows = timer.run("evaluate", lambda: ex.report(scored, spark, run_minutes=None).collect())
        rows = [(r[0], r[1]) for r in rows] + [("Run time", (prepared + time.time() - t1) / 60.0)]
        if phases:
            rows += [(f"Run time: {k}", v) for k, v in timer.phases.items()]
        reports += [(variant, *r) for r in rows]
    out = spark.createDataFrame(reports, "variant string, ValueType string, Value double")
    out = out.withColumn("model", F.lit(model)).withColumn("seed", F.lit(int(seed)))
    prep.data.unpersist()
    parts = ["model", "variant", "seed"]
    if variants is None:
        parts.remove("variant")
        out = out.drop("variant")
    if output is not None:
        sinks.write_report(out, output, partition_by=parts, mode=mode)
    return out


def wrangle_job(spark: SparkSession, features_path: str, tracks_path: str, output: str,
                genre=("track", 8), classes: Sequence[str] | None = None,
                value_type="double") -> DataFrame:
    """Raw feature table (three header rows) and track table (repeated header)
    -> one bzip2 CSV with a header: features by ``track_id``, known ``Genre``
    (of ``classes``, if given). Returns the written table, read back."""
    feats = delimited.read_multi_header(spark, features_path, 3, value_type=value_type)
    tracks = delimited.read_positional(spark, tracks_path, {"track_id": 0, "Genre": genre},
                                       types={"track_id": "bigint"}, key="track_id")
    table = wrangle.join_labels(feats, wrangle.drop_null(tracks, "Genre"), "track_id")
    if classes is not None:
        table = wrangle.keep_classes(table, "Genre", classes)
    sinks.write_table(table, output, "csv", compression="bzip2", header=True)
    return delimited.read_with_header(spark, output, schema=table.schema)


def main(argv=None):
    ap = argparse.ArgumentParser(description="train, score and report one model")
    ap.add_argument("input")
    ap.add_argument("output")
    ap.add_argument("seed")
    ap.add_argument("--model", default="tree", choices=sorted(ex.models.LEARNERS))
    ap.add_argument("--label", default="label")
    ap.add_argument("--label-expr", default=None)
    ap.add_argument("--features", default=None, help="comma-separated feature columns")
    ap.add_argument("--keys", default=None, help="comma-separated split key columns")
    ap.add_argument("--csv", action="store_true",
                    help="headerless CSV input (default names: the 42 connection columns)")
    ap.add_argument("--names", default=None, help="comma-separated CSV column names")
    ap.add_argument("--binary", action="store_true",
                    help=f"label = 1 when the label text is '{NORMAL}', else 0")
    ap.add_argument("--header", action="store_true",
                    help="CSV input with a header row (any compression; dots in names become _)")
    ap.add_argument("--classes", default=None, help="comma-separated labels to keep")
    ap.add_argument("--positive", default=None, help="label = 1 for this class, else 0")
    ap.add_argument("--variants", default=None,
                    help="comma-separated: raw, scaled, standardised, pca, scaled_pca")
    a = ap.parse_args(argv)
    owned = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName(f"tabfold-{a.model}").getOrCreate()
    feats = a.features.split(",") if a.features else None
    label_expr = a.label_expr
    if a.csv:
        names = a.names.split(",") if a.names else list(CONNECTION_COLUMNS)
        types = ["string" if n == a.label else "double" for n in names]
        src = delimited.read_headerless(spark, a.input, names, types)
        feats = feats or [n for n in names if n != a.label]
    elif a.header:
        src = delimited.safe_names(delimited.read_with_header(spark, a.input, infer=True))
    else:
        src = a.input
    positive = NORMAL if a.binary else a.positive
    if positive is not None:
        label_expr = is_class(a.label, positive)
    run_job(spark, src, a.output, a.model, a.seed, feats, a.label, label_expr,
            a.keys.split(",") if a.keys else None,
            classes=a.classes.split(",") if a.classes else None,
            variants=a.variants.split(",") if a.variants else None)
    if owned:
        spark.stop()


if __name__ == "__main__":
    main()
