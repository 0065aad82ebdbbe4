"""A seed sweep that goes on where a lost job stopped.

Every run's rows are written to one Parquet table, partitioned by (setting,
model, seed), as soon as the run is over. A run counts as done only if its
partition holds as many rows as each of them says it has, so what a killed
driver left half-written is run again; a run's partition is replaced as a
whole, so repeating a run changes nothing. The ledger is that table itself:
the runs still to do are the wanted ones that an anti-join leaves.

``setting`` is a digest of all that rules a result besides model and seed:
features, label, keys, parameters and the content of the rows used.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabfold.operators import evaluate, sampling
from tabfold.plans import experiment as ex

ROWS = "metric string, value double, n_metrics int, attempt string"
SCHEMA = ROWS + ", setting string, model string, seed int"


def content_digest(df: DataFrame) -> str:
    """Row count and two order-free sums over row hashes, in one aggregation."""
    hashed = df.select(F.xxhash64(*df.columns).alias("h"))
    r = hashed.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"),
                   F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['x']}:{r['s']}"


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger at ``path`` (none if nothing was written yet)."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def finished(ledger: DataFrame) -> DataFrame:
    """(setting, model, seed) of the runs whose rows are all there."""
    return (ledger.groupBy("setting", "model", "seed")
            .agg(F.count("*").alias("n"), F.min("n_metrics").alias("least"),
                 F.max("n_metrics").alias("most"), F.count_distinct("metric").alias("metrics"))
            .filter("n = least AND n = most AND n = metrics").select("setting", "model", "seed"))


def missing(spark: SparkSession, path: str, setting: str, models: Sequence[str],
            seeds: Sequence[int]) -> list[tuple[str, int]]:
    """The runs (model, seed) still to do, in the order asked for."""
    wanted = spark.createDataFrame(
        [(setting, m, int(s), i) for i, (m, s) in enumerate((m, s) for m in models for s in seeds)],
        "setting string, model string, seed int, at int")
    left = wanted.join(finished(recorded(spark, path)), ["setting", "model", "seed"], "left_anti")
    return [(r["model"], r["seed"]) for r in left.orderBy("at").collect()]


def _record(spark, path, setting, model, seed, rows, attempt):
    out = spark.createDataFrame([(m, v, len(rows), attempt, setting, model, seed) for m, v in rows], SCHEMA)
    (out.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("setting", "model", "seed").parquet(path))


def resumable_sweep(df: DataFrame, feature_cols: Sequence[str], label_col: str, keys: Sequence,
                    path: str, learners: Sequence[str] = ("tree",),
                    seeds: Sequence[int] = ex.SWEEP_SEEDS, attempt: str = "",
                    parallelism: int = 1, with_time: bool = False,
                    params: dict[str, dict] | None = None) -> DataFrame:
    """``seed_sweep`` over learners and seeds that fits only what the ledger at ``path`` lacks.

    Returns the wanted runs' rows (model, seed, metric, value, attempt), those of
    earlier calls included; ``attempt`` names the call that made them. ``params``
    are a learner's own. An error in a run fails the call once the runs at work
    are written; a call of the same setting then does the rest. A repeated seed
    or learner is one run. Other data, features, keys or parameters are another
    setting, and share nothing. With nothing left to do, no fit is made.
    """
    spark = df.sparkSession
    params = params or {}
    learners, seeds = list(dict.fromkeys(learners)), list(dict.fromkeys(int(s) for s in seeds))
    base = ex.prepare(df, feature_cols, label_col, keys, seed=seeds[0])
    try:
        data = base.data.drop("split")
        described = [list(feature_cols), label_col, [str(k) for k in keys], content_digest(data)]

        def setting_of(learner):
            text = json.dumps([*described, params.get(learner, {})], sort_keys=True, default=str)
            return "s" + hashlib.sha256(text.encode()).hexdigest()[:16]

        def one(learner, seed):
            t0 = time.time()
            split = sampling.hash_split(data, keys, seed)
            _, scored = ex.fit_and_score(base, ex.learner_for(learner, **params.get(learner, {})), split,
                                         count_equal=True)
            rows = []
            for r in evaluate.accuracy(scored).collect():
                rows += [(f"{r['split']}_accuracy", float(r["accuracy"])),
                         (f"{r['split']}_rows", float(r["n_rows"]))]
            if with_time:
                rows.append(("run_minutes", (time.time() - t0) / 60.0))
            return learner, seed, rows

        todo = [(m, s) for m in learners for m, s in missing(spark, path, setting_of(m), [m], seeds)]
        if any(ex.cn.counts_rows(ex.learner_for(m, **params.get(m, {}))) for m, _ in todo):
            base.rows_repeat()      # once, before the threads ask
        error = None
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            at_work = set()
            while todo or at_work:
                # a failed run starts no more, but those at work are still written
                while todo and error is None and len(at_work) < max(1, parallelism):
                    at_work.add(pool.submit(one, *todo.pop(0)))
                if not at_work:
                    break
                over, at_work = wait(at_work, return_when=FIRST_COMPLETED)
                for run in over:
                    if run.exception() is not None:
                        error = error or run.exception()
                    else:
                        learner, seed, rows = run.result()
                        _record(spark, path, setting_of(learner), learner, seed, rows, attempt)
        if error is not None:
            raise error
        ours = spark.createDataFrame([(setting_of(m), m, s) for m in learners for s in seeds],
                                     "setting string, model string, seed int")
    finally:
        base.data.unpersist()
    return recorded(spark, path).join(ours, ["setting", "model", "seed"], "left_semi").select(
        "model", "seed", "metric", "value", "attempt")
